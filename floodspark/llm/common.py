"""Small Spark helpers of this subpackage."""

from __future__ import annotations

import ctypes
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path, ship_package
from .text import forget

#: The white space of every contract: space and TAB..CR.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def ready(spark: SparkSession) -> None:
    """Executors can import the package and the shared checkpoint folder is set."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that later stages and retries after a lost
    executor read files instead of replaying the work."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """The session's shuffle width; block and bucket counts are multiples of it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own below the shared checkpoint folder."""
    return f"{scratch_path(spark, name)}-{uuid.uuid4().hex[:12]}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{re.sub('/+$', '', sf_dir)}/{name}.parquet")


def unsigned_fraction(*parts: Column) -> Column:
    """A number in [0, 1) from 48 bits of the md5 of the parts; the same in every engine."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def side(t, schema):
    """One side of a co-grouped pair; where the group has no rows, Spark passes a
    table without its columns."""
    return t if set(schema.names) <= set(t.column_names) else schema.empty_table()


def renewed(df):
    """The same columns under new identities: both sides of a cogroup must not share attributes."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def release(powers: bool = True) -> None:
    """Hand freed memory back to the system: Python workers outlive their tasks and would go on holding it.
    ``powers``: the kept powers of the text kernels go too (not between the groups of one task)."""
    if powers:
        forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:                # not the GNU library, nothing to do
        pass


def released(run):
    """``run`` (batches -> batches), after which the worker holds no freed memory."""
    def held(batches):
        try:
            yield from run(batches)
        finally:
            release()
    return held
