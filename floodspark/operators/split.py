"""Deterministic stratified train / test split.

Rows are ordered inside their class by (hash, id), the hash being 52 bits of the md5 of id and seed
(exact in a double, and the same in any engine); the first ``ceil(share * n_class)`` rows of each class
are the test rows. The cut is found per class by distributed selection (no per-class sort in one
task); when some class has fewer than 2 rows, the split ignores classes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from .scale import kth_smallest

HASH_DIGITS = 13


def hash_order(id_col: str, seed: int = P.SEED) -> Column:
    text = F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("long")


def _among_first(part: DataFrame, n_test: int, id_col: str) -> Column:
    """Condition that holds for the first ``n_test`` rows of ``part`` by (hash, id)."""
    cut = int(kth_smallest(part, "_u", n_test - 1))
    upto = part.filter(F.col("_u") <= cut).agg(F.count_if(F.col("_u") < cut), F.count(F.lit(1))).first()
    if upto[1] == n_test:
        return F.col("_u") <= cut
    last = part.filter(F.col("_u") == cut).orderBy(id_col).offset(n_test - upto[0] - 1).limit(1).first()[id_col]
    return (F.col("_u") < cut) | ((F.col("_u") == cut) & (F.col(id_col) <= last))


def stratified_split(df: DataFrame, y: str = "y", id_col: str = "id", share: float = P.TEST_SHARE,
                     seed: int = P.SEED, out: str = "split") -> DataFrame:
    """Add ``out`` ('test' or 'train'). Rows without an id are train rows."""
    d = df.withColumn("_u", hash_order(id_col, seed))
    counts = {r[y]: r["n"] for r in d.groupBy(y).agg(F.count("_u").alias("n")).collect()}  # one row per class
    stratify = len(counts) > 0 and min(counts.values()) >= 2
    groups = counts.items() if stratify else [(None, sum(counts.values()))]
    cond = F.lit(False)
    for cls, n in groups:
        n_test = math.ceil(share * n)
        if n_test <= 0:
            continue
        in_cls = F.col(y).eqNullSafe(F.lit(cls)) if stratify else F.lit(True)
        cond = cond | (in_cls & _among_first(d.filter(in_cls), n_test, id_col))
    return d.withColumn(out, F.when(cond, "test").otherwise("train")).drop("_u")
