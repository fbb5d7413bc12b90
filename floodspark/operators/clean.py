"""Cleaning operators: empty rows, NULL keys, projections, range filters, sparse columns,
duplicates, unions and sorting."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.parsing import blank_to_null


def blank_strings_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Empty / blank text -> NULL in the given (default: all string) columns."""
    cols = cols or [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    return df.select(*[blank_to_null(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def drop_empty(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Drop rows where every measure column is NULL."""
    return df.dropna(how="all", subset=list(measures))


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropna(how="any", subset=list(keys))


def select_present(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Project the wanted columns that exist, in the wanted order."""
    have = set(df.columns)
    return df.select(*[c for c in wanted if c in have])


def in_limits(df: DataFrame, limits=P.OUTLIER_LIMITS):
    """AND of inclusive range conditions over the limit columns present (NULL fails)."""
    cond = F.lit(True)
    for c, lo, hi in limits:
        if c in df.columns:
            cond = cond & F.col(c).between(lo, hi)
    return cond


def outlier_filter(df: DataFrame, limits=P.OUTLIER_LIMITS) -> DataFrame:
    return df.filter(in_limits(df, limits))


def outlier_report(df: DataFrame, limits=P.OUTLIER_LIMITS) -> DataFrame:
    """One row: rows before, kept, removed and removed percent - a single aggregation pass."""
    keep = in_limits(df, limits)
    return (df.agg(F.count(F.lit(1)).alias("n_original"),
                   F.count_if(keep).alias("n_kept"))
            .withColumn("n_removed", F.col("n_original") - F.col("n_kept"))
            .withColumn("pct_removed", F.round(F.try_divide(F.col("n_removed") * 100.0, F.col("n_original")), 4)))


def null_shares(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row with the NULL share of each column (one pass for all columns)."""
    cols = list(cols or df.columns)
    return df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])


def sparse_column_prune(df: DataFrame, limit: float = P.NULL_SHARE_LIMIT) -> DataFrame:
    """Drop the columns whose NULL share is strictly above ``limit``.

    The output schema depends on the data, so this runs one small aggregation eagerly (one row
    back to the driver: one number per column)."""
    shares = null_shares(df).first().asDict()
    drop = [c for c, s in shares.items() if s is not None and s > limit]
    return df.drop(*drop)


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep, for each key, the first row in ``order`` (file order). A grouped ``min_by`` with
    map-side partial aggregation, so a hot key is reduced before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    ordkey = F.struct(*[F.col(c) for c in order])
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in others]), ordkey).alias("_first"))
    return agg.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in others]).select(*df.columns)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; columns missing in a frame become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def sorted_by(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Global sort (range-partitioned, so it scales); use ``sortWithinPartitions`` inside jobs."""
    return df.orderBy(*cols)
