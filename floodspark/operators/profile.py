"""Dataset profiles: counts, period, label rate, alert counts, value counts, imbalance, NULLs."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P


def dataset_profile(df: DataFrame, ts: str = "datetime", key: str = "location",
                    label: str = "teve_enchente", alert: str = "nivel_alerta", skip: Sequence[str] = ()) -> DataFrame:
    """One row: rows, columns, first/last time, stations, label sum and rate, rows per alert level, and the names of the
    features (columns other than time, station, targets and ``skip``), targets and stations (sorted; a station dimension).
    One aggregation pass (partial aggregates per task, then one merge)."""
    targets = [c for c in (label, alert) if c in df.columns]
    features = [c for c in df.columns if c not in (ts, key, *targets, *skip)]

    def names(cols):
        return F.array(*[F.lit(c) for c in cols]).cast("array<string>")
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
            F.min(ts).alias("period_start"), F.max(ts).alias("period_end"),
            F.count_distinct(key).alias("n_locations")]
    if label in df.columns:
        aggs += [F.sum(label).cast("long").alias("n_flood"), F.avg(label).alias("flood_rate")]
    if alert in df.columns:
        aggs += [F.count_if(F.col(alert) == lv).alias(f"n_alert_{lv}") for lv in range(len(P.ALERT_NAMES))]
    aggs += [F.lit(len(features)).alias("n_features"), names(features).alias("features"), names(targets).alias("targets"),
             F.sort_array(F.collect_set(key)).alias("locations")]
    return df.agg(*aggs)


def profile_json(profile: DataFrame) -> DataFrame:
    """The profile row as one JSON document."""
    return profile.select(F.to_json(F.struct(*[F.col(c) for c in profile.columns])).alias("json"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(col)


def imbalance_ratio(df: DataFrame, y: str = "y") -> DataFrame:
    """Largest over smallest class count; flags for a too-small minority (< 10) and a ratio > 100."""
    c = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.max("n").alias("n_majority"), F.min("n").alias("n_minority"),
                 F.count(F.lit(1)).alias("n_classes")) \
        .withColumn("imbalance_ratio", F.try_divide(F.col("n_majority").cast("double"), F.col("n_minority"))) \
        .withColumn("minority_ok", F.col("n_minority") >= P.MIN_CLASS_ROWS) \
        .withColumn("warn_extreme", F.col("imbalance_ratio") > P.IMBALANCE_WARN)


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Long form: column, NULL count, NULL percent - one aggregation pass for all columns."""
    cols = list(cols or df.columns)
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_z{i}") for i, c in enumerate(cols)])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_z{i}").alias("n_null"))
                                for i, c in enumerate(cols)])).alias("s")
    out = agg.select("_n", stack)
    return out.select(F.col("s.column").alias("column"), F.col("s.n_null").alias("n_null"),
                      F.round(F.try_divide(F.col("s.n_null") * 100.0, F.col("_n")), 4).alias("pct_null"))
