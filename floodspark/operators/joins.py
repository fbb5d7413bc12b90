"""Joins: readings with rivers, station dimension, name containment, scalar statistics, as-of
step lookup, anti-joins."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from . import frames as FR


def station_dim(spark) -> DataFrame:
    """The fixed station table (4 rows): safe to broadcast."""
    rows = [(code, loc, river, base, status, event) for code, loc, river, base, status, event in P.STATIONS]
    return spark.createDataFrame(
        rows, "code string, location string, rio_principal string, base_level double, "
              "status_limit double, event_limit double")


def left_join(left: DataFrame, right: DataFrame, keys: Sequence[str], right_cols: Sequence[str]) -> DataFrame:
    """Left equi-join; the right side is pruned to keys + ``right_cols`` before the join."""
    r = right.select(*keys, *[c for c in right_cols if c not in keys])
    return left.join(r, list(keys), "left")


def station_lookup(df: DataFrame, location: str = "location") -> DataFrame:
    """Attach station attributes with defaults for unknown stations (broadcast of a 4-row table)."""
    dim = F.broadcast(station_dim(df.sparkSession).withColumnRenamed("location", location))
    out = df.join(dim, [location], "left")
    return (out
            .withColumn("rio_principal", F.coalesce(F.col("rio_principal"), F.lit(P.DEFAULT_RIVER)))
            .withColumn("base_level", F.coalesce(F.col("base_level"), F.lit(P.DEFAULT_BASE_LEVEL)))
            .withColumn("event_limit", F.coalesce(F.col("event_limit"), F.col("base_level") * P.EVENT_FACTOR)))


def scalar(df: DataFrame, agg: Column) -> Column:
    """A global statistic as a scalar subquery: computed once, no cross join, no driver trip."""
    return df.agg(agg.alias("v")).scalar()


def name_match(texts: DataFrame, names: DataFrame, text_col: str, id_col: str,
               name_col: str = "location") -> DataFrame:
    """For each text, the smallest name contained in it (case-blind).

    Exact containment as an equi-join: every substring of the text whose length is one of the
    name lengths is looked up in the name table. Work per text is length x distinct name
    lengths; no pairing of every text with every name."""
    nm = (names.select(F.col(name_col).alias("_name")).distinct()
          .withColumn("_lname", F.lower("_name")).withColumn("_len", F.length("_lname")))
    lens = nm.agg(F.array_sort(F.collect_set("_len")).alias("v")).scalar()
    t = texts.select(F.col(id_col), F.lower(F.col(text_col)).alias("_t"))
    t = t.withColumn("_len", F.explode(lens))
    t = t.filter(F.col("_len") <= F.length("_t"))
    t = t.withColumn("_start", F.explode(F.sequence(F.lit(1), F.length("_t") - F.col("_len") + 1)))
    t = t.select(id_col, "_len", F.expr("substring(_t, _start, _len)").alias("_lname"))
    hits = t.join(nm, ["_len", "_lname"])
    return hits.groupBy(id_col).agg(F.min("_name").alias(name_col))


def step_asof(df: DataFrame, value: str, steps: Sequence[tuple[int, str]] = P.PROGRESS_STEPS,
              out: str = "intensidade") -> DataFrame:
    """Backward as-of lookup against a small fixed step table: the label of the largest step
    <= value (a fixed-size table, folded into one CASE expression by position)."""
    expr = None
    for start, label in sorted(steps, key=lambda s: s[0], reverse=True):
        cond = F.col(value) >= start
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    first = sorted(steps, key=lambda s: s[0])[0][1]
    return df.withColumn(out, expr.otherwise(first))


def asof_join(df: DataFrame, steps: DataFrame, time: str, values: Sequence[str], key: Sequence[str] | str = (), tie: str = "seq") -> DataFrame:
    """df plus ``values`` of the last step at or before each row's ``time`` (of the same ``key``, which may be NULL).

    ``steps`` has the key, ``time``, ``tie`` and the values. Of steps at one time the one with the greatest ``tie`` holds; a step's NULL
    value holds like any other; rows before the first step get NULL; steps without a time are left out, and rows without one get NULL.
    Rows and steps are merged in order and the last step is carried forward on the skew-safe frames, so no key is brought into
    one task. ``tie`` must tell the rows of one time apart.
    """
    key = [key] if isinstance(key, str) else list(key)
    one = [] if key else [F.lit(0).alias("_all")]
    keys = key or ["_all"]
    found = steps.filter(F.col(time).isNotNull()).select(*key, *one, time, F.col(tie).alias("_tie"), F.lit(0).alias("_kind"), F.struct(*values).alias("_step"))
    rows = df.select("*", *one, F.col(tie).alias("_tie"), F.lit(1).alias("_kind"), F.lit(None).cast(found.schema["_step"].dataType).alias("_step"))
    both = rows.unionByName(found, allowMissingColumns=True)
    d = FR.last_known(both, keys, [time, "_kind", "_tie"], "_step", "_held").filter("_kind = 1")
    return d.select(*df.columns, *[F.col(f"_held.{v}").alias(v) for v in values])
