"""Operator 5 - mixing sources to target weights (native: DataFrame expressions only).

Sizes are word counts, aggregated per source. Every source gets a target by weight, held at
``max_epochs`` times its size with the excess reshared by weight among the others (the fixed point
is the water level L with target = min(cap, weight * L)). The repetition rate is target / size;
a document is emitted floor(rate) times plus one copy more with probability frac(rate), decided by
a hash of its doc_id and the seed, so that reruns and retried tasks agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, unsigned_fraction

WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, share: float = 1.5, max_epochs: int = 2, weights=WEIGHTS) -> DataFrame:
    """source, source_size, target, rate from (source, size) rows.

    Weights repeat over the sources in code-point order, NULL last. One row per source reaches the
    ordering step (sums and counts only), never documents. A source of size 0 has target 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("weight", w.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    # Sources fill up in the order of cap / weight; before each one, the level that the rest would get.
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
          .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
          .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
          .withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("weight_left")))
    # The level holds at the first source that does not fill up.
    s = s.withColumn("place", F.row_number().over(by_fill))
    is_open = F.col("level") * F.col("weight") <= F.col("cap")
    s = s.withColumn("level", F.min(F.when(is_open, F.struct("place", "level"))).over(every)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return s.select("source", "source_size", target.alias("target"),
                    F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def mix_plan(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """docs with size, source_size, target and copies.

    NULL or empty text has size 0. Extra columns stay (those named like the new ones are replaced).
    Rows repeating a doc_id draw alike. An empty table gives an empty result. The text is read once:
    sizes are materialised before they are summed and joined.
    """
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    return with_copies(sized, seed, **how)


def with_copies(sized: DataFrame, seed: str = "mix", **how) -> DataFrame:
    t = source_targets(sized.select("source", "size"), **how).withColumnRenamed("source", "_source")
    drop = [c for c in ("source_size", "target", "rate", "copies") if c in sized.columns]
    j = sized.drop(*drop).join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    extra = unsigned_fraction(F.lit(seed), F.col("doc_id")) < F.col("rate") - F.floor("rate")
    return j.withColumn("copies", F.floor("rate") + extra.cast("long")).drop("rate")


def mix_report(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    sized = cut(docs.select("doc_id", "source", F.coalesce(
        F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    return with_copies(sized, seed, **how).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """The mixture itself: every document as many times as the plan takes it, input columns only."""
    names = docs.columns
    d = docs.select(*names, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("__size"))
    report = source_targets(d.select("source", F.col("__size").alias("size")), **how).select(
        F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    extra = unsigned_fraction(F.lit(seed), F.col("doc_id")) < F.col("__rate") - F.floor("__rate")
    j = d.join(report, F.col("source").eqNullSafe(F.col("__source")))
    copies = (F.floor("__rate") + extra.cast("long")).cast("int")
    return (j.withColumn("__copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
             .select(*names))
