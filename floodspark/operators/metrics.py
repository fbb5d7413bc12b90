"""Classifier evaluation: confusion counts, binary metrics, class report, ROC AUC, average
precision, threshold sweeps and choices, histograms, class weights, model choice.

Everything reduces the prediction table with grouped aggregates first (partial aggregation on
the map side); the few order-dependent steps (cumulative sums over scores) run on pre-aggregated
distinct scores with a bucketed two-level scan, never one task over all rows."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..session import cut
from . import frames as FR


def _div0(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0 (zero-division rule of the metrics)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_counts(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp (zero-filled when a class is never predicted)."""
    yy, pp = F.col(y) == 1, F.col(pred) == 1
    return df.groupBy(*by).agg(
        F.count_if(~yy & ~pp).alias("tn"), F.count_if(~yy & pp).alias("fp"),
        F.count_if(yy & ~pp).alias("fn"), F.count_if(yy & pp).alias("tp"))


def with_rates(c: DataFrame) -> DataFrame:
    """Metrics from counts (columns tn, fp, fn, tp)."""
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    prec = _div0(tp, tp + fp)
    rec = _div0(tp, tp + fn)
    spec = _div0(tn, tn + fp)
    f1 = _div0(2 * tp, 2 * tp + fp + fn)
    return (c.withColumn("accuracy", _div0(tp + tn, tp + tn + fp + fn))
            .withColumn("precision", prec).withColumn("recall", rec).withColumn("specificity", spec)
            .withColumn("f1", f1)
            .withColumn("balanced_accuracy", (rec + spec) / 2)
            .withColumn("fnr", _div0(fn, fn + tp)).withColumn("fpr", _div0(fp, fp + tn))
            .withColumn("selection_score", F.col("precision") * P.SELECTION_WEIGHTS["precision"]
                        + F.col("recall") * P.SELECTION_WEIGHTS["recall"] + F.col("f1") * P.SELECTION_WEIGHTS["f1"])
            .withColumn("tuning_score", F.col("recall") * P.TUNING_WEIGHTS["recall"]
                        + F.col("f1") * P.TUNING_WEIGHTS["f1"] + F.col("precision") * P.TUNING_WEIGHTS["precision"]))


def binary_metrics(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    return with_rates(confusion_counts(df, y, pred, by))


def class_report(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Per class precision / recall / F1 / support, then macro and weighted means."""
    c = confusion_counts(df, y, pred)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    per = c.select(F.explode(F.array(
        F.struct(F.lit("0").alias("label"), tn.alias("t"), fn.alias("f_pred"), fp.alias("f_miss")),
        F.struct(F.lit("1").alias("label"), tp.alias("t"), fp.alias("f_pred"), fn.alias("f_miss")))).alias("r"))
    per = per.select(
        F.col("r.label").alias("label"),
        _div0(F.col("r.t"), F.col("r.t") + F.col("r.f_pred")).alias("precision"),
        _div0(F.col("r.t"), F.col("r.t") + F.col("r.f_miss")).alias("recall"),
        _div0(2 * F.col("r.t"), 2 * F.col("r.t") + F.col("r.f_pred") + F.col("r.f_miss")).alias("f1"),
        (F.col("r.t") + F.col("r.f_miss")).alias("support"))
    tot = F.sum("support")
    macro = per.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), tot.alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("label"),
                       _div0(F.sum(F.col("precision") * F.col("support")), tot).alias("precision"),
                       _div0(F.sum(F.col("recall") * F.col("support")), tot).alias("recall"),
                       _div0(F.sum(F.col("f1") * F.col("support")), tot).alias("f1"), tot.alias("support"))
    return per.unionByName(macro).unionByName(weighted)


# ---- ordered scans over distinct scores -----------------------------------------------------

def score_counts(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Distinct score -> (pos, neg). Pre-aggregation: a score shared by a third of the rows is one row."""
    return df.groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))


def ordered_prefix(df: DataFrame, order: str, cols: Sequence[str]) -> DataFrame:
    """Add ``<c>_below``: sum of ``c`` over rows with a smaller ``order`` value (unique values).

    Rows are range-partitioned by ``order``; the totals of the partitions are accumulated over the small table of
    partitions, and the running sum inside each partition is added."""
    d = FR.ranged(df, [order]).withColumn("_b", F.shiftright("_number", 33))
    tot = d.groupBy("_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    wb = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)   # one row per partition
    tot = tot.select("_b", *[F.coalesce(F.sum(f"_t_{c}").over(wb), F.lit(0)).alias(f"_o_{c}") for c in cols])
    wi = Window.partitionBy("_b").orderBy("_number").rowsBetween(Window.unboundedPreceding, -1)
    d = d.select("*", *[F.coalesce(F.sum(c).over(wi), F.lit(0)).alias(f"_i_{c}") for c in cols])
    d = d.join(tot, ["_b"])
    for c in cols:
        d = d.withColumn(f"{c}_below", F.col(f"_o_{c}") + F.col(f"_i_{c}"))
    return d.drop("_b", "_number", *[f"_{p}_{c}" for c in cols for p in ("o", "i")])


def roc_auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Area under the ROC curve with ties counted half (rank-sum form)."""
    sc = ordered_prefix(score_counts(df, y, score), "s", ["neg"])
    agg = sc.agg(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * 0.5)).alias("_w"),
                 F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return agg.select(F.try_divide(F.col("_w"), F.col("_p") * F.col("_n")).alias("roc_auc"))


def average_precision(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Sum over distinct scores (descending) of recall step x precision at that score."""
    counts = cut(score_counts(df, y, score))
    sc = ordered_prefix(counts, "s", ["pos", "neg"])
    tot = counts.agg(F.sum("pos").alias("v")).scalar()
    totn = counts.agg(F.sum("neg").alias("v")).scalar()
    tp = tot - F.col("pos_below")
    fp = totn - F.col("neg_below")
    return sc.agg(F.try_divide(F.sum(F.col("pos") * tp / (tp + fp)), F.lit(1.0) * tot).alias("average_precision"))


# ---- threshold grids ------------------------------------------------------------------------

def _grid_index(score: Column, grid_pct: Sequence[int]) -> Column:
    """Number of grid thresholds (pct / 100) at or below the score."""
    terms = [F.when(score >= F.lit(p / 100.0), 1).otherwise(0) for p in grid_pct]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def threshold_sweep(df: DataFrame, y: str = "y", score: str = "score",
                    grid_pct: Sequence[int] = P.SWEEP_GRID_PCT) -> DataFrame:
    """Metrics at every grid threshold in one pass: rows are counted per grid bucket, then the
    (<= len(grid) + 1 rows) bucket table is accumulated from the top."""
    grid_pct = sorted(grid_pct)
    b = df.groupBy(_grid_index(F.col(score), grid_pct).alias("_b")).agg(
        F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) != 1).alias("_neg"))
    spark = df.sparkSession
    grid = spark.createDataFrame([(i + 1, p) for i, p in enumerate(grid_pct)], "_b int, threshold_pct int")
    allb = spark.createDataFrame([(i,) for i in range(len(grid_pct) + 1)], "_b int")
    b = allb.join(b, ["_b"], "left").fillna(0, ["_pos", "_neg"])
    w = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, 0)   # tiny table
    b = b.select("_b", F.sum("_pos").over(w).alias("tp"), F.sum("_neg").over(w).alias("fp"),
                 F.sum("_pos").over(Window.partitionBy()).alias("_P"), F.sum("_neg").over(Window.partitionBy()).alias("_N"))
    out = grid.join(b, ["_b"]).select(
        "threshold_pct", (F.col("threshold_pct") / 100.0).alias("threshold"),
        F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
        (F.col("_P") - F.col("tp")).cast("long").alias("fn"), (F.col("_N") - F.col("fp")).cast("long").alias("tn"))
    out = with_rates(out).withColumnRenamed("selection_score", "custom_score")
    return out.select("threshold_pct", "threshold", "precision", "recall", "f1", "tp", "fp", "fn", "tn",
                      "fnr", "fpr", "custom_score", "tuning_score")


def best_thresholds(sweep: DataFrame) -> DataFrame:
    """Best threshold by F1, recall, custom score (lowest threshold on ties) and by fewest false
    negatives, then highest precision."""
    crits = [("best_f1", "f1"), ("best_recall", "recall"), ("best_custom", "custom_score")]
    parts = []
    for name, col in crits:
        w = Window.orderBy(F.desc(col), F.asc("threshold_pct"))   # sweep table: one row per grid value
        parts.append(sweep.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
                     .select(F.lit(name).alias("criterion"), "threshold", F.col(col).alias("value")))
    w = Window.orderBy(F.asc("fn"), F.desc("precision"), F.asc("threshold_pct"))
    parts.append(sweep.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
                 .select(F.lit("min_fn").alias("criterion"), "threshold", F.col("fn").cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tuned_threshold(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Grid 0.10..0.85: the first threshold with the highest 0.6R + 0.3F1 + 0.1P; 0.5 when no
    threshold scores above 0."""
    sw = threshold_sweep(df, y, score, P.TUNE_GRID_PCT)
    w = Window.orderBy(F.desc("tuning_score"), F.asc("threshold_pct"))
    best = sw.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return best.select(F.when(F.col("tuning_score") > 0, F.col("threshold")).otherwise(P.DEFAULT_THRESHOLD).alias("threshold"),
                       F.when(F.col("tuning_score") > 0, F.col("tuning_score")).otherwise(0.0).alias("score"))


def histogram(df: DataFrame, col: str, bins: int = P.HIST_BINS) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed; every bin listed (empty ones with 0)."""
    lo = df.agg(F.min(col).alias("v")).scalar()
    hi = df.agg(F.max(col).alias("v")).scalar()
    x = F.col(col)
    idx = (F.when(hi == lo, F.lit(bins // 2))
           .otherwise(F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1))).cast("int"))
    counts = df.filter(x.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    allb = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return allb.join(counts, ["bin"], "left").fillna(0, ["n"])


def class_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """n / (2 n_c) per class, and the positive-class weight neg / pos (10 when there is no positive)."""
    c = df.groupBy(F.col(y).alias("class")).agg(F.count(F.lit(1)).alias("n_c"))
    is_pos = F.col("class") == 1
    t = c.agg(F.struct(F.sum("n_c").alias("n"), F.coalesce(F.sum(F.when(is_pos, F.col("n_c"))), F.lit(0)).alias("pos"),
                       F.coalesce(F.sum(F.when(~is_pos, F.col("n_c"))), F.lit(0)).alias("neg"))).scalar()
    n, pos, neg = t["n"], t["pos"], t["neg"]
    return c.select("class", "n_c", (n / (F.col("n_c") * 2.0)).alias("weight"),
                    F.when(pos > 0, neg / (pos * 1.0)).otherwise(P.POS_WEIGHT_FALLBACK).alias("scale_pos_weight"))


def best_model(results: DataFrame, score: str = "selection_score", ordinal: str = "ordinal") -> DataFrame:
    """Highest weighted score, first model on ties."""
    w = Window.orderBy(F.desc(score), F.asc(ordinal))   # one row per model
    return results.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def alert_distribution(df: DataFrame, level: str = "alert_level") -> DataFrame:
    """Count and percent per alert level 0..3, empty levels included, with level names."""
    from ..functions.rules import alert_name
    spark = df.sparkSession
    dim = spark.createDataFrame([(i,) for i in range(len(P.ALERT_NAMES))], "alert_level int")
    total = df.agg(F.count(F.lit(1)).alias("v")).scalar()
    counts = df.groupBy(F.col(level).alias("alert_level")).agg(F.count(F.lit(1)).alias("n"))
    out = dim.join(counts, ["alert_level"], "left").fillna(0, ["n"])
    return out.select("alert_level", alert_name("alert_level").alias("alert_name"), "n",
                      F.round(F.try_divide(F.col("n") * 100.0, total), 4).alias("pct"))
