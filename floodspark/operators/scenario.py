"""Scenario what-if, three-mode decisions and run evaluation.

The original simulator drew random multipliers per reading; here each scenario applies the
midpoint of its ranges, deterministically, to real readings (a fixed 4-row fan-out per reading,
expressed as an array explode - no join)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import rules as R
from ..functions.calendar import hours_between
from ..functions.physics import clip


def _mid(r) -> float:
    return (r[0] + r[1]) / 2


def scenario_what_if(df: DataFrame, include_normal: bool = True, out: str = "cenario") -> DataFrame:
    """One row per reading and scenario with the scenario's effect applied, then physical clips."""
    specs = [F.struct(F.lit(name).alias("name"), F.lit(float(_mid(rain))).alias("rain"),
                      F.lit(float(_mid(lvl))).alias("lvl"), F.lit(float(_mid(rise))).alias("rise"),
                      F.lit(float(_mid(hum))).alias("hum"), F.lit(float(_mid(pres))).alias("pres"),
                      F.lit(float(_mid(P.SCENARIO_WIND))).alias("wind"), F.lit(float(_mid(P.SCENARIO_SOIL))).alias("soil"))
             for name, rain, lvl, rise, hum, pres in P.SCENARIOS]
    if include_normal:
        specs = [F.struct(F.lit("normal").alias("name"), F.lit(1.0).alias("rain"), F.lit(0.0).alias("lvl"),
                          F.lit(1.0).alias("rise"), F.lit(0.0).alias("hum"), F.lit(0.0).alias("pres"),
                          F.lit(1.0).alias("wind"), F.lit(0.0).alias("soil"))] + specs
    d = df.withColumn("_sc", F.explode(F.array(*specs)))
    normal = F.col("_sc.name") == "normal"
    mod = {
        "precipitation_mm": F.col("precipitation_mm") * F.col("_sc.rain"),
        "nivel_metros": F.col("nivel_metros") + F.col("_sc.lvl"),
        "taxa_subida_m_h": F.col("taxa_subida_m_h") * F.col("_sc.rise"),
        "humidity_pct": F.col("humidity_pct") + F.col("_sc.hum"),
        "pressure_hpa": F.col("pressure_hpa") - F.col("_sc.pres"),
        "wind_speed_kmh": F.col("wind_speed_kmh") * F.col("_sc.wind"),
        "soil_moisture_pct": F.col("soil_moisture_pct") + F.col("_sc.soil"),
    }
    for c, lo, hi in P.SCENARIO_CLIPS:
        mod[c] = clip(mod[c], lo, hi)
    cols = []
    for c in df.columns:
        if c in mod:
            cols.append(F.when(normal, F.col(c)).otherwise(mod[c]).alias(c))
        else:
            cols.append(F.col(c))
    return d.select(F.col("_sc.name").alias(out), *cols)


def mode_decision(df: DataFrame, prob: str = "prob_enchente") -> DataFrame:
    """Prediction and alert level under each mode threshold, and the confidence |p - .5| x 2."""
    short = {"emergencia": "emerg", "urbano": "urbano", "conservador": "conserv"}
    cols = []
    for name, t in P.MODES:
        cols.append(R.mode_prediction(prob, F.lit(t)).alias(f"pred_{name}"))
    for name, t in P.MODES:
        cols.append(R.mode_level(prob, F.lit(t)).alias(f"alert_level_{short[name]}"))
    return df.select("*", *cols, R.confidence(prob).alias("confidence"))


def mode_long(df: DataFrame, prob: str = "prob_enchente", keep: Sequence[str] = ()) -> DataFrame:
    """One row per reading and mode (fixed 3-way fan-out)."""
    modes = F.explode(F.array(*[F.struct(F.lit(n).alias("mode"), F.lit(t).alias("threshold")) for n, t in P.MODES]))
    d = df.select(*keep, prob, modes.alias("_m"))
    return d.select(*keep, prob, F.col("_m.mode").alias("mode"), F.col("_m.threshold").alias("threshold"),
                    R.mode_prediction(prob, F.col("_m.threshold")).alias("pred"))


def mode_evaluation(df: DataFrame, prob: str = "prob_enchente", truth: str = "truth",
                    scenario: str = "cenario") -> DataFrame:
    """Per scenario and mode: accuracy, detection rate (recall when the truth is flood, else
    specificity), false positives / negatives, alerts, mean / max / min probability."""
    d = mode_long(df, prob, keep=[scenario, truth])
    p1, t1 = F.col("pred") == 1, F.col(truth) == 1
    g = d.groupBy(scenario, "mode").agg(
        F.avg((F.col("pred") == F.col(truth)).cast("double")).alias("accuracy"),
        F.max(F.col(truth)).alias("_t"),
        F.avg(p1.cast("double")).alias("_rec"), F.avg((~p1).cast("double")).alias("_spec"),
        F.count_if(p1 & ~t1).alias("false_positives"), F.count_if(~p1 & t1).alias("false_negatives"),
        F.count_if(p1).alias("total_alerts"),
        F.avg(prob).alias("avg_probability"), F.max(prob).alias("max_probability"), F.min(prob).alias("min_probability"))
    return g.select(scenario, "mode", "accuracy",
                    F.when(F.col("_t") == 1, F.col("_rec")).otherwise(F.col("_spec")).alias("detection_rate"),
                    "false_positives", "false_negatives", "total_alerts",
                    "avg_probability", "max_probability", "min_probability")


def high_risk_summary(df: DataFrame, prob: str = "prob_enchente", ts: str = "timestamp",
                      by: Sequence[str] = ("cenario",), limit: float = P.HIGH_PROBABILITY) -> DataFrame:
    """Readings with probability above 0.8: count, hours between first and last, maximum."""
    h = df.filter(F.col(prob) > limit)
    return h.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_high"),
        hours_between(F.min(ts), F.max(ts)).alias("duration_h"),
        F.max(prob).alias("max_probability"))


def run_summary(df: DataFrame, ts: str = "timestamp", by: Sequence[str] = ("cenario",)) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_points"),
        hours_between(F.min(ts), F.max(ts)).alias("duration_h"),
        F.avg("temperature_c").alias("avg_temperature"), F.avg("precipitation_mm").alias("avg_precipitation"),
        F.avg("nivel_metros").alias("avg_level"))
