"""Derived features: calendar parts, saturation index, pressure z-score, composite risk,
interactions. Global statistics enter as scalar subqueries (computed once, no cross join)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import calendar as CAL
from .joins import scalar


def with_calendar(df: DataFrame, ts: str = "datetime") -> DataFrame:
    parts = {**CAL.calendar_parts(ts), **CAL.cyclic_parts(ts)}
    return df.select("*", *[c.alias(n) for n, c in parts.items()])


def saturation_index(df: DataFrame, top: Column | None = None, soil: str = "soil_moisture_pct",
                     p72: str = "precip_72h") -> DataFrame:
    """Half the soil moisture plus the 72 h rain as a share of its maximum (``top``, by default of ``df``) x 50."""
    if soil not in df.columns or p72 not in df.columns:
        return df
    top = scalar(df, F.max(p72)) if top is None else top
    return df.withColumn("indice_saturacao", F.col(soil) * 0.5 + F.col(p72) / top * 50)


def zscore(df: DataFrame, stats: Column | None = None, col: str = "pressure_hpa",
           out: str = "pressao_normalizada") -> DataFrame:
    """(x - mean) / sample deviation; ``stats`` is a struct (mu, sd), by default of ``df`` in one pass."""
    if col not in df.columns:
        return df
    if stats is None:
        stats = scalar(df, F.struct(F.avg(col).alias("mu"), F.stddev_samp(col).alias("sd")))
    return df.withColumn(out, (F.col(col) - stats["mu"]) / stats["sd"])


def composite_risk(df: DataFrame, top: dict[str, Column]) -> DataFrame:
    """Weighted sum of normalised parts over the parts whose columns exist; weights renormalised.
    ``top`` holds the maximum of every part but the saturation index, which is a percentage."""
    parts = []
    for col, weight in P.RISK_WEIGHTS:
        if col not in df.columns:
            continue
        x = F.col(col)
        if col == "indice_saturacao":
            val = x / 100
        elif col == "taxa_subida_m_h":
            val = F.when(x.isNull(), F.lit(None)).otherwise(F.greatest(x, F.lit(0.0))) / top[col]
        else:
            val = x / top[col]
        parts.append((val, weight))
    if not parts:
        return df
    total = sum(w for _, w in parts)
    expr = None
    for val, weight in parts:
        term = val * (weight / total)
        expr = term if expr is None else expr + term
    return df.withColumn("risco_composto", expr)


def interactions(df: DataFrame) -> DataFrame:
    if {"precip_48h", "nivel_metros"} <= set(df.columns):
        df = df.withColumn("precip_nivel_interaction", F.col("precip_48h") * F.col("nivel_metros"))
    if {"humidity_pct", "temperature_c"} <= set(df.columns):
        df = df.withColumn("humidade_temp_interaction", F.col("humidity_pct") * F.col("temperature_c"))
    return df


def derived_features(df: DataFrame) -> DataFrame:
    """Saturation index, pressure z-score, composite risk and interactions with all global
    statistics from ONE aggregation pass (one row back to the driver), instead of a subquery each."""
    have = set(df.columns)
    aggs = {}
    if {"soil_moisture_pct", "precip_72h"} <= have:
        aggs["max_p72"] = F.max("precip_72h")
    if "pressure_hpa" in have:
        aggs["mu_p"], aggs["sd_p"] = F.avg("pressure_hpa"), F.stddev_samp("pressure_hpa")
    for col, _ in P.RISK_WEIGHTS:
        if col in have and col != "indice_saturacao":
            aggs[f"max_{col}"] = F.max(col)
    st = df.agg(*[e.alias(k) for k, e in aggs.items()]).first().asDict() if aggs else {}

    def lit(k):
        v = st.get(k)
        return F.lit(None).cast("double") if v is None else F.lit(float(v))

    if "max_p72" in st:
        df = saturation_index(df, lit("max_p72"))
    if "mu_p" in st:
        df = zscore(df, F.struct(lit("mu_p").alias("mu"), lit("sd_p").alias("sd")))
    df = composite_risk(df, {col: lit(f"max_{col}") for col, _ in P.RISK_WEIGHTS})
    return interactions(df)
