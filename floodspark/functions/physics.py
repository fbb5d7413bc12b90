"""Soil, river level and flood-severity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x, lo: float, hi: float) -> Column:
    """Clip that keeps NULL as NULL (``greatest``/``least`` alone would skip the NULL)."""
    x = _c(x)
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(
        F.least(F.greatest(x.cast("double"), F.lit(float(lo))), F.lit(float(hi))))


def soil_moisture(humidity="humidity_pct", p24="precip_24h") -> Column:
    raw = _c(humidity) * P.SOIL_HUMIDITY_WEIGHT + F.coalesce(_c(p24), F.lit(0.0)) / P.SOIL_RAIN_DIVISOR * P.SOIL_RAIN_WEIGHT
    return clip(raw, P.SOIL_LOW, P.SOIL_HIGH)


def season_factor(ts="datetime") -> Column:
    m = F.month(_c(ts))
    expr = None
    for months, factor in P.SEASON_FACTORS:
        cond = m.isin(*months)
        expr = F.when(cond, factor) if expr is None else expr.when(cond, factor)
    return expr


def level_change(p48="precip_48h", ts="datetime") -> Column:
    """Hourly level change from the 48 h rain band (band midpoint) times the season factor."""
    p48 = _c(p48)
    expr = None
    for limit, lo, hi in P.RAIN_BANDS:
        mid = (lo + hi) / 2
        expr = F.when(p48 > limit, mid) if expr is None else expr.when(p48 > limit, mid)
    lo, hi = P.RAIN_BAND_ELSE
    return expr.otherwise((lo + hi) / 2) * season_factor(ts)


def river_status(level="nivel_metros", status_limit="status_limit", base="base_level") -> Column:
    """critico above the station's own limit; alerta above 1.4 x base; else normal."""
    level, limit, base = _c(level), _c(status_limit), _c(base)
    normal, alerta, critico = P.STATUS_NAMES
    return (F.when(limit.isNotNull() & (level > limit), critico)
            .when(level > base * P.ALERT_FACTOR, alerta)
            .otherwise(normal))


def severity(location="location", max_level="max_water_level_m", base="base_level") -> Column:
    loc, mx, base = _c(location), _c(max_level), _c(base)
    return (F.when((loc == P.CAPITAL) & (mx > P.CAPITAL_HIGH_LEVEL), "high")
            .when(mx > base * P.HIGH_SEVERITY_FACTOR, "high")
            .otherwise("medium"))
