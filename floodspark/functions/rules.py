"""Alert rules as column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flood_rule(p48="precip_48h", level="nivel_metros", rise="taxa_subida_m_h",
               threshold: float = P.RULE_THRESHOLD) -> Column:
    """1 if any critical limit is passed, else 1 if the gated weighted sum reaches ``threshold``."""
    p48, level, rise = _c(p48), _c(level), _c(rise)
    critical = (p48 > P.RULE_P48_CRITICAL) | (level > P.RULE_LEVEL_CRITICAL) | (rise > P.RULE_RISE_CRITICAL)
    parts = []
    for (name, gate, div, weight), col in zip(P.RULE_GATES, (p48, level, rise)):
        parts.append(F.when(col > gate, F.least(F.lit(1.0), col / div) * weight).otherwise(F.lit(0.0)))
    score = parts[0] + parts[1] + parts[2]
    return F.when(critical, 1).when(score >= threshold, 1).otherwise(0)


def gated_rule_score(p48="precip_48h", level="nivel_metros", rise="taxa_subida_m_h") -> Column:
    p48, level, rise = _c(p48), _c(level), _c(rise)
    parts = [F.when(col > gate, F.least(F.lit(1.0), col / div) * weight).otherwise(F.lit(0.0))
             for (name, gate, div, weight), col in zip(P.RULE_GATES, (p48, level, rise))]
    return parts[0] + parts[1] + parts[2]


def risk_score(p48="precip_48h", level="nivel_metros", rise="taxa_subida_m_h") -> Column:
    """s = sum(weight * min(1, x / divisor)); returned as s / (1 + |1 - s|). No lower clip."""
    cols = (_c(p48), _c(level), _c(rise))
    s = None
    for (name, div, weight), col in zip(P.SCORE_PARTS, cols):
        term = F.least(F.lit(1.0), col / div) * weight
        s = term if s is None else s + term
    return s / (F.lit(1.0) + F.abs(F.lit(1.0) - s))


def alert_level(score) -> Column:
    """>= .8 -> 3, >= .6 -> 2, >= .4 -> 1, else 0 (a missing score compares false: 0)."""
    score = _c(score)
    expr = None
    for cut, lvl in P.ALERT_CUTS:
        expr = F.when(score >= cut, lvl) if expr is None else expr.when(score >= cut, lvl)
    return expr.otherwise(0)


def alert_name(level) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in P.ALERT_NAMES]), _c(level) + 1)


def alert_description(level) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in P.ALERT_DESCRIPTIONS]), _c(level) + 1)


def valid_features(p48="precip_48h", level="nivel_metros", rise="taxa_subida_m_h") -> Column:
    conds = [_c(c).between(lo, hi) for (name, lo, hi), c in zip(P.VALID_RANGES, (p48, level, rise))]
    return conds[0] & conds[1] & conds[2]


def mode_prediction(prob, threshold) -> Column:
    return (_c(prob) >= _c(threshold)).cast("int")


def mode_level(prob, threshold) -> Column:
    """Level 3 / 2 / 1 when the probability reaches 1.5x / 1.2x / 1x the mode threshold."""
    prob, threshold = _c(prob), _c(threshold)
    expr = None
    for factor, lvl in P.MODE_LEVEL_FACTORS:
        cond = prob >= threshold * factor
        expr = F.when(cond, lvl) if expr is None else expr.when(cond, lvl)
    return expr.otherwise(0)


def confidence(prob) -> Column:
    return F.abs(_c(prob) - 0.5) * 2


def emergency_alert(level="nivel_metros", rain="precipitation_mm") -> Column:
    level, rain = _c(level), _c(rain)
    return F.when((level > P.RULE_LEVEL_CRITICAL) | (rain > P.EMERGENCY_RAIN_CRITICAL), 3).otherwise(0)


def emergency_score(level="nivel_metros", rain="precipitation_mm") -> Column:
    level, rain = _c(level), _c(rain)
    w_high, w_rain, w_crit = P.EMERGENCY_WEIGHTS
    s = (F.when(level > P.RULE_LEVEL_HIGH, w_high).otherwise(0.0)
         + F.when(rain > P.EMERGENCY_RAIN_HIGH, w_rain).otherwise(0.0)
         + F.when(level > P.RULE_LEVEL_CRITICAL, w_crit).otherwise(0.0))
    return F.least(F.lit(1.0), s)
