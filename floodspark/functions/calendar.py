"""Calendar parts and cyclic encodings (Monday = 0 for the week day)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def calendar_parts(ts="datetime") -> dict[str, Column]:
    ts = _c(ts)
    return {
        "hora": F.hour(ts),
        "dia_semana": F.weekday(ts),
        "mes": F.month(ts),
        "dia_mes": F.dayofmonth(ts),
        "trimestre": F.quarter(ts),
    }


def cyclic(value, period: float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * _c(value) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def cyclic_parts(ts="datetime") -> dict[str, Column]:
    ts = _c(ts)
    hs, hc = cyclic(F.hour(ts), 24)
    ms, mc = cyclic(F.month(ts), 12)
    ws, wc = cyclic(F.weekday(ts), 7)
    return {"hora_sin": hs, "hora_cos": hc, "mes_sin": ms, "mes_cos": mc,
            "dia_semana_sin": ws, "dia_semana_cos": wc}


def hours_between(start, end) -> Column:
    """(end - start) in hours, exact to the microsecond, without a time-zone conversion."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / 3.6e9


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 of a local (zone-less) timestamp, without a time-zone conversion."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(ts))
