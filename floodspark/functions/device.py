"""Device-side logic as column expressions: sensor calibration and defaults, power management,
cold-start feature estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P
from .physics import clip


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def adc_scale(raw, out_hi: int) -> Column:
    """``map(raw, 0, 4095, 0, out_hi)`` with integer truncation."""
    return F.expr(f"CAST(({_sql(raw)} * {out_hi}) div {P.ADC_MAX} AS INT)")


def _sql(x) -> str:
    if isinstance(x, str):
        return f"`{x}`"
    raise TypeError("adc_scale takes a column name")


def rain_from_adc(raw="rain_raw") -> Column:
    """mm/h = map(raw, 0..4095 -> 0..100) / 10, never negative."""
    return F.greatest(adc_scale(raw, 100) / 10.0, F.lit(0.0))


def soil_from_adc(raw="soil_raw") -> Column:
    return adc_scale(raw, 100).cast("double")


def level_from_echo(echo_us="echo_us") -> Column:
    """Echo time (us) -> distance (cm) -> water level (m) below the sensor height, clipped to
    0..10 m; a timeout (0 us) reads as 1.0 m."""
    e = _c(echo_us).cast("double")
    dist = e * P.SOUND_CM_PER_US / 2
    level = (F.lit(P.SENSOR_HEIGHT_CM) - dist) / 100.0
    lo, hi = P.LEVEL_RANGE
    return F.when(e == 0, P.LEVEL_ON_TIMEOUT).otherwise(clip(level, lo, hi))


def divider_voltage(raw, factor: float) -> Column:
    return _c(raw).cast("double") * P.ADC_VREF / float(P.ADC_MAX) * factor


def battery_voltage(raw="battery_raw") -> Column:
    return divider_voltage(raw, P.BATTERY_DIVIDER)


def solar_voltage(raw="solar_raw") -> Column:
    return divider_voltage(raw, P.SOLAR_DIVIDER)


def sensor_defaults(temperature="temperature", humidity="humidity", pressure="pressure") -> dict[str, Column]:
    """NULL/NaN temperature -> 25, humidity -> 60; pressure outside 800..1200 hPa -> 1013.25."""
    t = F.nanvl(_c(temperature).cast("double"), F.lit(None).cast("double"))
    h = F.nanvl(_c(humidity).cast("double"), F.lit(None).cast("double"))
    p = _c(pressure).cast("double")
    lo, hi = P.PRESSURE_VALID
    return {
        "temperature": F.coalesce(t, F.lit(P.DEFAULT_TEMPERATURE)),
        "humidity": F.coalesce(h, F.lit(P.DEFAULT_HUMIDITY)),
        "pressure": F.when(p.isNull() | F.isnan(p) | (p < lo) | (p > hi), P.DEFAULT_PRESSURE).otherwise(p),
    }


def is_charging(battery="battery_voltage", solar="solar_voltage") -> Column:
    return (_c(solar) > P.SOLAR_CHARGING) & (_c(battery) < P.BATTERY_FULL)


def power_mode(battery="battery_voltage", solar="solar_voltage") -> Column:
    b, s = _c(battery), _c(solar)
    by_battery = (F.when(b >= P.BATTERY_GOOD, "NORMAL")
                  .when(b >= P.BATTERY_LOW, "ECONOMY")
                  .when(b >= P.BATTERY_CRITICAL, "CRITICAL")
                  .otherwise("EMERGENCY"))
    return F.when(is_charging(b, s) & (s > P.SOLAR_STRONG), "NORMAL").otherwise(by_battery)


def battery_status(battery="battery_voltage") -> Column:
    b = _c(battery)
    expr = None
    for cut, name in P.BATTERY_STATUS:
        expr = F.when(b >= cut, name) if expr is None else expr.when(b >= cut, name)
    return expr.otherwise(P.BATTERY_STATUS_ELSE)


def battery_percent(battery="battery_voltage") -> Column:
    """map(V*10, 30..42 -> 0..100) truncated, then clipped to 0..100."""
    pct = F.expr(f"(CAST({_sql(battery)} * 10 AS BIGINT) - 30) * 100 div 12")
    return F.least(F.greatest(pct, F.lit(0)), F.lit(100))


def cold_start(col_values: dict[str, Column] | None = None) -> dict[str, Column]:
    """Estimates used when no history exists: fixed fractions of the current reading."""
    out = {}
    for name, src, factor in P.COLD_START:
        out[name] = F.col(src) * factor
    out["pressao_normalizada"] = (F.col("pressure_hpa") - P.PRESSURE_REFERENCE) / P.PRESSURE_SCALE
    out["precip_24h"] = F.col("precipitation_mm") * 24
    out["precip_48h"] = F.col("precipitation_mm") * 24 * 2
    return out


def with_cold_start(df):
    """The estimates where a frame lacks a window feature or has no value for it yet; other values stay."""
    return df.withColumns({n: F.coalesce(F.col(n), c) if n in df.columns else c for n, c in cold_start().items()})
