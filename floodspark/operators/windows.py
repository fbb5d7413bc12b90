"""Row-window features per station (rolling sums, means, std, lags, fills, device history),
all on the skew-safe frames of :mod:`floodspark.operators.frames`."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.calendar import hours_between
from . import frames as FR

KEY = "location"
ORDER = ("datetime", "seq")


def rain_window_specs(col: str = "precipitation_mm", sizes: Sequence[int] = P.WINDOWS) -> dict:
    return {f"precip_{n}h": FR.rolling_sum(col, n) for n in sizes}


def moving_mean_specs(cols: Sequence[str], sizes: Sequence[int] = P.MA_WINDOWS) -> dict:
    return {f"{c}_ma_{n}h": FR.rolling_mean_full(c, n) for c in cols for n in sizes}


def moving_std_specs(cols: Sequence[str], sizes: Sequence[int] = P.STD_WINDOWS) -> dict:
    return {f"{c}_std_{n}h": FR.rolling_std_full(c, n) for c in cols for n in sizes}


def diff_specs(cols: Sequence[str], lags: Sequence[int] = P.DIFF_LAGS) -> dict:
    out = {}
    for c in cols:
        for n in lags:
            out[f"{c}_diff" if n == 1 else f"{c}_diff_{n}h"] = FR.diff(c, n)
    return out


def feature_window_specs(columns: Sequence[str]) -> dict:
    """All window features of the feature table, for the columns that exist."""
    have = set(columns)
    specs = {}
    if "precipitation_mm" in have:
        specs.update(rain_window_specs())
    specs.update(moving_mean_specs([c for c in ("precipitation_mm", "nivel_metros") if c in have]))
    specs.update(moving_std_specs([c for c in ("precipitation_mm", "nivel_metros") if c in have]))
    specs.update(diff_specs([c for c in ("precipitation_mm", "nivel_metros", "temperature_c") if c in have]))
    if "taxa_subida_m_h" in have:
        specs["aceleracao_nivel"] = FR.diff("taxa_subida_m_h", 1)
    return specs


def with_windows(df: DataFrame, specs: dict, key=KEY, order: Sequence[str] = ORDER) -> DataFrame:
    return FR.with_row_features(df, key, order, specs)


def rolling_sum(df: DataFrame, col: str = "precipitation_mm", sizes=P.WINDOWS, key=KEY, order=ORDER) -> DataFrame:
    return with_windows(df, rain_window_specs(col, sizes), key, order)


def rolling_mean(df: DataFrame, cols=("precipitation_mm", "nivel_metros"), sizes=P.MA_WINDOWS,
                 key=KEY, order=ORDER) -> DataFrame:
    return with_windows(df, moving_mean_specs(cols, sizes), key, order)


def rolling_std(df: DataFrame, cols=("precipitation_mm", "nivel_metros"), sizes=P.STD_WINDOWS,
                key=KEY, order=ORDER) -> DataFrame:
    return with_windows(df, moving_std_specs(cols, sizes), key, order)


def lag_diff(df: DataFrame, cols=("precipitation_mm", "nivel_metros", "temperature_c"), lags=P.DIFF_LAGS,
             key=KEY, order=ORDER) -> DataFrame:
    return with_windows(df, diff_specs(cols, lags), key, order)


def level_acceleration(df: DataFrame, rise: str = "taxa_subida_m_h", key=KEY, order=ORDER) -> DataFrame:
    return with_windows(df, {"aceleracao_nivel": FR.diff(rise, 1)}, key, order)


def gap_fill(df: DataFrame, cols: Sequence[str], key=KEY, order=ORDER, default=0) -> DataFrame:
    """Forward fill, then backward fill, then ``default`` - per station, never across stations."""
    return FR.fill_forward_backward(df, key, order, cols, default)


def device_rise_rate(df: DataFrame, level: str = "nivel_metros", interval_s: float = 30.0,
                     key=KEY, order=ORDER, out: str = "water_rise_rate") -> DataFrame:
    """(level - previous level) / nominal interval x 3600; 0 until two earlier readings exist."""
    spec = {"_prev": FR.lag_value(level, 1)}
    d = FR.with_row_features(df, key, order, spec, keep_position=True)
    rate = (F.col(level) - F.col("_prev")) / float(interval_s) * 3600.0
    return d.withColumn(out, F.when(F.col(FR.POS) >= 2, rate).otherwise(F.lit(0.0))).drop("_prev", FR.POS)


def history_means(df: DataFrame, rain: str = "precipitation_mm", level: str = "nivel_metros",
                  key=KEY, order=ORDER) -> DataFrame:
    """Device history: means over the last <= 12 / <= 24 readings (current included, using what
    exists) and the 24-reading rain sum."""
    specs = {
        f"{rain}_ma_12h": FR.rolling_mean_partial(rain, 12),
        f"{level}_ma_12h": FR.rolling_mean_partial(level, 12),
        f"{rain}_ma_24h": FR.rolling_mean_partial(rain, 24),
        f"{level}_ma_24h": FR.rolling_mean_partial(level, 24),
        "precip_24h": FR.rolling_sum(rain, 24),
    }
    return with_windows(df, specs, key, order)


def mode_transitions(df: DataFrame, mode: str = "power_mode", initial: str = "NORMAL",
                     key=KEY, order=ORDER) -> DataFrame:
    """Rows where the mode differs from the previous reading's mode (the first reading is compared
    with ``initial``), with the old and new mode."""
    d = FR.with_row_features(df, key, order, {"_prev_mode": FR.lag_value(mode, 1)})
    d = d.withColumn("old_mode", F.coalesce(F.col("_prev_mode"), F.lit(initial))).drop("_prev_mode")
    return d.filter(F.col("old_mode") != F.col(mode)).withColumnRenamed(mode, "new_mode")


def run_progress(df: DataFrame, key: str = "cenario", order: Sequence[str] = ("timestamp", "seq"),
                 ts: str = "timestamp") -> DataFrame:
    """Position in the run, progress percent floor(100 * i / n) and hours since the run's start."""
    d = FR.position_and_count(df, key, order, pos="_pos1", count="_n", totals={"_t0": (F.min(ts), F.min)})
    return (d.withColumn("step", F.col("_pos1") - 1)
            .withColumn("progress_pct", F.expr("CAST(floor(100 * (_pos1 - 1) / _n) AS INT)"))
            .withColumn("hora_simulacao", hours_between("_t0", ts))
            .drop("_pos1", "_n", "_t0"))


def hourly_windows(df: DataFrame, key: str, ts: str, col: str, hours: int) -> DataFrame:
    """Sum of ``col`` and count of rows per key over windows of ``hours`` hours, one an hour: (key, window_start, window_end,
    rain_sum, n) of the windows that hold a row. Rows without a time are in none.

    Rows are summed per key and hour first. An hour is then sent to the at most two spans of ``hours`` window starts that it
    counts in; a span's hours (fewer than 2 x ``hours``) are one array, from which its windows are made in place, so no shuffle
    holds a row once per window."""
    return slide_hours(hourly_sums(df, key, ts, col), key, hours)


def hourly_sums(df: DataFrame, key: str, ts: str, col: str, *more) -> DataFrame:
    """(key, _h, _sum, _n): sum of ``col`` and count of rows per key and hour since 1970, and what ``more`` aggregates. Rows without
    a time are in none."""
    hour = F.expr(f"timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', date_trunc('hour', CAST({ts} AS TIMESTAMP_NTZ)))")
    return (df.filter(F.col(ts).isNotNull()).groupBy(key, hour.alias("_h"))
            .agg(F.sum(col).alias("_sum"), F.count(F.lit(1)).alias("_n"), *more))


def slide_hours(panes: DataFrame, key: str, hours: int) -> DataFrame:
    """The windows of ``hourly_windows`` from hourly sums (one row per key and hour)."""
    first, last = (F.floor((F.col("_h") - back) / hours) for back in (hours - 1, 0))
    spans = (panes.withColumn("_span", F.explode(F.sequence(first, last))).groupBy(key, "_span")
             .agg(F.collect_list(F.struct("_h", "_sum", "_n")).alias("_panes")))

    # the sum changes only where an hour enters or leaves: it is made once for every run of starts between two such places
    low = F.col("_span") * hours
    places = F.flatten(F.transform("_panes", lambda p: F.array(p["_h"] - (hours - 1), p["_h"] + 1)))
    places = F.concat(F.array(low), F.filter(places, lambda s: (s > low) & (s < low + hours)))
    spans = spans.withColumn("_starts", F.array_sort(F.array_distinct(places)))

    def run(start, i):
        inside = F.filter("_panes", lambda p: (p["_h"] >= start) & (p["_h"] < start + hours))
        known = F.filter(inside, lambda p: p["_sum"].isNotNull())
        total = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast("double"), lambda a, p: a + p["_sum"]))
        last = F.coalesce(F.get("_starts", i + 1), low + hours) - 1
        return F.struct(start.alias("start"), last.alias("last"), total.alias("rain_sum"), F.aggregate(inside, F.lit(0).cast("long"), lambda a, p: a + p["_n"]).alias("n"))
    d = spans.select(key, F.explode(F.transform("_starts", run)).alias("_w")).filter("_w.n > 0")
    d = d.select(key, "_w.rain_sum", "_w.n", F.explode(F.sequence("_w.start", "_w.last")).alias("_start"))
    at = "TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, CAST({} AS INT), 0, 0)"
    return d.select(key, F.expr(at.format("_start")).alias("window_start"), F.expr(at.format(f"(_start + {hours})")).alias("window_end"), "rain_sum", "n")
