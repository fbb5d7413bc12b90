"""River levels, flood events and interval labels."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import physics as PH
from ..functions.calendar import hours_between
from . import frames as FR
from .joins import name_match, station_lookup
from .windows import KEY, ORDER


def river_levels(readings: DataFrame, key: str = KEY, order: Sequence[str] = ORDER,
                 rain: str = "precipitation_mm") -> DataFrame:
    """Deterministic river level per reading.

    48-row rain sum -> level change (band midpoint x season) -> floored running total from the
    station's base level (never below 0.5 m) -> level rounded to 2 dp -> rise = level minus the
    previous rounded level (first 0), 3 dp -> status against the station limits.
    One position index is shared by the three window passes."""
    d = FR.row_index(readings, key, order)
    d = FR.with_row_features(d, key, order, {"_p48": FR.rolling_sum(rain, 48)}, keep_position=True)
    d = d.withColumn("_chg", PH.level_change("_p48", "datetime"))
    d = station_lookup(d, key)
    d = FR.floored_running_total(d, key, order, "_chg", "base_level", P.LEVEL_FLOOR, "_lvl", keep_position=True)
    d = d.withColumn("nivel_metros", F.round("_lvl", 2))
    d = FR.with_row_features(d, key, order, {"_prev": FR.lag_value("nivel_metros", 1)})
    d = d.withColumn("taxa_subida_m_h",
                     F.when(F.col("_prev").isNull(), F.lit(0.0)).otherwise(F.round(F.col("_lvl") - F.col("_prev"), 3)))
    d = d.withColumn("status", PH.river_status("nivel_metros", "status_limit", "base_level"))
    return d.select(*readings.columns, "rio_principal", "nivel_metros", "taxa_subida_m_h", "status")


def flood_events(rivers: DataFrame, key: str = KEY, level: str = "nivel_metros",
                 ts: str = "datetime") -> DataFrame:
    """One event per station with more than 24 readings above its event limit.

    Filter, then a grouped aggregate with map-side partial aggregation (a hot station is reduced
    before the shuffle)."""
    d = station_lookup(rivers.select(key, ts, level), key)
    crit = d.filter(F.col(level) > F.col("event_limit"))
    g = crit.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_first"),
                              F.max(level).alias("_max"), F.first("base_level").alias("base_level"),
                              F.first("rio_principal").alias("rio_principal"))
    g = g.filter(F.col("_n") > P.EVENT_MIN_ROWS)
    sev = PH.severity(key, "_max", "base_level")
    return g.select(
        F.date_format("_first", "yyyy-MM-dd").alias("date"),
        F.col(key).alias("location"),
        "rio_principal",
        (F.expr(f"_n div {P.EVENT_MIN_ROWS}") + 1).cast("int").alias("duration_days"),
        sev.alias("severity"),
        F.round("_max", 2).alias("max_water_level_m"),
        (sev == "high").alias("emergency_declared"),
        F.lit(P.EVENT_SOURCE).alias("source"),
    )


def flood_label(readings: DataFrame, events: DataFrame, key: str = KEY, ts: str = "datetime",
                row_id: str = "seq", event_no: str = "event_no", event_text: str = "location_text",
                event_date: str = "date", duration: str | None = "duration_days") -> DataFrame:
    """Label readings from flood reports.

    A report names a place in free text; it belongs to the smallest station name contained in it
    (case-blind). A reading is labelled when it lies in [date - 72 h, date + duration days] (both
    ends included; 3 days when there is no duration). When several reports cover a reading, the
    last report (highest ``event_no``) sets hours-to-event and the alert level.

    Plan: name match (equi-join on substrings) -> reports exploded to the days they cover, the last
    report per covered part of a day -> equi-join on (station, day) + exact bound check -> max_by per reading -> left join back."""
    names = readings.select(key).distinct()
    matched = name_match(events, names, event_text, event_no, key)
    dur = F.coalesce(F.col(duration), F.lit(P.DEFAULT_EVENT_DAYS)) if duration and duration in events.columns \
        else F.lit(P.DEFAULT_EVENT_DAYS)
    ev = (events.select(event_no, F.col(event_date).cast("timestamp_ntz").alias("_date"), dur.alias("_dur"))
          .join(matched, [event_no]))
    ev = (ev.withColumn("_start", F.col("_date") - F.expr(f"INTERVAL {P.PRE_EVENT_HOURS} HOURS"))
          .withColumn("_end", F.col("_date") + F.make_dt_interval(F.col("_dur")))
          .withColumn("_day", F.explode(F.sequence(F.to_date("_start"), F.to_date("_end")))))
    # Of reports that cover the same part of a day only the last can win: with day dates at most two
    # rows are left per (station, day), so the join below grows with the readings alone.
    day = F.col("_day").cast("timestamp_ntz")
    ev = (ev.withColumn("_start", F.greatest("_start", day))
          .withColumn("_end", F.least(F.col("_end"), day + F.expr("INTERVAL 1 DAY")))
          .groupBy(key, "_day", "_start", "_end")
          .agg(F.max_by("_date", event_no).alias("_date"), F.max(event_no).alias(event_no)))
    r = readings.select(key, row_id, ts).withColumn("_day", F.to_date(ts))
    hits = (r.join(ev, [key, "_day"])
            .filter((F.col(ts) >= F.col("_start")) & (F.col(ts) <= F.col("_end"))))
    last = hits.groupBy(key, row_id).agg(
        F.max_by(F.struct(F.col("_date"), F.col(ts)), F.col(event_no)).alias("_ev"))
    last = last.select(key, row_id, F.lit(1).alias("_hit"),
                       hours_between(F.col(f"_ev.{ts}"), F.col("_ev._date")).alias("tempo_ate_enchente"))
    out = readings.join(last, [key, row_id], "left")
    h48, h24 = P.ALERT_HOURS
    t = F.col("tempo_ate_enchente")
    return (out.withColumn("teve_enchente", F.coalesce(F.col("_hit"), F.lit(0)))
            .withColumn("nivel_alerta", F.when(F.col("_hit").isNull(), 0)
                        .when(t > h48, 1).when(t > h24, 2).otherwise(3))
            .drop("_hit"))
