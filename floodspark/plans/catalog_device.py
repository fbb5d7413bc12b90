"""Catalog part 3: device telemetry, power management, JSON wire format, streaming jobs and their
batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import params as P
from ..functions import rules as R
from ..operators import telemetry as TM
from ..operators import windows as W
from ..session import scratch_path
from ..streaming import keyed as KY
from ..streaming import telemetry as ST
from . import bindings as B
from . import oracle as O
from .registry import query, r6

TL = O.with_(O.TELEMETRY, O.CALIBRATED)
PW = f""", pw AS (SELECT *, solar_voltage > 4.5 AND battery_voltage < 4.2 AS is_charging, {O.POWER_MODE} AS power_mode FROM cal)"""
INTERVAL = "CASE power_mode WHEN 'NORMAL' THEN 30 WHEN 'ECONOMY' THEN 120 WHEN 'CRITICAL' THEN 300 WHEN 'EMERGENCY' THEN 600 ELSE 30 END"


def _cal(spark, sf):
    return TM.calibrate(B.telemetry(spark, sf))


def _pw(spark, sf):
    return TM.with_power(_cal(spark, sf))


CAL_COLS = ["precipitation", "soil_moisture", "water_level", "battery_voltage", "solar_voltage"]


@query("sensor_calibration", TL + "SELECT device_id, seq, " + ", ".join(f"round({c}, 9) AS {c}" for c in CAL_COLS) + " FROM cal")
def q_sensor_calibration(spark, sf):
    return _cal(spark, sf).select("device_id", "seq", *[F.round(c, 9).alias(c) for c in CAL_COLS])


@query("sensor_defaults", TL + "SELECT device_id, seq, temperature, humidity, pressure FROM cal")
def q_sensor_defaults(spark, sf):
    return _cal(spark, sf).select("device_id", "seq", "temperature", "humidity", "pressure")


@query("power_mode", TL + PW + "SELECT device_id, seq, is_charging, power_mode FROM pw")
def q_power_mode(spark, sf):
    return _pw(spark, sf).select("device_id", "seq", "is_charging", "power_mode")


@query("power_dim", TL + PW + """SELECT seq, power_mode, d.interval_s, d.mode_description,
  CASE WHEN battery_voltage >= 4.2 THEN 'Cheia' WHEN battery_voltage >= 3.8 THEN 'Boa' WHEN battery_voltage >= 3.6 THEN 'Baixa'
       WHEN battery_voltage >= 3.3 THEN 'Crítica' ELSE 'Emergência' END AS battery_status,
  CAST(least(greatest((CAST(trunc(battery_voltage * 10) AS BIGINT) - 30) * 100 // 12, 0), 100) AS BIGINT) AS battery_percent
FROM pw LEFT JOIN (VALUES ('NORMAL', 30, 'Normal'), ('ECONOMY', 120, 'Economia'), ('CRITICAL', 300, 'Crítico'),
  ('EMERGENCY', 600, 'Emergência')) d(power_mode, interval_s, mode_description) USING (power_mode)""")
def q_power_dim(spark, sf):
    d = TM.with_power_dim(_pw(spark, sf))
    return d.select("seq", "power_mode", "interval_s", "mode_description", "battery_status",
                    F.col("battery_percent").cast("long").alias("battery_percent"))


@query("transmit_gate", TL + PW + "SELECT device_id, seq FROM pw WHERE connected AND power_mode = 'NORMAL'")
def q_transmit_gate(spark, sf):
    return TM.transmit_gate(_pw(spark, sf)).select("device_id", "seq")


@query("mode_transitions", TL + PW + """, t AS (SELECT device_id, seq, coalesce(lag(power_mode) OVER (PARTITION BY device_id ORDER BY ts, seq, seq2), 'NORMAL') AS old_mode,
  power_mode AS new_mode FROM pw) SELECT * FROM t WHERE old_mode <> new_mode""")
def q_mode_transitions(spark, sf):
    d = W.mode_transitions(_pw(spark, sf).select("device_id", "ts", "seq", "seq2", "power_mode"), "power_mode",
                           key="device_id", order=("ts", "seq", "seq2"))
    return d.select("device_id", "seq", "old_mode", "new_mode")


@query("telemetry_json", TL + PW + """SELECT device_id, ts, seq, temperature, humidity, pressure, precipitation, water_level,
  CAST(0.0 AS DOUBLE) AS water_rise_rate,
  CAST(least(1.0, CASE WHEN water_level > 3 THEN 0.4 ELSE 0.0 END + CASE WHEN precipitation > 30 THEN 0.4 ELSE 0.0 END
    + CASE WHEN water_level > 4 THEN 0.2 ELSE 0.0 END) AS DOUBLE) AS risk_score,
  CASE WHEN water_level > 4 OR precipitation > 50 THEN 3 ELSE 0 END AS alert_level,
  CASE WHEN water_level > 4 OR precipitation > 50 THEN 1 ELSE 0 END AS flood_predicted,
  battery_voltage, solar_voltage, is_charging, power_mode FROM pw""")
def q_telemetry_json(spark, sf):
    d = _pw(spark, sf).withColumn("water_rise_rate", F.lit(0.0))
    d = (d.withColumn("risk_score", R.emergency_score("water_level", "precipitation"))
         .withColumn("alert_level", R.emergency_alert("water_level", "precipitation"))
         .withColumn("flood_predicted", (F.col("alert_level") == 3).cast("int")))
    return TM.from_wire(TM.to_wire(d))


HIST_SQL = f""", h AS (SELECT device_id, ts, seq, water_level, precipitation, power_mode,
  avg(precipitation) {O.rows(12, 'ts, seq, seq2', 'device_id')} AS precipitation_ma_12,
  avg(water_level) {O.rows(12, 'ts, seq, seq2', 'device_id')} AS water_level_ma_12,
  avg(precipitation) {O.rows(24, 'ts, seq, seq2', 'device_id')} AS precipitation_ma_24,
  avg(water_level) {O.rows(24, 'ts, seq, seq2', 'device_id')} AS water_level_ma_24,
  sum(precipitation) {O.rows(24, 'ts, seq, seq2', 'device_id')} AS precip_24h,
  sum(precipitation) {O.rows(48, 'ts, seq, seq2', 'device_id')} AS precip_48h,
  CASE WHEN row_number() {O.w('device_id', 'ts, seq, seq2')} > 2
       THEN (water_level - lag(water_level) {O.w('device_id', 'ts, seq, seq2')}) / {INTERVAL} * 3600.0 ELSE 0.0 END AS water_rise_rate
  FROM pw)"""
HIST_COLS = ["precipitation_ma_12", "water_level_ma_12", "precipitation_ma_24", "water_level_ma_24", "precip_24h",
             "precip_48h", "water_rise_rate"]


def _hist_out(d):
    return d.select("device_id", "seq", *[F.round(c, 9).alias(c) for c in HIST_COLS])


@query("device_history", TL + PW + HIST_SQL + "SELECT device_id, seq, " + ", ".join(f"round({c}, 9) AS {c}" for c in HIST_COLS) + " FROM h")
def q_device_history(spark, sf):
    return _hist_out(TM.device_history(_pw(spark, sf)))


@query("device_alerts", TL + PW + HIST_SQL + f""", s AS (SELECT *, round(precip_48h, 6) AS p48r FROM h)
SELECT device_id, seq, CASE WHEN p48r > 150 OR water_level > 4 OR water_rise_rate > 0.3 THEN 1
  WHEN (CASE WHEN p48r > 50 THEN least(1.0, p48r / 150.0) * 0.4 ELSE 0.0 END
      + CASE WHEN water_level > 1 THEN least(1.0, water_level / 4.0) * 0.35 ELSE 0.0 END
      + CASE WHEN water_rise_rate > 0.05 THEN least(1.0, water_rise_rate / 0.3) * 0.25 ELSE 0.0 END) >= 0.5 THEN 1 ELSE 0 END AS flood_predicted,
  {O.alert_sql(O.risk_sql('p48r', 'water_level', 'water_rise_rate'))} AS alert_level FROM s""")
def q_device_alerts(spark, sf):
    d = TM.device_history(_pw(spark, sf)).withColumn("precip_48h", F.round("precip_48h", 6))
    return TM.score_chain(d).select("device_id", "seq", "flood_predicted", "alert_level")


# ---- streaming jobs (run to completion over the available files, then read back) ------------

LATENESS = "400 days"                    # a file of the ordered feed spans about a quarter of the table's seven years


def _in_order(spark, sf, job, name, ends_after="1 second"):
    """Run ``job`` (rows, lateness) over the telemetry as a feed of several files in event-time order."""
    rows = B.telemetry(spark, sf)
    base = scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")
    files = KY.write_feed(rows, f"{base}/feed", LATENESS, ends_after)
    feed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/feed")
    out = KY.run(job(ST.decode(feed, wire=False), LATENESS), f"{base}/job")
    return out.filter("NOT late").drop("late") if "late" in out.columns else out


@query("stream_decode", TL + PW + "SELECT device_id, seq, " + ", ".join(f"round({c}, 9) AS {c}" for c in CAL_COLS) +
       ", temperature, humidity, pressure, power_mode FROM pw")
def q_stream_decode(spark, sf):
    out = ST.run_available(ST.decode(ST.source(spark, sf)), "decode")
    return out.select("device_id", "seq", *[F.round(c, 9).alias(c) for c in CAL_COLS],
                      "temperature", "humidity", "pressure", "power_mode")


@query("stream_dedupe", TL + "SELECT DISTINCT device_id, ts FROM telemetry")
def q_stream_dedupe(spark, sf):
    return _in_order(spark, sf, ST.dedupe, "dedupe").filter("device_id IS NOT NULL").select("device_id", "ts")


@query("stream_rain_windows", TL + """, wm AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM cal),
x AS (SELECT device_id, date_trunc('hour', ts) - to_hours(k) AS window_start, precipitation
      FROM cal, range(24) r(k))
SELECT device_id, window_start, window_start + INTERVAL 24 HOUR AS window_end, round(sum(precipitation), 6) AS rain_sum, count(*) AS n
FROM x, wm WHERE window_start + INTERVAL 24 HOUR <= wm.wm GROUP BY device_id, window_start""")
def q_stream_rain_windows(spark, sf):
    out = _in_order(spark, sf, KY.rain_windows, "rain_windows", ends_after="-1 hour")
    return out.select("device_id", "window_start", "window_end", r6("rain_sum").alias("rain_sum"), "n")


@query("stream_rain_windows_batch", TL + """, x AS (SELECT device_id, date_trunc('hour', ts) - to_hours(k) AS window_start, precipitation
      FROM cal, range(24) r(k))
SELECT device_id, window_start, window_start + INTERVAL 24 HOUR AS window_end, round(sum(precipitation), 6) AS rain_sum, count(*) AS n
FROM x GROUP BY device_id, window_start""")
def q_stream_rain_windows_batch(spark, sf):
    g = W.hourly_windows(_cal(spark, sf), "device_id", "ts", "precipitation", 24)
    return g.select("device_id", "window_start", "window_end", r6("rain_sum").alias("rain_sum"), "n")


@query("stream_history", TL + PW + HIST_SQL + "SELECT device_id, seq, " + ", ".join(f"round({c}, 9) AS {c}" for c in HIST_COLS) + " FROM h")
def q_stream_history(spark, sf):
    return _hist_out(_in_order(spark, sf, KY.history, "history"))


@query("stream_alerts", TL + PW + HIST_SQL + f""", s AS (SELECT *, round(precip_48h, 6) AS p48r FROM h)
SELECT device_id, seq, CASE WHEN p48r > 150 OR water_level > 4 OR water_rise_rate > 0.3 THEN 1
  WHEN (CASE WHEN p48r > 50 THEN least(1.0, p48r / 150.0) * 0.4 ELSE 0.0 END
      + CASE WHEN water_level > 1 THEN least(1.0, water_level / 4.0) * 0.35 ELSE 0.0 END
      + CASE WHEN water_rise_rate > 0.05 THEN least(1.0, water_rise_rate / 0.3) * 0.25 ELSE 0.0 END) >= 0.5 THEN 1 ELSE 0 END AS flood_predicted,
  {O.alert_sql(O.risk_sql('p48r', 'water_level', 'water_rise_rate'))} AS alert_level FROM s""")
def q_stream_alerts(spark, sf):
    return _in_order(spark, sf, KY.alerts, "alerts").select("device_id", "seq", "flood_predicted", "alert_level")


@query("stream_mode_changes", TL + PW + """, t AS (SELECT device_id, seq, coalesce(lag(power_mode) OVER (PARTITION BY device_id ORDER BY ts, seq, seq2), 'NORMAL') AS old_mode,
  power_mode AS new_mode FROM pw) SELECT * FROM t WHERE old_mode <> new_mode""")
def q_stream_mode_changes(spark, sf):
    return _in_order(spark, sf, KY.mode_changes, "mode_changes").select("device_id", "seq", "old_mode", "new_mode")
