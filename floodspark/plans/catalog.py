"""Query catalog: every operator of the inventory bound to the test tables.

Each entry is a Spark plan ``(spark, sf_dir) -> DataFrame`` built only from library operators, and
(where SQL can state it) the same computation as DuckDB SQL over the raw tables. Float outputs that
are sums of many terms are rounded to 6 decimals on both sides so summation order cannot matter.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..functions import calendar as CAL
from ..functions import parsing as PA
from ..functions import physics as PH
from ..functions import rules as R
from ..operators import clean as CL
from ..operators import features as FE
from ..operators import joins as J
from ..operators import labels as LB
from ..operators import metrics as M
from ..operators import windows as W
from . import bindings as B
from . import oracle as O

from .registry import QUERIES, SQL, query, r6  # noqa: F401


RD = O.with_(O.READINGS)

# ---------------------------------------------------------------------------------------------
# flagship: readings -> 48-row rain sum -> risk score -> alert level -> distribution


@query("alert_distribution", RD + f""", f AS (
  SELECT *, round(SUM(precipitation_mm) {O.rows(48)}, 4) AS precip_48h FROM readings),
lv AS (SELECT {O.alert_sql(O.risk_sql())} AS alert_level FROM f)
SELECT d.alert_level, d.alert_name, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
       round(coalesce(c.n, 0) * 100.0 / (SELECT count(*) FROM lv), 4) AS pct
FROM (VALUES (0, 'VERDE'), (1, 'AMARELO'), (2, 'LARANJA'), (3, 'VERMELHO')) d(alert_level, alert_name)
LEFT JOIN (SELECT alert_level, count(*) AS n FROM lv GROUP BY 1) c USING (alert_level)""")
def q_alert_distribution(spark, sf):
    d = W.rolling_sum(B.readings(spark, sf), sizes=(48,)).withColumn("precip_48h", F.round("precip_48h", 4))
    d = d.withColumn("alert_level", R.alert_level(R.risk_score()))
    return M.alert_distribution(d, "alert_level")


# ---------------------------------------------------------------------------------------------
# 2.5 windows

@query("rolling_sum", RD + f"""SELECT location, seq,
  round(SUM(precipitation_mm) {O.rows(24)}, 6) AS precip_24h,
  round(SUM(precipitation_mm) {O.rows(48)}, 6) AS precip_48h,
  round(SUM(precipitation_mm) {O.rows(72)}, 6) AS precip_72h FROM readings""")
def q_rolling_sum(spark, sf):
    d = W.rolling_sum(B.readings(spark, sf))
    return d.select("location", "seq", *[r6(f"precip_{n}h").alias(f"precip_{n}h") for n in P.WINDOWS])


def _ma_sql(c, n):
    return f"round(CASE WHEN count({c}) {O.rows(n)} = {n} THEN avg({c}) {O.rows(n)} END, 6) AS {c}_ma_{n}h"


def _std_sql(c, n):
    return f"round(CASE WHEN count({c}) {O.rows(n)} = {n} THEN stddev_samp({c}) {O.rows(n)} END, 6) AS {c}_std_{n}h"


@query("rolling_mean", RD + "SELECT location, seq, " + ", ".join(
    _ma_sql(c, n) for c in ("precipitation_mm", "nivel_metros") for n in P.MA_WINDOWS) + " FROM readings")
def q_rolling_mean(spark, sf):
    d = W.rolling_mean(B.readings(spark, sf))
    cols = [f"{c}_ma_{n}h" for c in ("precipitation_mm", "nivel_metros") for n in P.MA_WINDOWS]
    return d.select("location", "seq", *[r6(c).alias(c) for c in cols])


@query("rolling_std", RD + "SELECT location, seq, " + ", ".join(
    _std_sql(c, n) for c in ("precipitation_mm", "nivel_metros") for n in P.STD_WINDOWS) + " FROM readings")
def q_rolling_std(spark, sf):
    d = W.rolling_std(B.readings(spark, sf))
    cols = [f"{c}_std_{n}h" for c in ("precipitation_mm", "nivel_metros") for n in P.STD_WINDOWS]
    return d.select("location", "seq", *[r6(c).alias(c) for c in cols])


@query("lag_diff", RD + "SELECT location, seq, " + ", ".join(
    f"round({c} - lag({c}, {n}) {O.w()}, 6) AS {c}_diff{'' if n == 1 else f'_{n}h'}"
    for c in ("precipitation_mm", "nivel_metros", "temperature_c") for n in P.DIFF_LAGS) + " FROM readings")
def q_lag_diff(spark, sf):
    d = W.lag_diff(B.readings(spark, sf))
    cols = [f"{c}_diff{'' if n == 1 else f'_{n}h'}" for c in ("precipitation_mm", "nivel_metros", "temperature_c")
            for n in P.DIFF_LAGS]
    return d.select("location", "seq", *[r6(c).alias(c) for c in cols])


@query("level_acceleration", RD + f"""SELECT location, seq,
  round(taxa_subida_m_h - lag(taxa_subida_m_h) {O.w()}, 6) AS aceleracao_nivel FROM readings""")
def q_level_acceleration(spark, sf):
    d = W.level_acceleration(B.readings(spark, sf))
    return d.select("location", "seq", r6("aceleracao_nivel").alias("aceleracao_nivel"))


@query("gap_fill", RD + """SELECT location, seq, coalesce(
  last_value(precipitation_mm IGNORE NULLS) OVER (PARTITION BY location ORDER BY datetime, seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(precipitation_mm IGNORE NULLS) OVER (PARTITION BY location ORDER BY datetime, seq
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS precipitation_mm FROM readings""")
def q_gap_fill(spark, sf):
    d = W.gap_fill(B.readings(spark, sf).select("location", "datetime", "seq", "precipitation_mm"),
                   ["precipitation_mm"])
    return d.select("location", "seq", F.col("precipitation_mm").cast("double").alias("precipitation_mm"))


@query("dedupe_first", RD + """SELECT location, hour_ts AS datetime, seq, precipitation_mm, nivel_metros FROM (
  SELECT location, date_trunc('hour', datetime) AS hour_ts, seq, precipitation_mm, nivel_metros,
         row_number() OVER (PARTITION BY location, date_trunc('hour', datetime) ORDER BY seq) AS rn
  FROM readings) WHERE rn = 1""")
def q_dedupe_first(spark, sf):
    r = B.readings(spark, sf).select("location", F.date_trunc("hour", "datetime").cast("timestamp_ntz").alias("datetime"),
                                     "seq", "precipitation_mm", "nivel_metros")
    return CL.dedupe_first(r, ["location", "datetime"], ["seq"])


@query("history_means", RD + f"""SELECT location, seq,
  round(avg(precipitation_mm) {O.rows(12)}, 6) AS precipitation_mm_ma_12h,
  round(avg(nivel_metros) {O.rows(12)}, 6) AS nivel_metros_ma_12h,
  round(avg(precipitation_mm) {O.rows(24)}, 6) AS precipitation_mm_ma_24h,
  round(avg(nivel_metros) {O.rows(24)}, 6) AS nivel_metros_ma_24h,
  round(sum(precipitation_mm) {O.rows(24)}, 6) AS precip_24h FROM readings""")
def q_history_means(spark, sf):
    d = W.history_means(B.readings(spark, sf))
    cols = ["precipitation_mm_ma_12h", "nivel_metros_ma_12h", "precipitation_mm_ma_24h", "nivel_metros_ma_24h",
            "precip_24h"]
    return d.select("location", "seq", *[r6(c).alias(c) for c in cols])


@query("rise_rate", RD + f"""SELECT location, seq, round(CASE WHEN row_number() {O.w()} > 2
  THEN (nivel_metros - lag(nivel_metros) {O.w()}) / 30.0 * 3600.0 ELSE 0.0 END, 6) AS water_rise_rate FROM readings""")
def q_rise_rate(spark, sf):
    d = W.device_rise_rate(B.readings(spark, sf))
    return d.select("location", "seq", r6("water_rise_rate").alias("water_rise_rate"))


# ---------------------------------------------------------------------------------------------
# 2.8 scalar functions on readings

@query("calendar_parts", RD + """SELECT seq, CAST(hour(datetime) AS INTEGER) AS hora,
  CAST(isodow(datetime) - 1 AS INTEGER) AS dia_semana, CAST(month(datetime) AS INTEGER) AS mes,
  CAST(day(datetime) AS INTEGER) AS dia_mes, CAST(quarter(datetime) AS INTEGER) AS trimestre FROM readings""")
def q_calendar_parts(spark, sf):
    r = B.readings(spark, sf)
    return r.select("seq", *[c.alias(n) for n, c in CAL.calendar_parts("datetime").items()])


@query("cyclic_encoding", RD + """SELECT seq,
  round(sin(2 * pi() * hour(datetime) / 24), 6) AS hora_sin, round(cos(2 * pi() * hour(datetime) / 24), 6) AS hora_cos,
  round(sin(2 * pi() * month(datetime) / 12), 6) AS mes_sin, round(cos(2 * pi() * month(datetime) / 12), 6) AS mes_cos,
  round(sin(2 * pi() * (isodow(datetime) - 1) / 7), 6) AS dia_semana_sin,
  round(cos(2 * pi() * (isodow(datetime) - 1) / 7), 6) AS dia_semana_cos FROM readings""")
def q_cyclic_encoding(spark, sf):
    r = B.readings(spark, sf)
    return r.select("seq", *[r6(c).alias(n) for n, c in CAL.cyclic_parts("datetime").items()])


@query("soil_moisture", RD + f""", f AS (SELECT *, SUM(precipitation_mm) {O.rows(24)} AS precip_24h FROM readings)
SELECT location, seq, round(CASE WHEN humidity_pct IS NULL THEN NULL ELSE
  least(greatest(humidity_pct * 0.6 + coalesce(precip_24h, 0) / 50.0 * 40.0, 20.0), 95.0) END, 6) AS soil_moisture_pct
FROM f""")
def q_soil_moisture(spark, sf):
    d = W.rolling_sum(B.readings(spark, sf), sizes=(24,))
    return d.select("location", "seq", r6(PH.soil_moisture("humidity_pct", "precip_24h")).alias("soil_moisture_pct"))


def _feat_sql():
    return RD + f""", f AS (SELECT *, round(SUM(precipitation_mm) {O.rows(48)}, 4) AS precip_48h,
  round(SUM(precipitation_mm) {O.rows(72)}, 4) AS precip_72h FROM readings)"""


def _feat(spark, sf):
    """48/72-row rain sums, rounded to the 4 decimals their inputs carry (exact sums)."""
    d = W.rolling_sum(B.readings(spark, sf), sizes=(48, 72))
    return d.withColumn("precip_48h", F.round("precip_48h", 4)).withColumn("precip_72h", F.round("precip_72h", 4))


@query("saturation_index", _feat_sql() + """SELECT location, seq,
  round(soil_moisture_pct * 0.5 + (precip_72h / (SELECT max(precip_72h) FROM f)) * 50, 6) AS indice_saturacao FROM f""")
def q_saturation_index(spark, sf):
    d = FE.saturation_index(_feat(spark, sf))
    return d.select("location", "seq", r6("indice_saturacao").alias("indice_saturacao"))


@query("zscore", RD + """SELECT seq, round((pressure_hpa - (SELECT avg(pressure_hpa) FROM readings))
  / (SELECT stddev_samp(pressure_hpa) FROM readings), 6) AS pressao_normalizada FROM readings""")
def q_zscore(spark, sf):
    return FE.zscore(B.readings(spark, sf)).select("seq", r6("pressao_normalizada").alias("pressao_normalizada"))


@query("composite_risk", _feat_sql() + """, g AS (SELECT *, soil_moisture_pct * 0.5 + (precip_72h / (SELECT max(precip_72h) FROM f)) * 50 AS indice_saturacao FROM f)
SELECT location, seq, round(
  (precip_48h / (SELECT max(precip_48h) FROM g)) * 0.3 + (nivel_metros / (SELECT max(nivel_metros) FROM g)) * 0.3
  + (CASE WHEN taxa_subida_m_h IS NULL THEN NULL ELSE greatest(taxa_subida_m_h, 0.0) END / (SELECT max(taxa_subida_m_h) FROM g)) * 0.2
  + (indice_saturacao / 100) * 0.2, 6) AS risco_composto FROM g""")
def q_composite_risk(spark, sf):
    d = FE.derived_features(_feat(spark, sf))        # one pass for all global statistics
    return d.select("location", "seq", r6("risco_composto").alias("risco_composto"))


@query("interactions", _feat_sql() + """SELECT location, seq, round(precip_48h * nivel_metros, 8) AS precip_nivel_interaction,
  round(humidity_pct * temperature_c, 6) AS humidade_temp_interaction FROM f""")
def q_interactions(spark, sf):
    d = FE.interactions(_feat(spark, sf))
    return d.select("location", "seq", F.round("precip_nivel_interaction", 8).alias("precip_nivel_interaction"),
                    r6("humidade_temp_interaction").alias("humidade_temp_interaction"))


def _rule_sql():
    return RD + f""", f AS (SELECT *, round(SUM(precipitation_mm) {O.rows(48)}, 4) AS precip_48h FROM readings)"""


def _rule_in(spark, sf):
    d = W.rolling_sum(B.readings(spark, sf), sizes=(48,))
    return d.withColumn("precip_48h", F.round("precip_48h", 4))


@query("flood_rule", _rule_sql() + """SELECT location, seq, CASE
  WHEN precip_48h > 150 OR nivel_metros > 4 OR taxa_subida_m_h > 0.3 THEN 1
  WHEN (CASE WHEN precip_48h > 50 THEN least(1.0, precip_48h / 150.0) * 0.4 ELSE 0.0 END
      + CASE WHEN nivel_metros > 1 THEN least(1.0, nivel_metros / 4.0) * 0.35 ELSE 0.0 END
      + CASE WHEN taxa_subida_m_h > 0.05 THEN least(1.0, taxa_subida_m_h / 0.3) * 0.25 ELSE 0.0 END) >= 0.5 THEN 1
  ELSE 0 END AS flood_predicted FROM f""")
def q_flood_rule(spark, sf):
    return _rule_in(spark, sf).select("location", "seq", R.flood_rule().alias("flood_predicted"))


@query("risk_score", _rule_sql() + f"""SELECT location, seq, round({O.risk_sql()}, 6) AS risk_score FROM f""")
def q_risk_score(spark, sf):
    return _rule_in(spark, sf).select("location", "seq", r6(R.risk_score()).alias("risk_score"))


@query("alert_level", _rule_sql() + f"""SELECT location, seq, {O.alert_sql(O.risk_sql())} AS alert_level,
  CASE {O.alert_sql(O.risk_sql())} WHEN 0 THEN 'Normal - Monitoramento rotineiro'
    WHEN 1 THEN 'Atenção - Acompanhar condições' WHEN 2 THEN 'Alerta - Preparar ações preventivas'
    ELSE 'Emergência - Evacuar área de risco' END AS alert_description FROM f""")
def q_alert_level(spark, sf):
    d = _rule_in(spark, sf).withColumn("alert_level", R.alert_level(R.risk_score()))
    return d.select("location", "seq", "alert_level", R.alert_description("alert_level").alias("alert_description"))


@query("validate_features", _rule_sql() + """SELECT location, seq, coalesce(precip_48h BETWEEN 0 AND 500
  AND nivel_metros BETWEEN 0 AND 10 AND taxa_subida_m_h BETWEEN -1 AND 2, false) AS valid FROM f""")
def q_validate_features(spark, sf):
    return _rule_in(spark, sf).select("location", "seq", F.coalesce(R.valid_features(), F.lit(False)).alias("valid"))


@query("emergency_rule", RD + """SELECT seq, CASE WHEN nivel_metros > 4 OR precipitation_mm > 50 THEN 3 ELSE 0 END AS alert_level,
  CAST(least(1.0, CASE WHEN nivel_metros > 3 THEN 0.4 ELSE 0.0 END + CASE WHEN precipitation_mm > 30 THEN 0.4 ELSE 0.0 END
   + CASE WHEN nivel_metros > 4 THEN 0.2 ELSE 0.0 END) AS DOUBLE) AS emergency_score FROM readings""")
def q_emergency_rule(spark, sf):
    r = B.readings(spark, sf)
    return r.select("seq", R.emergency_alert().alias("alert_level"), R.emergency_score().alias("emergency_score"))


# ---------------------------------------------------------------------------------------------
# 2.2 projections and filters on readings

@query("outlier_filter", RD + """SELECT seq, location FROM readings WHERE precipitation_mm BETWEEN 0 AND 500
  AND temperature_c BETWEEN -10 AND 50 AND humidity_pct BETWEEN 0 AND 100 AND nivel_metros BETWEEN 0 AND 20""")
def q_outlier_filter(spark, sf):
    return CL.outlier_filter(B.readings(spark, sf)).select("seq", "location")


@query("outlier_report", RD + """SELECT count(*) AS n_original, count(*) FILTER (WHERE k) AS n_kept,
  count(*) - count(*) FILTER (WHERE k) AS n_removed,
  round((count(*) - count(*) FILTER (WHERE k)) * 100.0 / count(*), 4) AS pct_removed
FROM (SELECT coalesce(precipitation_mm BETWEEN 0 AND 500 AND temperature_c BETWEEN -10 AND 50
  AND humidity_pct BETWEEN 0 AND 100 AND nivel_metros BETWEEN 0 AND 20, false) AS k FROM readings)""")
def q_outlier_report(spark, sf):
    return CL.outlier_report(B.readings(spark, sf))


@query("critical_readings", RD + ", " + O.STATIONS + """
SELECT r.location, r.seq, r.nivel_metros FROM readings r LEFT JOIN stations s USING (location)
WHERE r.nivel_metros > coalesce(s.event_limit, coalesce(s.base_level, 2.0) * 1.6)""")
def q_critical_readings(spark, sf):
    d = J.station_lookup(B.readings(spark, sf).select("location", "seq", "nivel_metros"))
    return d.filter(F.col("nivel_metros") > F.col("event_limit")).select("location", "seq", "nivel_metros")


@query("final_projection", RD + """SELECT datetime, location, precipitation_mm, temperature_c, humidity_pct,
  pressure_hpa, wind_speed_kmh, soil_moisture_pct, nivel_metros, taxa_subida_m_h FROM readings""")
def q_final_projection(spark, sf):
    return CL.select_present(B.readings(spark, sf), P.FINAL_COLUMNS)


@query("sorted_readings", RD + """SELECT location, datetime, seq FROM readings""")
def q_sorted_readings(spark, sf):
    return CL.sorted_by(B.readings(spark, sf).select("location", "datetime", "seq"), ["location", "datetime", "seq"])


# ---------------------------------------------------------------------------------------------
# 2.3 joins

@query("left_join", O.with_(O.READINGS, O.WEATHER, O.RIVERS) + """SELECT w.*, r.nivel_metros, r.taxa_subida_m_h, r.status
FROM weather w LEFT JOIN rivers r USING (datetime, location)""")
def q_left_join(spark, sf):
    return J.left_join(B.weather(spark, sf), B.rivers(spark, sf), ["datetime", "location"],
                       ["nivel_metros", "taxa_subida_m_h", "status"])


@query("station_lookup", RD + ", " + O.STATIONS + """SELECT r.location, r.seq, coalesce(s.rio_principal, 'Rio_Local') AS rio_principal,
  coalesce(s.base_level, 2.0) AS base_level, coalesce(s.event_limit, coalesce(s.base_level, 2.0) * 1.6) AS event_limit
FROM readings r LEFT JOIN stations s USING (location)""")
def q_station_lookup(spark, sf):
    d = J.station_lookup(B.readings(spark, sf).select("location", "seq"))
    return d.select("location", "seq", "rio_principal", "base_level", "event_limit")


@query("name_match", O.with_(O.READINGS, O.REPORTS) + """SELECT e.event_no, min(n.location) AS location
FROM reports e JOIN (SELECT DISTINCT location FROM readings) n ON contains(lower(e.location_text), lower(n.location))
GROUP BY e.event_no""")
def q_name_match(spark, sf):
    names = B.readings(spark, sf).select("location").distinct()
    return J.name_match(B.reports(spark, sf), names, "location_text", "event_no", "location")


@query("flood_label", O.with_(O.READINGS, O.REPORTS) + """, m AS (
  SELECT e.event_no, min(n.location) AS location FROM reports e
  JOIN (SELECT DISTINCT location FROM readings) n ON contains(lower(e.location_text), lower(n.location))
  GROUP BY e.event_no),
ev AS (SELECT e.event_no, m.location, e.date, e.date - INTERVAL 72 HOUR AS s,
              e.date + to_days(CAST(coalesce(e.duration_days, 3) AS INTEGER)) AS t
       FROM reports e JOIN m USING (event_no)),
hit AS (SELECT r.location, r.seq, max_by(epoch_us(ev.date) - epoch_us(r.datetime), ev.event_no) AS us
        FROM readings r JOIN ev ON r.location = ev.location AND r.datetime BETWEEN ev.s AND ev.t
        GROUP BY r.location, r.seq)
SELECT r.location, r.seq, CASE WHEN h.us IS NULL THEN 0 ELSE 1 END AS teve_enchente,
  CASE WHEN h.us IS NULL THEN 0 WHEN h.us / 3.6e9 > 48 THEN 1 WHEN h.us / 3.6e9 > 24 THEN 2 ELSE 3 END AS nivel_alerta,
  round(h.us / 3.6e9, 6) AS tempo_ate_enchente
FROM readings r LEFT JOIN hit h USING (location, seq)""")
def q_flood_label(spark, sf):
    d = LB.flood_label(B.readings(spark, sf).select("location", "datetime", "seq"), B.reports(spark, sf))
    return d.select("location", "seq", "teve_enchente", "nivel_alerta",
                    r6("tempo_ate_enchente").alias("tempo_ate_enchente"))


def _levels_sql():
    """River level derivation in SQL: closed form of the floored running total."""
    return RD + ", " + O.STATIONS + f""",
p AS (SELECT r.*, SUM(precipitation_mm) {O.rows(48)} AS p48,
             coalesce(s.base_level, 2.0) AS base_level, s.status_limit FROM readings r LEFT JOIN stations s USING (location)),
c AS (SELECT *, (CASE WHEN p48 > 150 THEN 1.0 WHEN p48 > 80 THEN 0.4 WHEN p48 > 30 THEN 0.15 ELSE -0.05 END)
                * (CASE WHEN month(datetime) IN (1,2,3,4,5) THEN 1.8 WHEN month(datetime) IN (6,7,8) THEN 0.8
                        WHEN month(datetime) IN (9,10,11) THEN 1.2 ELSE 1.4 END) AS chg FROM p),
sc AS (SELECT *, SUM(chg) OVER (PARTITION BY location ORDER BY datetime, seq ROWS UNBOUNDED PRECEDING) AS S FROM c),
lv AS (SELECT *, S + greatest(base_level, max(0.5 - S) OVER (PARTITION BY location ORDER BY datetime, seq ROWS UNBOUNDED PRECEDING)) AS lvl FROM sc),
rl AS (SELECT *, round(lvl, 2) AS nivel_metros2 FROM lv),
rr AS (SELECT *, CASE WHEN lag(nivel_metros2) {O.w()} IS NULL THEN 0.0
                 ELSE round(lvl - lag(nivel_metros2) {O.w()}, 3) END AS taxa2 FROM rl)"""


@query("floored_cumsum", _levels_sql() + """SELECT location, seq, nivel_metros2 AS nivel_metros FROM rr""")
def q_floored_cumsum(spark, sf):
    d = LB.river_levels(B.readings(spark, sf).drop("nivel_metros", "taxa_subida_m_h"))
    return d.select("location", "seq", "nivel_metros")


@query("level_change", RD + f""", f AS (SELECT *, SUM(precipitation_mm) {O.rows(48)} AS p48 FROM readings)
SELECT location, seq, round(CAST(CASE WHEN p48 > 150 THEN 1.0 WHEN p48 > 80 THEN 0.4 WHEN p48 > 30 THEN 0.15 ELSE -0.05 END AS DOUBLE)
  * CAST(CASE WHEN month(datetime) IN (1,2,3,4,5) THEN 1.8 WHEN month(datetime) IN (6,7,8) THEN 0.8
          WHEN month(datetime) IN (9,10,11) THEN 1.2 ELSE 1.4 END AS DOUBLE), 6) AS level_change FROM f""")
def q_level_change(spark, sf):
    d = W.rolling_sum(B.readings(spark, sf), sizes=(48,))
    return d.select("location", "seq", r6(PH.level_change("precip_48h", "datetime")).alias("level_change"))


@query("river_status", _levels_sql() + """SELECT location, seq, nivel_metros2 AS nivel_metros, taxa2 AS taxa_subida_m_h,
  CASE WHEN status_limit IS NOT NULL AND nivel_metros2 > status_limit THEN 'critico'
       WHEN nivel_metros2 > base_level * 1.4 THEN 'alerta' ELSE 'normal' END AS status FROM rr""")
def q_river_status(spark, sf):
    d = LB.river_levels(B.readings(spark, sf).drop("nivel_metros", "taxa_subida_m_h"))
    return d.select("location", "seq", "nivel_metros", "taxa_subida_m_h", "status")


@query("flood_events", _levels_sql() + """, st AS (SELECT rr.location, rr.datetime, rr.nivel_metros2 AS lvl,
   coalesce(s.rio_principal, 'Rio_Local') AS rio_principal, rr.base_level,
   coalesce(s.event_limit, rr.base_level * 1.6) AS event_limit
 FROM rr LEFT JOIN stations s USING (location)),
g AS (SELECT location, count(*) AS n, min(datetime) AS first_ts, max(lvl) AS mx, any_value(base_level) AS base_level,
             any_value(rio_principal) AS rio_principal FROM st WHERE lvl > event_limit GROUP BY location HAVING count(*) > 24)
SELECT strftime(first_ts, '%Y-%m-%d') AS date, location, rio_principal, CAST(n // 24 + 1 AS INTEGER) AS duration_days,
  CASE WHEN location = 'Porto_Alegre' AND mx > 5.0 THEN 'high' WHEN mx > base_level * 2.0 THEN 'high' ELSE 'medium' END AS severity,
  round(mx, 2) AS max_water_level_m,
  (CASE WHEN location = 'Porto_Alegre' AND mx > 5.0 THEN 'high' WHEN mx > base_level * 2.0 THEN 'high' ELSE 'medium' END) = 'high' AS emergency_declared,
  'INMET_RS_Analysis' AS source FROM g""")
def q_flood_events(spark, sf):
    rv = LB.river_levels(B.readings(spark, sf).drop("nivel_metros", "taxa_subida_m_h"))
    return LB.flood_events(rv)
