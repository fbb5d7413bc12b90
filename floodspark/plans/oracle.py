"""SQL forms of the test-table binding (DuckDB dialect), mirroring :mod:`floodspark.plans.bindings`.

Each oracle query starts ``WITH`` one or more of these views, then states the operator in plain
SQL (window functions over the whole station, joins, grouped aggregates)."""

from __future__ import annotations

STATION = ("CASE user_id % 6 WHEN 0 THEN 'Porto_Alegre' WHEN 1 THEN 'Santa_Maria' "
           "WHEN 2 THEN 'Caxias_do_Sul' WHEN 3 THEN 'Pelotas' ELSE 'S' || CAST(user_id AS VARCHAR) END")

EVK = "(SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"

READINGS = f"""readings AS (
  SELECT {STATION} AS location, ts AS datetime, event_id AS seq,
         CASE WHEN event_type = 'error' THEN NULL ELSE value / 20 END AS precipitation_mm,
         CAST(k % 40 - 5 AS DOUBLE) AS temperature_c,
         CAST(k AS DOUBLE) AS humidity_pct,
         990.0 + value / 10 AS pressure_hpa,
         k / 2 AS wind_speed_kmh,
         CAST(20 + k % 76 AS DOUBLE) AS soil_moisture_pct,
         value / 50 AS nivel_metros,
         (k % 11 - 3) / 20 AS taxa_subida_m_h
  FROM {EVK} e)"""

WEATHER = """weather AS (SELECT * EXCLUDE (nivel_metros, taxa_subida_m_h) FROM readings)"""

RIVERS = f"""rivers AS (
  SELECT {STATION} AS location, ts AS datetime, value / 50 AS nivel_metros,
         (k % 11 - 3) / 20 AS taxa_subida_m_h,
         CASE WHEN value / 50 > 4 THEN 'critico' WHEN value / 50 > 2.8 THEN 'alerta' ELSE 'normal' END AS status,
         'rio' AS rio_principal
  FROM {EVK} e WHERE event_type <> 'click')"""

REPORTS = f"""reports AS (
  SELECT event_id AS event_no,
         CASE WHEN event_id % 2 = 0 THEN upper({STATION}) ELSE {STATION} END || ' - RS' AS location_text,
         date_trunc('day', ts) AS date,
         k % 5 AS duration_days
  FROM {EVK} e WHERE event_type = 'error' AND value > 150)"""

SCORES = """scores AS (
  SELECT l.doc_id AS id, l.quality AS y, (d.n_chars % 1000) / 1000 AS score, l.toxic
  FROM labels l JOIN documents d USING (doc_id))"""

VECTORS = """vectors AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS features, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y
  FROM embeddings)"""

STATIONS = """stations AS (
  SELECT code, location, rio_principal, CAST(base_level AS DOUBLE) AS base_level,
         CAST(status_limit AS DOUBLE) AS status_limit, CAST(event_limit AS DOUBLE) AS event_limit
  FROM (VALUES ('A801', 'Porto_Alegre', 'Guaíba', 1.2, 3.0, 3.0),
                        ('A803', 'Santa_Maria', 'Vacacaí_Mirim', 3.0, 4.5, 4.8),
                        ('A827', 'Caxias_do_Sul', 'Rio_das_Antas', 2.5, 4.0, 4.0),
                        ('A832', 'Pelotas', 'Canal_São_Gonçalo', 1.8, 2.8, 2.83))
         t(code, location, rio_principal, base_level, status_limit, event_limit))"""


def rows(n: int, order: str = "datetime, seq", part: str = "location") -> str:
    """Window clause: the last ``n`` rows of the station (current included)."""
    return f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def w(part: str = "location", order: str = "datetime, seq") -> str:
    return f"OVER (PARTITION BY {part} ORDER BY {order})"


def risk_sql(p48: str = "precip_48h", lvl: str = "nivel_metros", rise: str = "taxa_subida_m_h") -> str:
    s = (f"(least(1.0, {p48} / 200.0) * 0.4 + least(1.0, {lvl} / 5.0) * 0.35 + "
         f"least(1.0, {rise} / 0.5) * 0.25)")
    return f"({s} / (1.0 + abs(1.0 - {s})))"


def alert_sql(score: str) -> str:
    return (f"(CASE WHEN {score} >= 0.8 THEN 3 WHEN {score} >= 0.6 THEN 2 "
            f"WHEN {score} >= 0.4 THEN 1 ELSE 0 END)")


def with_(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"


TELEMETRY = """telemetry AS (
  SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'dev0' ELSE 'dev' || CAST(l_suppkey AS VARCHAR) END AS device_id,
         l_shipdate + to_minutes(CAST(l_linenumber AS BIGINT)) AS ts,
         l_orderkey * 8 + l_linenumber AS seq,
         l_partkey * 100003 + l_suppkey AS seq2,
         CAST((l_partkey * 7) % 4096 AS INTEGER) AS rain_raw,
         CAST((l_orderkey * 13 + l_linenumber * 977) % 30000 AS INTEGER) AS echo_us,
         CAST((l_suppkey * 31 + l_partkey) % 4096 AS INTEGER) AS soil_raw,
         CAST(1800 + (l_partkey * 3 + l_linenumber) % 850 AS INTEGER) AS battery_raw,
         CAST((l_suppkey * 17 + l_orderkey) % 2500 AS INTEGER) AS solar_raw,
         CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity - 10 END AS temperature,
         CASE WHEN l_tax = 0 THEN NULL ELSE l_tax * 1000 END AS humidity,
         780.0 + l_quantity * 9 AS pressure,
         l_linestatus = 'O' AS connected
  FROM lineitem)"""

CALIBRATED = """cal AS (
  SELECT device_id, ts, seq, seq2, connected,
         greatest(CAST((rain_raw * 100) // 4095 AS INTEGER) / 10.0, 0.0) AS precipitation,
         CAST(CAST((soil_raw * 100) // 4095 AS INTEGER) AS DOUBLE) AS soil_moisture,
         CASE WHEN echo_us = 0 THEN 1.0 ELSE least(greatest((500.0 - echo_us * 0.034 / 2) / 100.0, 0.0), 10.0) END AS water_level,
         battery_raw * 3.3 / 4095.0 * 2.0 AS battery_voltage,
         solar_raw * 3.3 / 4095.0 * 3.0 AS solar_voltage,
         coalesce(CASE WHEN isnan(temperature) THEN NULL ELSE temperature END, 25.0) AS temperature,
         coalesce(CASE WHEN isnan(humidity) THEN NULL ELSE humidity END, 60.0) AS humidity,
         CASE WHEN pressure IS NULL OR isnan(pressure) OR pressure < 800 OR pressure > 1200 THEN 1013.25 ELSE pressure END AS pressure
  FROM telemetry)"""

POWER_MODE = """CASE WHEN solar_voltage > 4.5 AND battery_voltage < 4.2 AND solar_voltage > 5.0 THEN 'NORMAL'
  WHEN battery_voltage >= 3.8 THEN 'NORMAL' WHEN battery_voltage >= 3.6 THEN 'ECONOMY'
  WHEN battery_voltage >= 3.3 THEN 'CRITICAL' ELSE 'EMERGENCY' END"""


def comma_sql(cents: str) -> str:
    return f"(CAST(({cents}) // 100 AS VARCHAR) || ',' || lpad(CAST(({cents}) % 100 AS VARCHAR), 2, '0'))"


RAW = f"""raw AS (
  SELECT o_orderkey AS seq,
         CASE o_custkey % 5 WHEN 0 THEN 'A801' WHEN 1 THEN 'A803' WHEN 2 THEN 'A827' WHEN 3 THEN 'A832' ELSE 'A999' END AS code,
         year(o_orderdate) AS yr,
         CASE WHEN o_orderkey % 97 = 0 THEN 'bad' ELSE strftime(o_orderdate, '%Y/%m/%d') END AS date_text,
         CASE WHEN o_orderkey % 89 = 0 THEN 'xx UTC' ELSE CAST((o_orderkey % 25) * 100 AS VARCHAR) || ' UTC' END AS hour_text,
         CASE WHEN o_orderkey % 53 = 0 THEN '' WHEN o_orderkey % 59 = 0 THEN 'n/a'
              ELSE {comma_sql('CAST(round(o_totalprice * 100) AS BIGINT) % 5000')} END AS precip_text,
         {comma_sql('95000 + (o_orderkey * 13) % 10000')} AS pressure_text,
         {comma_sql('(o_orderkey * 7) % 4000')} AS temp_text,
         CAST(o_custkey % 101 AS VARCHAR) AS humidity_text,
         {comma_sql('(o_custkey * 3) % 2000')} AS wind_text
  FROM orders)"""

STATION_NAMES = """names AS (SELECT * FROM (VALUES ('A801', 'Porto_Alegre'), ('A803', 'Santa_Maria'),
  ('A827', 'Caxias_do_Sul'), ('A832', 'Pelotas')) t(code, location))"""


def hour_sql(col: str = "hour_text") -> str:
    h = f"replace({col}, ' UTC', '')"
    return f"(CASE WHEN length({h}) < 4 THEN lpad({h}, 4, '0') ELSE {h} END)"


def num_sql(col: str) -> str:
    return f"(CASE WHEN isnan(TRY_CAST(replace(nullif(trim({col}), ''), ',', '.') AS DOUBLE)) THEN NULL ELSE TRY_CAST(replace(nullif(trim({col}), ''), ',', '.') AS DOUBLE) END)"


PARSED = f"""parsed AS (
  SELECT n.location, 'INMET_S_RS_' || r.code || '_' || CAST(r.yr AS VARCHAR) || '.CSV' AS file_name,
         try_strptime(r.date_text, '%Y/%m/%d') + to_hours(TRY_CAST(substr({hour_sql()}, 1, 2) AS INTEGER))
           + to_minutes(TRY_CAST(substr({hour_sql()}, 3) AS INTEGER)) AS datetime,
         {num_sql('precip_text')} AS precipitation_mm, {num_sql('temp_text')} AS temperature_c,
         {num_sql('humidity_text')} AS humidity_pct, {num_sql('pressure_text')} AS pressure_hpa,
         {num_sql('wind_text')} * 3.6 AS wind_speed_kmh
  FROM raw r JOIN names n USING (code) WHERE r.date_text <> 'bad')"""
