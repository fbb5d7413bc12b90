"""Catalog part 5: raw station files (written from ``orders`` into the shared scratch folder, then
discovered and parsed like real station exports), parsing functions, sinks and scans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import params as P
from ..functions import parsing as PA
from ..operators import clean as CL
from ..operators import joins as J
from ..session import scratch_path
from ..sources import station_files as SF
from ..sources import tables as TB
from . import bindings as B
from . import oracle as O
from .registry import query, r6

RAWQ = O.with_(O.RAW, O.STATION_NAMES, O.PARSED)
MEASURES = ["precipitation_mm", "temperature_c", "humidity_pct", "pressure_hpa", "wind_speed_kmh"]


def _files(spark, sf):
    folder = scratch_path(spark, f"station_files/{uuid.uuid4().hex[:12]}")
    SF.write_station_files(B.station_lines(spark, sf), folder)
    return folder


def _parsed(spark, sf):
    folder = _files(spark, sf)
    lines = SF.station_file_filter(SF.scan_lines(spark, folder), J.station_dim(spark))
    pos = SF.resolve_headers(lines)
    return SF.parse_rows(lines, pos)


LINES_SQL = O.with_(O.RAW) + f""", files AS (SELECT DISTINCT code, yr FROM raw),
lines AS (
  SELECT 'INMET_S_RS_' || code || '_' || CAST(yr AS VARCHAR) || '.CSV' AS file_name,
         concat_ws(';', date_text, hour_text, precip_text, pressure_text, temp_text, humidity_text, wind_text) AS line FROM raw
  UNION ALL SELECT 'INMET_S_RS_' || code || '_' || CAST(yr AS VARCHAR) || '.CSV',
         CASE WHEN yr % 2 = 0 THEN {repr(';'.join(P.HEADER_ALIASES[t][0] for t in B.RAW_HEADER_ORDER))}
              ELSE {repr(';'.join(P.HEADER_ALIASES[t][1] for t in B.RAW_HEADER_ORDER))} END FROM files
  UNION ALL SELECT 'INMET_S_RS_' || code || '_' || CAST(yr AS VARCHAR) || '.CSV', m.line
  FROM files, (VALUES ('REGIAO:;S'), ('UF:;RS'), ('LATITUDE:;-30,05'), ('LONGITUDE:;-51,16'), ('ALTITUDE:;46,97'),
                      ('DATA DE FUNDACAO:;2000/09/22')) m(line)
  UNION ALL SELECT 'INMET_S_RS_' || code || '_' || CAST(yr AS VARCHAR) || '.CSV', 'ESTACAO:;' || code FROM files
  UNION ALL SELECT 'INMET_S_RS_' || code || '_' || CAST(yr AS VARCHAR) || '.CSV', 'CODIGO (WMO):;' || code FROM files)"""


@query("file_manifest", LINES_SQL + """SELECT count(DISTINCT file_name) AS n_files, CAST(sum(length(line) + 1) AS BIGINT) AS total_bytes
FROM lines""")
def q_file_manifest(spark, sf):
    """Files found by name pattern, with their count and total size (Latin-1: one byte per character
    plus the line end)."""
    return SF.file_manifest(spark, _files(spark, sf))


@query("station_file_filter", O.with_(O.RAW) + """SELECT code AS estacao, count(*) + 9 * count(DISTINCT yr) AS n_lines
FROM raw WHERE code <> 'A999' GROUP BY code""")
def q_station_file_filter(spark, sf):
    folder = _files(spark, sf)
    lines = SF.station_file_filter(SF.scan_lines(spark, folder), J.station_dim(spark))
    return lines.groupBy("estacao").agg(F.count(F.lit(1)).alias("n_lines"))


@query("alias_resolve", O.with_(O.RAW) + """SELECT DISTINCT 'INMET_S_RS_' || code || '_' || CAST(yr AS VARCHAR) || '.CSV' AS file_name,
  0 AS datetime, 1 AS hour, 2 AS precipitation_mm, 4 AS temperature_c, 5 AS humidity_pct, 3 AS pressure_hpa, 6 AS wind_speed_ms
FROM raw WHERE code <> 'A999'""")
def q_alias_resolve(spark, sf):
    folder = _files(spark, sf)
    lines = SF.station_file_filter(SF.scan_lines(spark, folder), J.station_dim(spark))
    return SF.resolve_headers(lines)


@query("raw_station_scan", RAWQ + "SELECT location, file_name, datetime, " + ", ".join(MEASURES) +
       " FROM parsed WHERE datetime IS NOT NULL")
def q_raw_station_scan(spark, sf):
    return CL.drop_null_keys(_parsed(spark, sf), ["datetime", "location"])


@query("parse_datetime", O.with_(O.RAW) + f"""SELECT seq, try_strptime(date_text, '%Y/%m/%d')
  + to_hours(TRY_CAST(substr({O.hour_sql()}, 1, 2) AS INTEGER)) + to_minutes(TRY_CAST(substr({O.hour_sql()}, 3) AS INTEGER)) AS datetime
FROM raw WHERE datetime IS NOT NULL""".replace("WHERE datetime IS NOT NULL", f"""WHERE (try_strptime(date_text, '%Y/%m/%d')
  + to_hours(TRY_CAST(substr({O.hour_sql()}, 1, 2) AS INTEGER)) + to_minutes(TRY_CAST(substr({O.hour_sql()}, 3) AS INTEGER))) IS NOT NULL"""))
def q_parse_datetime(spark, sf):
    r = B.raw_fields(spark, sf).select("seq", PA.parse_datetime("date_text", "hour_text").alias("datetime"))
    return CL.drop_null_keys(r, ["datetime"])


@query("decimal_comma", O.with_(O.RAW) + f"""SELECT seq, {O.num_sql('precip_text')} AS precipitation_mm,
  {O.num_sql('pressure_text')} AS pressure_hpa, {O.num_sql('wind_text')} AS wind_speed_ms FROM raw""")
def q_decimal_comma(spark, sf):
    r = B.raw_fields(spark, sf)
    return r.select("seq", PA.decimal_comma("precip_text").alias("precipitation_mm"),
                    PA.decimal_comma("pressure_text").alias("pressure_hpa"), PA.decimal_comma("wind_text").alias("wind_speed_ms"))


@query("unit_convert", O.with_(O.RAW) + f"SELECT seq, {O.num_sql('wind_text')} * 3.6 AS wind_speed_kmh FROM raw")
def q_unit_convert(spark, sf):
    r = B.raw_fields(spark, sf)
    return r.select("seq", PA.ms_to_kmh(PA.decimal_comma("wind_text")).alias("wind_speed_kmh"))


@query("drop_empty", O.with_(O.RAW) + f""", r2 AS (SELECT seq, precip_text, CASE WHEN seq % 7 = 0 THEN ' ' ELSE humidity_text END AS humidity_text FROM raw)
SELECT seq, {O.num_sql('precip_text')} AS precipitation_mm, {O.num_sql('humidity_text')} AS humidity_pct
FROM r2 WHERE {O.num_sql('precip_text')} IS NOT NULL OR {O.num_sql('humidity_text')} IS NOT NULL""")
def q_drop_empty(spark, sf):
    r = B.raw_fields(spark, sf).withColumn("humidity_text", F.when(F.col("seq") % 7 == 0, F.lit(" ")).otherwise(F.col("humidity_text")))
    r = CL.blank_strings_to_null(r, ["precip_text", "humidity_text"])
    d = r.select("seq", PA.decimal_comma("precip_text").alias("precipitation_mm"), PA.decimal_comma("humidity_text").alias("humidity_pct"))
    return CL.drop_empty(d, ["precipitation_mm", "humidity_pct"])


@query("union_by_name", O.with_(O.READINGS, O.RIVERS) + """SELECT location, datetime, precipitation_mm, nivel_metros, NULL::VARCHAR AS status FROM readings
UNION ALL SELECT location, datetime, NULL::DOUBLE, nivel_metros, status FROM rivers""")
def q_union_by_name(spark, sf):
    a = B.readings(spark, sf).select("location", "datetime", "precipitation_mm", "nivel_metros")
    b = B.rivers(spark, sf).select("status", "datetime", "location", "nivel_metros")
    return CL.union_by_name([a, b])


@query("preview", O.with_(O.READINGS) + "SELECT location, datetime, seq FROM readings ORDER BY location, datetime, seq LIMIT 10")
def q_preview(spark, sf):
    """First rows in (location, time) order: a top-k (the limit is the feature)."""
    return B.readings(spark, sf).select("location", "datetime", "seq").orderBy("location", "datetime", "seq").limit(10)


@query("scan_readings", O.with_(O.READINGS) + "SELECT * FROM readings")
def q_scan_readings(spark, sf):
    """Sink + source round trip: parquet partitioned by station, read back with pruning."""
    folder = scratch_path(spark, f"readings/{uuid.uuid4().hex[:12]}")
    TB.write_readings(B.readings(spark, sf), folder)
    return TB.read_readings(spark, folder).select(*B.readings(spark, sf).columns)


@query("csv_round_trip", O.with_(O.READINGS) + "SELECT * FROM readings")
def q_csv_round_trip(spark, sf):
    """CSV sink with header and a typed CSV scan back."""
    r = B.readings(spark, sf)
    folder = scratch_path(spark, f"csv/{uuid.uuid4().hex[:12]}")
    TB.write_csv(r, folder)
    return TB.read_csv(spark, folder, r.schema)


@query("feature_target_split", O.with_(O.READINGS) + """SELECT location, datetime, seq, precipitation_mm, temperature_c,
  humidity_pct, pressure_hpa, wind_speed_kmh, soil_moisture_pct, nivel_metros, taxa_subida_m_h,
  CASE WHEN nivel_metros > 4 THEN 1 ELSE 0 END AS teve_enchente FROM readings""")
def q_feature_target_split(spark, sf):
    r = B.readings(spark, sf).withColumn("teve_enchente", (F.col("nivel_metros") > 4).cast("int"))
    feats, target = TB.feature_target(r, "teve_enchente", id_cols=("datetime", "location", "seq"))
    return r.select("location", "datetime", "seq", *feats, target)


# ---- the labelled feature table (the central preprocessing job) --------------------------------

def _feature_sql() -> str:
    from ..operators.windows import KEY  # noqa: F401
    w = O.rows
    wins = []
    for n in P.WINDOWS:
        wins.append(f"SUM(precipitation_mm) {w(n)} AS precip_{n}h")
    for c in ("precipitation_mm", "nivel_metros"):
        for n in P.MA_WINDOWS:
            wins.append(f"CASE WHEN count({c}) {w(n)} = {n} THEN avg({c}) {w(n)} END AS {c}_ma_{n}h")
        for n in P.STD_WINDOWS:
            wins.append(f"CASE WHEN count({c}) {w(n)} = {n} THEN stddev_samp({c}) {w(n)} END AS {c}_std_{n}h")
    for c in ("precipitation_mm", "nivel_metros", "temperature_c"):
        wins.append(f"{c} - lag({c}) {O.w()} AS {c}_diff")
        wins.append(f"{c} - lag({c}, 6) {O.w()} AS {c}_diff_6h")
    wins.append(f"taxa_subida_m_h - lag(taxa_subida_m_h) {O.w()} AS aceleracao_nivel")
    final_num = [c for c in P.FINAL_COLUMNS if c not in P.ID_COLUMNS]
    past = "OVER (PARTITION BY location ORDER BY datetime, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    fut = "OVER (PARTITION BY location ORDER BY datetime, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    fills = [f"coalesce(last_value({c} IGNORE NULLS) {past}, first_value({c} IGNORE NULLS) {fut}, 0) AS {c}"
             for c in final_num]
    out = []
    for c in P.FINAL_COLUMNS:
        if c in ("datetime", "location", "teve_enchente", "nivel_alerta", "hora", "dia_semana", "mes"):
            out.append(c if c in ("datetime", "location", "teve_enchente", "nivel_alerta") else f"CAST({c} AS INTEGER) AS {c}")
        else:
            out.append(f"round({c}, 6) AS {c}")
    return O.with_(O.READINGS, O.WEATHER, O.RIVERS, O.REPORTS) + f""",
j AS (SELECT w.*, r.nivel_metros, r.taxa_subida_m_h, r.status FROM weather w LEFT JOIN rivers r USING (datetime, location)),
c AS (SELECT *, hour(datetime) AS hora, isodow(datetime) - 1 AS dia_semana, month(datetime) AS mes,
        sin(2 * pi() * hour(datetime) / 24) AS hora_sin, cos(2 * pi() * hour(datetime) / 24) AS hora_cos,
        sin(2 * pi() * month(datetime) / 12) AS mes_sin, cos(2 * pi() * month(datetime) / 12) AS mes_cos FROM j),
f AS (SELECT *, {', '.join(wins)} FROM c),
g AS (SELECT *, soil_moisture_pct * 0.5 + precip_72h / (SELECT max(precip_72h) FROM f) * 50 AS indice_saturacao,
        (pressure_hpa - (SELECT avg(pressure_hpa) FROM f)) / (SELECT stddev_samp(pressure_hpa) FROM f) AS pressao_normalizada FROM f),
h AS (SELECT *, (precip_48h / (SELECT max(precip_48h) FROM g)) * 0.3 + (nivel_metros / (SELECT max(nivel_metros) FROM g)) * 0.3
        + (CASE WHEN taxa_subida_m_h IS NULL THEN NULL ELSE greatest(taxa_subida_m_h, 0.0) END / (SELECT max(taxa_subida_m_h) FROM g)) * 0.2
        + (indice_saturacao / 100) * 0.2 AS risco_composto FROM g),
m AS (SELECT e.event_no, min(n.location) AS location FROM reports e
      JOIN (SELECT DISTINCT location FROM h) n ON contains(lower(e.location_text), lower(n.location)) GROUP BY e.event_no),
ev AS (SELECT e.event_no, m.location, e.date, e.date - INTERVAL 72 HOUR AS s, e.date + to_days(CAST(coalesce(e.duration_days, 3) AS INTEGER)) AS t
       FROM reports e JOIN m USING (event_no)),
hit AS (SELECT r.location, r.seq, max_by(epoch_us(ev.date) - epoch_us(r.datetime), ev.event_no) AS us
        FROM h r JOIN ev ON r.location = ev.location AND r.datetime BETWEEN ev.s AND ev.t GROUP BY r.location, r.seq),
lab AS (SELECT h.*, CASE WHEN hit.us IS NULL THEN 0 ELSE 1 END AS teve_enchente,
        CASE WHEN hit.us IS NULL THEN 0 WHEN hit.us / 3.6e9 > 48 THEN 1 WHEN hit.us / 3.6e9 > 24 THEN 2 ELSE 3 END AS nivel_alerta
        FROM h LEFT JOIN hit USING (location, seq)),
o AS (SELECT * FROM lab WHERE precipitation_mm BETWEEN 0 AND 500 AND temperature_c BETWEEN -10 AND 50
        AND humidity_pct BETWEEN 0 AND 100 AND nivel_metros BETWEEN 0 AND 20),
fl AS (SELECT datetime, location, teve_enchente, nivel_alerta, {', '.join(fills)} FROM o)
SELECT {', '.join(out)} FROM fl"""


@query("feature_table", _feature_sql())
def q_feature_table(spark, sf):
    """The feature table without the data-dependent column prune (the prune is checked on its own
    by ``sparse_column_prune``; ``feature_table_pruned`` runs the whole job)."""
    from .pipelines import feature_table
    d = feature_table(B.weather(spark, sf), B.rivers(spark, sf), B.reports(spark, sf), prune=False)
    cols = []
    for c in d.columns:
        t = d.schema[c].dataType.typeName()
        cols.append(F.round(c, 6).alias(c) if t == "double" else F.col(c))
    return d.select(*cols)


@query("feature_table_pruned")
def q_feature_table_pruned(spark, sf):
    """The whole preprocessing job, including the drop of columns with more than 30 % NULL."""
    from .pipelines import feature_table
    return feature_table(B.weather(spark, sf), B.rivers(spark, sf), B.reports(spark, sf), prune=True)


@query("dataset_profile_json")
def q_dataset_profile_json(spark, sf):
    """The profile as a JSON document, written as a JSON sink and read back."""
    from ..operators import labels as LB
    from ..operators import profile as PR
    d = LB.flood_label(B.readings(spark, sf), B.reports(spark, sf)).drop("tempo_ate_enchente")
    folder = scratch_path(spark, f"profile/{uuid.uuid4().hex[:12]}")
    TB.write_json(PR.profile_json(PR.dataset_profile(d, skip=["seq"])), folder)
    return spark.read.schema("json string").json(folder)


# ---- zip archives of station files --------------------------------------------------------------

@query("zip_scan", O.with_(O.RAW) + """SELECT CAST(yr + 28 AS VARCHAR) || '.zip' AS archive,
  CASE WHEN yr + 28 BETWEEN 2020 AND 2025 THEN CAST(yr + 28 AS VARCHAR) ELSE 'temp' END AS year_folder,
  'INMET_S_RS_' || code || '_' || CAST(yr AS VARCHAR) || '.CSV' AS member, count(*) + 9 AS n_lines
FROM raw GROUP BY yr, code""")
def q_zip_scan(spark, sf):
    """Yearly archives (year + 28 -> 2020..2026) of the station files, scanned back line by line."""
    from ..sources import archives as AR
    folder = scratch_path(spark, f"archives/{uuid.uuid4().hex[:12]}")
    lines = B.station_lines(spark, sf).withColumn("yr", F.regexp_extract("file_name", r"_(\d{4})\.CSV$", 1).cast("int"))
    lines = lines.select((F.col("yr") + 28).cast("string").alias("_y"), F.col("file_name").alias("member"), "line_no", "line")
    AR.write_archives(lines.withColumn("archive", F.concat(F.col("_y"), F.lit(".zip"))).drop("_y"), folder)
    scanned = AR.scan_archives(spark, folder)
    return scanned.groupBy("archive", "year_folder", "member").agg(F.count(F.lit(1)).alias("n_lines"))
