"""Binding of the flood domain onto the driver's test tables.

The test tables carry no weather data, so the domain tables are *derived* from them by fixed
column rules, identically in Spark (here) and in the SQL oracle (:mod:`floodspark.plans.oracle`).
Every derived table grows with its source table.

* readings  <- ``events``: one reading per event. Station = one of the four reference stations for
  user ids 0..3 mod 6 (so four stations hold two thirds of all rows: a built-in skew case), else
  ``'S' || user_id``. Rain = value / 20 (NULL for ``error`` events: gaps), level = value / 50,
  the rest from the ``props`` JSON number ``k``.
* rivers    <- ``events`` without ``click`` rows (so a left join has misses).
* reports   <- ``events`` of type ``error`` with value > 150: free-text place, date, duration.
* scores    <- ``labels`` joined to ``documents``: y = quality, score = (n_chars mod 1000) / 1000.
* vectors   <- ``embeddings``: y = 1 for label 0 (the minority), else 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_MIN_VALUE = 150.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def station_of(user_id) -> F.Column:
    u = F.col(user_id) if isinstance(user_id, str) else user_id
    m = u % 6
    return (F.when(m == 0, "Porto_Alegre").when(m == 1, "Santa_Maria")
            .when(m == 2, "Caxias_do_Sul").when(m == 3, "Pelotas")
            .otherwise(F.concat(F.lit("S"), u.cast("string"))))


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").try_cast("int")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    k = _k()
    return ev.select(
        station_of("user_id").alias("location"),
        F.col("ts").alias("datetime"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("double"))
         .otherwise(F.col("value") / 20).alias("precipitation_mm"),
        ((k % 40) - 5).cast("double").alias("temperature_c"),
        k.cast("double").alias("humidity_pct"),
        (F.lit(990.0) + F.col("value") / 10).alias("pressure_hpa"),
        (k / 2).alias("wind_speed_kmh"),
        (F.lit(20.0) + (k % 76)).alias("soil_moisture_pct"),
        (F.col("value") / 50).alias("nivel_metros"),
        (((k % 11) - 3) / 20).alias("taxa_subida_m_h"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings without the river columns (left side of the river join)."""
    return readings(spark, sf_dir).drop("nivel_metros", "taxa_subida_m_h")


def rivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") != "click")
    lvl = F.col("value") / 50
    return ev.select(
        station_of("user_id").alias("location"),
        F.col("ts").alias("datetime"),
        lvl.alias("nivel_metros"),
        (((_k() % 11) - 3) / 20).alias("taxa_subida_m_h"),
        F.when(lvl > 4, "critico").when(lvl > 2.8, "alerta").otherwise("normal").alias("status"),
        F.lit("rio").alias("rio_principal"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter((F.col("event_type") == "error") & (F.col("value") > REPORT_MIN_VALUE))
    loc = station_of("user_id")
    text = F.concat(F.when(F.col("event_id") % 2 == 0, F.upper(loc)).otherwise(loc), F.lit(" - RS"))
    return ev.select(
        F.col("event_id").alias("event_no"),
        text.alias("location_text"),
        F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("date"),
        (_k() % 5).alias("duration_days"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return lab.join(doc, ["doc_id"]).select(
        F.col("doc_id").alias("id"),
        F.col("quality").alias("y"),
        ((F.col("n_chars") % 1000) / 1000).alias("score"),
        F.col("toxic"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("id"),
                      F.col("embedding").cast("array<double>").alias("features"),
                      F.when(F.col("label") == 0, 1).otherwise(0).alias("y"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device telemetry <- ``lineitem``: raw ADC readings and sensor values per device and time.
    Device ``dev0`` gets every third supplier's rows (one device with a third of all rows)."""
    li = table(spark, sf_dir, "lineitem")
    return telemetry_from(li)


def telemetry_from(li: DataFrame) -> DataFrame:
    dev = F.when(F.col("l_suppkey") % 3 == 0, F.lit("dev0")).otherwise(F.concat(F.lit("dev"), F.col("l_suppkey").cast("string")))
    return li.select(
        dev.alias("device_id"),
        (F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("l_linenumber"))).alias("ts"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        (F.col("l_partkey") * 100003 + F.col("l_suppkey")).alias("seq2"),
        ((F.col("l_partkey") * 7) % 4096).cast("int").alias("rain_raw"),
        ((F.col("l_orderkey") * 13 + F.col("l_linenumber") * 977) % 30000).cast("int").alias("echo_us"),
        ((F.col("l_suppkey") * 31 + F.col("l_partkey")) % 4096).cast("int").alias("soil_raw"),
        (F.lit(1800) + (F.col("l_partkey") * 3 + F.col("l_linenumber")) % 850).cast("int").alias("battery_raw"),
        ((F.col("l_suppkey") * 17 + F.col("l_orderkey")) % 2500).cast("int").alias("solar_raw"),
        F.when(F.col("l_discount") == 0, F.lit(None).cast("double")).otherwise(F.col("l_quantity") - 10).alias("temperature"),
        F.when(F.col("l_tax") == 0, F.lit(None).cast("double")).otherwise(F.col("l_tax") * 1000).alias("humidity"),
        (F.lit(780.0) + F.col("l_quantity") * 9).alias("pressure"),
        (F.col("l_linestatus") == "O").alias("connected"),
    )


# ---- raw station files <- orders --------------------------------------------------------------

RAW_CODES = ["A801", "A803", "A827", "A832"]
RAW_HEADER_ORDER = ["datetime", "hour", "precipitation_mm", "pressure_hpa", "temperature_c", "humidity_pct",
                    "wind_speed_ms"]


def comma_text(cents: F.Column) -> F.Column:
    return F.concat(F.floor(cents / 100).cast("long").cast("string"), F.lit(","),
                    F.lpad((cents % 100).cast("string"), 2, "0"))


def raw_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw text record per order: station code, year and the text of every field."""
    o = table(spark, sf_dir, "orders")
    m = F.col("o_custkey") % 5
    code = (F.when(m == 0, "A801").when(m == 1, "A803").when(m == 2, "A827").when(m == 3, "A832")
            .otherwise("A999"))
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("long") % 5000
    return o.select(
        k.alias("seq"), code.alias("code"), F.year("o_orderdate").alias("yr"),
        F.when(k % 97 == 0, "bad").otherwise(F.date_format("o_orderdate", "yyyy/MM/dd")).alias("date_text"),
        F.when(k % 89 == 0, "xx UTC").otherwise(F.concat(((k % 25) * 100).cast("string"), F.lit(" UTC"))).alias("hour_text"),
        F.when(k % 53 == 0, "").when(k % 59 == 0, "n/a").otherwise(comma_text(cents)).alias("precip_text"),
        comma_text(95000 + (k * 13) % 10000).alias("pressure_text"),
        comma_text((k * 7) % 4000).alias("temp_text"),
        (F.col("o_custkey") % 101).cast("string").alias("humidity_text"),
        comma_text((F.col("o_custkey") * 3) % 2000).alias("wind_text"),
    )


def station_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_name, line_no, line): 8 metadata lines, a header (spelling by year parity), data rows."""
    from .. import params as P
    r = raw_fields(spark, sf_dir)
    fname = F.concat(F.lit("INMET_S_RS_"), F.col("code"), F.lit("_"), F.col("yr").cast("string"), F.lit(".CSV"))
    data = r.select(fname.alias("file_name"), (F.col("seq") + 10).alias("line_no"),
                    F.concat_ws(";", "date_text", "hour_text", "precip_text", "pressure_text", "temp_text",
                                "humidity_text", "wind_text").alias("line"))
    files = r.select(fname.alias("file_name"), "code", (F.col("yr") % 2).alias("variant")).distinct()
    hdr = [F.when(F.col("variant") == 0, P.HEADER_ALIASES[t][0]).otherwise(P.HEADER_ALIASES[t][1]) for t in RAW_HEADER_ORDER]
    header = files.select("file_name", F.lit(9).cast("long").alias("line_no"), F.concat_ws(";", *hdr).alias("line"))
    meta = ["REGIAO:;S", "UF:;RS", F.concat(F.lit("ESTACAO:;"), F.col("code")),
            F.concat(F.lit("CODIGO (WMO):;"), F.col("code")), "LATITUDE:;-30,05", "LONGITUDE:;-51,16",
            "ALTITUDE:;46,97", "DATA DE FUNDACAO:;2000/09/22"]
    pre = files.select("file_name", F.posexplode(F.array(*[F.lit(x) if isinstance(x, str) else x for x in meta])).alias("i", "line"))
    pre = pre.select("file_name", (F.col("i") + 1).cast("long").alias("line_no"), "line")
    return data.unionByName(header).unionByName(pre)
