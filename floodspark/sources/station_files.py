"""Raw weather-station text files: discovery, station filter, delimited scan, header aliases.

File layout (one file per station and year): 8 metadata lines, a header line, then rows separated
by ``;`` with decimal commas, Latin-1 encoded. Files are scanned as text lines with their path;
the preamble is dropped by content (a data row starts with a date), the header row of each file
is split into (position, name) pairs and resolved against the alias table, and data rows are split
and picked by the resolved positions (a small per-file table, joined by file)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..functions import parsing as PA

DATE_ROW = r"^\s*\d{4}/\d{2}/\d{2}\s*;"


def file_manifest(spark: SparkSession, folder: str, pattern: str = "*INMET*") -> DataFrame:
    """Files under ``folder`` (recursive) whose name matches ``pattern``: count and total bytes.
    Content is not read (only path and length are selected)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
             .select(file_name_of(F.col("path")).alias("file_name"), "length")
             .filter(F.col("file_name").like(pattern.replace("*", "%"))))
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("total_bytes"))


def scan_lines(spark: SparkSession, folder: str, pattern: str = "*INMET*",
               encoding: str = P.RAW_ENCODING) -> DataFrame:
    """Every line of every matching file with its file name (one string column per line)."""
    lines = (spark.read.option("encoding", encoding).option("sep", "\u0001").option("quote", "")
             .option("header", "false").option("recursiveFileLookup", "true")
             .schema("line string").csv(folder))
    lines = lines.select(file_name_of(F.col("_metadata.file_path")).alias("file_name"), "line")
    return lines.filter(F.col("file_name").like(pattern.replace("*", "%")))


def file_name_of(path):
    """Station file name of a path: the ``file_name=...`` folder Spark writes, else the base name."""
    part = F.regexp_extract(path, r"file_name=([^/]+)/", 1)
    return F.when(part != "", part).otherwise(F.regexp_extract(path, r"([^/]+)$", 1))


def station_file_filter(lines: DataFrame, stations: DataFrame, wanted=P.WANTED_STATIONS) -> DataFrame:
    """Keep lines of files whose name contains a wanted station code; tag code and location
    (first wanted code in list order that occurs in the name)."""
    expr = None
    for code in wanted:
        cond = F.col("file_name").contains(code)
        expr = F.when(cond, code) if expr is None else expr.when(cond, code)
    tagged = lines.withColumn("estacao", expr).filter(F.col("estacao").isNotNull())
    dim = F.broadcast(stations.select(F.col("code").alias("estacao"), "location"))   # fixed 4-row table
    return tagged.join(dim, ["estacao"])


def alias_table(spark: SparkSession) -> DataFrame:
    rows = [(target, name, rank) for target, names in P.HEADER_ALIASES.items() for rank, name in enumerate(names)]
    return spark.createDataFrame(rows, "target string, header string, pref int")


def resolve_headers(lines: DataFrame) -> DataFrame:
    """Per file: the column position of each target, using the most preferred spelling present.
    Files without a date or hour column get no positions (their rows are dropped)."""
    spark = lines.sparkSession
    first = F.trim(F.split(F.col("line"), P.RAW_SEPARATOR).getItem(0))
    date_names = P.HEADER_ALIASES["datetime"]
    hdr = lines.filter(first.isin(*date_names))
    cells = hdr.select("file_name", F.posexplode(F.split("line", P.RAW_SEPARATOR)).alias("pos", "header"))
    cells = cells.withColumn("header", F.trim("header"))
    hit = cells.join(F.broadcast(alias_table(spark)), ["header"])        # alias table: fixed ~30 rows
    best = hit.groupBy("file_name", "target").agg(F.min_by("pos", "pref").alias("pos"))
    wide = best.groupBy("file_name").pivot("target", list(P.HEADER_ALIASES)).agg(F.first("pos"))
    return wide.filter(F.col("datetime").isNotNull() & F.col("hour").isNotNull())


def parse_rows(lines: DataFrame, positions: DataFrame) -> DataFrame:
    """Data rows -> typed readings: date + hour, decimal commas, wind in km/h; blank -> NULL."""
    data = lines.filter(F.col("line").rlike(DATE_ROW))
    d = data.join(positions, ["file_name"]).withColumn("_f", F.split("line", P.RAW_SEPARATOR))

    def cell(target):
        return PA.blank_to_null(F.trim(F.element_at(F.col("_f"), F.col(target) + 1)))

    measures = ["precipitation_mm", "temperature_c", "humidity_pct", "pressure_hpa", "wind_speed_ms"]
    out = d.select(
        "file_name", "location",
        PA.parse_datetime(cell("datetime"), cell("hour")).alias("datetime"),
        *[PA.decimal_comma(cell(m)).alias(m) for m in measures])
    return out.withColumn("wind_speed_kmh", PA.ms_to_kmh("wind_speed_ms")).drop("wind_speed_ms")


def write_station_files(lines: DataFrame, folder: str, encoding: str = P.RAW_ENCODING) -> None:
    """Write (file_name, line_no, line) rows as one text file per ``file_name`` (lines in order)."""
    (lines.repartition("file_name").sortWithinPartitions("file_name", "line_no")
     .select("file_name", "line")
     .write.mode("overwrite").partitionBy("file_name")
     .option("encoding", encoding).option("sep", "\u0001").option("quote", "").csv(folder))
