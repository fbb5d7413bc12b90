"""Structured Streaming jobs over device telemetry.

Source: parquet files arriving in a folder (here the ``lineitem`` table of a test folder, bound to
telemetry), encoded to the device's JSON wire format and decoded again, as a real device feed would
arrive. A table may be one file or a folder of files, in any order of event time.

* ``decode``         - I1: JSON decode, calibration, sensor defaults (stateless)
* ``dedupe``         - I2: one reading per (device, time)
* ``rain_windows``   - I3: 24 h rain per device on 1 h slides, closed windows
* ``history``        - I4: per-device history of 48 readings, in event-time order across micro-batches
* ``alerts``         - I5: live scoring chain after the history
* ``mode_changes``   - I6: power mode per reading, emitted only on change

``lateness`` bounds the disorder of a feed: a row may come that much later than the newest row before
it. Keyed jobs (``run_in_order``) hold rows back until the bound has passed and hand on later ones in
a table of their own. ``None`` means that nothing is known about the order; rows are then held until the
feed ends, so none is ever late. A device's rows are never brought into one task: each micro-batch
goes through the skew-safe row frames, with the last rows of every device carried over as a table.
All tables of a job are written per micro-batch id and overwritten when Spark repeats a batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames as FR
from ..operators import telemetry as TM
from ..operators import windows as W
from ..plans import bindings as B
from ..session import scratch_path

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS = ["device_id", "ts", "seq", "seq2", "water_level", "precipitation", "power_mode"]


def source(spark: SparkSession, sf_dir: str, table: str = "lineitem", max_files: int = 1000) -> DataFrame:
    """Raw device records as a stream (file source); the table may be one file or a folder of files."""
    path = f"{sf_dir.rstrip('/')}/{table}."
    # As a pattern the path may also name a single file, which the streaming source refuses as a plain path.
    s = (spark.readStream.schema(spark.read.parquet(f"{path}parquet").schema)
         .option("maxFilesPerTrigger", max_files).parquet(f"{path}[p]arquet"))
    return B.telemetry_from(s)


def decode(raw: DataFrame, wire: bool = True) -> DataFrame:
    """I1: the device record as JSON on the wire, decoded with its schema, then calibration and
    defaults. ``wire=False`` takes an already typed feed (the downstream jobs use it)."""
    if wire:
        text = raw.select(F.to_json(F.struct(*[F.col(c) for c in raw.columns])).alias("json"))
        raw = text.select(F.from_json("json", raw.schema).alias("r")).select("r.*")
    return TM.with_power(TM.calibrate(raw))


def dedupe(df: DataFrame, lateness: str | None = None) -> DataFrame:
    """I2: keep one reading per (device, event time). With a bound, keys are forgotten (and later rows
    dropped) once it has passed; without one, every key stays in the state store (RocksDB, on disk)."""
    d = df.withColumn("event_time", F.col("ts").cast("timestamp"))
    key = [TM.DEVICE_KEY, "event_time"]
    return d.dropDuplicates(key) if lateness is None else d.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(key)


def history(rows: DataFrame) -> DataFrame:
    """I4: history features of rows whose predecessors are among them."""
    return TM.device_history(rows)


def alerts(rows: DataFrame) -> DataFrame:
    """I5: scoring after the history; rain sums are rounded to 6 decimals before the rules."""
    return TM.score_chain(history(rows).withColumn("precip_48h", F.round("precip_48h", 6)))


def mode_changes(rows: DataFrame) -> DataFrame:
    """I6: rows whose power mode differs from the device's reading before (NORMAL before the first)."""
    return W.mode_transitions(rows, "power_mode", key=TM.DEVICE_KEY, order=TM.DEVICE_ORDER)


def _start(stream: DataFrame, base: str, on_batch: Callable[[DataFrame, int], None]) -> None:
    """Hand every micro-batch that is available now to ``on_batch``; a restarted job resumes."""
    (stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{base}/_checkpoint")
     .trigger(availableNow=True).start().awaitTermination())


def run_in_order(stream: DataFrame, name: str, step: Callable[[DataFrame], DataFrame], carry: int,
                 lateness: str | None = None, flush: bool = True) -> tuple[DataFrame, DataFrame]:
    """Apply ``step`` to a feed of device rows in event-time order; (results, rows that came too late).

    step: looks back at most ``carry`` rows of the device and passes other columns on. Per micro-batch,
    rows behind the mark (newest event time of earlier batches less ``lateness``) are late, rows before the new
    mark are released together with the carried rows, the others are held. ``flush`` releases what is
    held when the feed has ended; leave it off for a feed that goes on.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")
    stream = stream.select(*ROWS)
    schema, batches = stream.schema, []

    def at(what: str, n) -> str:
        return f"{base}/{what}/batch={n}"

    def saved(session: SparkSession, what: str, n: int) -> DataFrame:
        return session.read.schema(schema).parquet(at(what, n)) if n >= 0 else session.createDataFrame([], schema)

    def release(rows: DataFrame, carried: DataFrame, n) -> None:
        both = rows.withColumn("_old", F.lit(False)).unionByName(carried.withColumn("_old", F.lit(True)))
        step(both).filter(~F.col("_old")).drop("_old").write.mode("overwrite").parquet(at("data", n))

    def on_batch(df: DataFrame, n: int) -> None:
        session = df.sparkSession
        batches.append(n)
        df.write.mode("overwrite").parquet(at("rows", n))
        if lateness is None:
            return
        new, held, carried = saved(session, "rows", n), saved(session, "held", n - 1), saved(session, "carried", n - 1)
        old = session.read.parquet(at("mark", n - 1)).first()[0] if n else None
        seen = new.agg(F.expr(f"CAST(max(ts) - INTERVAL {lateness} AS STRING)")).first()[0]
        session.range(1).select(F.greatest(F.lit(old).cast("timestamp_ntz"), F.lit(seen).cast("timestamp_ntz")).cast("string")
                                .alias("mark")).write.mode("overwrite").parquet(at("mark", n))
        late = F.coalesce(F.col("ts") < F.lit(old).cast("timestamp_ntz"), F.lit(False))
        new.filter(late).write.mode("overwrite").parquet(at("late", n))
        mark = F.lit(session.read.parquet(at("mark", n)).first()[0]).cast("timestamp_ntz")
        open_rows = held.unionByName(new.filter(~late))
        ready = open_rows.filter(F.col("ts") < mark)
        open_rows.filter(F.col("ts").isNull() | (F.col("ts") >= mark)).write.mode("overwrite").parquet(at("held", n))
        release(ready, carried, n)
        last = FR.position_and_count(carried.unionByName(ready), TM.DEVICE_KEY, TM.DEVICE_ORDER, pos="_place", count="_count")
        last.filter(F.col("_place") > F.col("_count") - carry).select(*ROWS).write.mode("overwrite").parquet(at("carried", n))

    _start(stream, base, on_batch)
    n = max(batches, default=-1)
    if flush or n < 0:
        rest = spark.read.schema(schema).parquet(f"{base}/rows").select(*ROWS) if lateness is None and n >= 0 else saved(spark, "held", n)
        release(rest, saved(spark, "carried", n if lateness else -1), n + 1)
    late = spark.read.schema(schema).parquet(f"{base}/late").select(*ROWS) if lateness and n >= 0 else saved(spark, "late", -1)
    return spark.read.parquet(f"{base}/data").drop("batch"), late


def run_rain_windows(stream: DataFrame, name: str = "rain_windows", hours: int = 24, closed_after: str = "1 hour") -> DataFrame:
    """I3: rain per device over sliding windows of ``hours`` hours, one an hour, that ended at least
    ``closed_after`` before the newest reading. Every micro-batch adds its sums per device and hour;
    windows slide over the hourly sums, so a reading is never expanded and none is too late to count."""
    spark = stream.sparkSession
    base = scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")

    def hourly(df: DataFrame) -> DataFrame:
        return df.groupBy(TM.DEVICE_KEY, F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
            F.sum("precipitation").alias("rain"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("newest"))

    def on_batch(df: DataFrame, n: int) -> None:
        hourly(df).write.mode("overwrite").parquet(f"{base}/hours/batch={n}")

    hourly(spark.createDataFrame([], stream.schema)).write.parquet(f"{base}/hours/batch=-1")     # an empty feed has no windows
    _start(stream, base, on_batch)
    sums = spark.read.parquet(f"{base}/hours")
    per = sums.groupBy(TM.DEVICE_KEY, "hour").agg(F.sum("rain").alias("rain"), F.sum("n").alias("n"))
    slid = per.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))))
    slid = slid.withColumn("window_start", F.expr("hour - make_dt_interval(0, back, 0, 0)"))
    windows = slid.groupBy(TM.DEVICE_KEY, "window_start").agg(F.sum("rain").alias("rain_sum"), F.sum("n").alias("n"))
    windows = windows.withColumn("window_end", F.expr(f"window_start + INTERVAL {hours} HOUR"))
    newest = sums.agg(F.max("newest").alias("newest")).select(F.expr(f"newest - INTERVAL {closed_after}")).scalar()
    return windows.filter(F.col("window_end") <= newest).select(TM.DEVICE_KEY, "window_start", "window_end", "rain_sum", "n")


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over everything available now into a parquet table under the shared
    checkpoint folder (with its own checkpoint, so a restarted job resumes), then read it back."""
    spark = stream.sparkSession
    base = scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")
    old = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        q = (stream.writeStream.format("parquet").outputMode(mode)
             .option("checkpointLocation", f"{base}/_checkpoint").option("path", f"{base}/data")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.unset(_STORE) if old is None else spark.conf.set(_STORE, old)
    return spark.read.schema(stream.schema).parquet(f"{base}/data")
