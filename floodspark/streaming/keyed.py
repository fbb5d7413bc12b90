"""Device readings in event-time order, and rain windows over hourly sums.

* ``in_order`` / ``Ordered`` - I4, I6: readings are held until the watermark (newest event time less the lateness
  bound) has passed them, then go in order, together with the last readings of every device, to a step such as
  ``TM.device_history``. Steps run on the skew-safe row frames, so a device's readings are never brought into one task and
  a device costs no call of its own. Rows leave with the micro-batch whose watermark passes them. A reading older than what
  its device has released already is handed on unprocessed, with ``late`` set.
* ``rain_windows`` / ``Windows`` - I3: every micro-batch adds its sums per device and hour; windows whose end the
  watermark has passed slide over the hourly sums when they are read, so neither a reading nor an hour is stored once per
  window. What comes behind the watermark is left out and counted (``run_counted``).

Held and carried readings, hourly sums and the watermark are tables of the job's folder, written per micro-batch id and
overwritten when Spark repeats a batch; a job restarted in its folder goes on. Readings without an event time are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..operators import frames as FR
from ..operators import telemetry as TM
from ..operators import windows as W

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS = ["device_id", "ts", "seq", "seq2", "water_level", "precipitation", "power_mode"]
HISTORY = ["precipitation_ma_12", "water_level_ma_12", "precipitation_ma_24", "water_level_ma_24", "precip_24h", "precip_48h", "water_rise_rate"]
CHANGES = ["device_id", "ts", "seq", "seq2", "old_mode", "new_mode"]


@dataclass(frozen=True)
class Ordered:
    """A job for ``run``: ``step`` over every device's readings in event-time order.

    step: looks back at most ``carry`` readings of the device and passes the column ``_old`` on. ``columns``: what
    the job gives out, with NULL in late readings where they have no such column.
    """
    rows: DataFrame
    step: Callable[[DataFrame], DataFrame]
    columns: list[str]
    carry: int
    lateness: str


@dataclass(frozen=True)
class Windows:
    """A job for ``run``: closed rain windows of ``hours`` hours, one an hour."""
    rows: DataFrame
    lateness: str
    hours: int


def _changes(rows: DataFrame) -> DataFrame:
    return W.mode_transitions(rows, "power_mode", key=TM.DEVICE_KEY, order=TM.DEVICE_ORDER)


def in_order(rows: DataFrame, step, columns: list[str], carry: int, lateness: str) -> Ordered:
    """``step`` over every device's readings in event-time order; late readings as they came, with ``late`` set."""
    return Ordered(rows.select(*ROWS), step, [*columns, "late"], carry, lateness)


def history(rows: DataFrame, lateness: str) -> Ordered:
    """I4: means over the last 12 and 24 readings, rain sums over 24 and 48, rise rate (0 until two earlier readings exist)."""
    return in_order(rows, TM.device_history, [*ROWS, *HISTORY], P.HISTORY_SIZE - 1, lateness)


def alerts(rows: DataFrame, lateness: str) -> Ordered:
    """I5: stateless scoring after the history; rain sums are rounded to 6 decimals before the rules."""
    job = history(rows, lateness)
    scored = ["flood_predicted", "risk_score", "alert_level"]
    return replace(job, step=lambda d: TM.score_chain(TM.device_history(d).withColumn("precip_48h", F.round("precip_48h", 6))), columns=[*job.columns, *scored])


def mode_changes(rows: DataFrame, lateness: str) -> Ordered:
    """I6: readings whose power mode differs from the reading before (NORMAL before the first)."""
    return in_order(rows, _changes, CHANGES, 1, lateness)


def rain_windows(rows: DataFrame, lateness: str, hours: int = 24) -> Windows:
    """I3: rain per device over windows of ``hours`` hours, one an hour, each given out once, when the watermark passes its end."""
    return Windows(rows, lateness, hours)


def _ntz(text: str | None):
    return F.lit(text).cast("timestamp_ntz")


class _Tables:
    """The tables of a job's folder, one part per micro-batch."""

    def __init__(self, base: str):
        self.base = base

    def at(self, what: str, n: int) -> str:
        return f"{self.base}/{what}/batch={n}"

    def write(self, df: DataFrame, what: str, n: int) -> None:
        df.write.mode("overwrite").parquet(self.at(what, n))

    def read(self, session: SparkSession, what: str, n: int, schema) -> DataFrame:
        return session.read.schema(schema).parquet(self.at(what, n)) if n >= 0 else session.createDataFrame([], schema)

    def mark(self, session: SparkSession, n: int) -> tuple[str | None, int]:
        """The watermark after batch n and the batch that wrote the carried readings which hold then."""
        return tuple(session.read.parquet(self.at("mark", n)).first()) if n >= 0 else (None, -1)

    def set_mark(self, session: SparkSession, n: int, mark: str | None, carried: int) -> None:
        self.write(session.createDataFrame([(mark, carried)], "mark string, carried long").coalesce(1), "mark", n)


def _passed(df: DataFrame, lateness: str, old: str | None) -> str | None:
    """The watermark after these rows."""
    mark = F.greatest(_ntz(old), F.expr(f"CAST(max(ts) AS TIMESTAMP_NTZ) - INTERVAL {lateness}"))
    return df.agg(mark.cast("string")).first()[0]


def _start(stream: DataFrame, base: str, on_batch: Callable[[DataFrame, int], None]) -> None:
    """Hand every micro-batch that is available now to ``on_batch``; a restarted job resumes."""
    (stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{base}/_checkpoint")
     .trigger(availableNow=True).start().awaitTermination())


def _run_ordered(job: Ordered, base: str) -> DataFrame:
    tables, schema = _Tables(base), job.rows.schema
    kept = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}, _released timestamp_ntz"

    def released(d: DataFrame, late: DataFrame) -> DataFrame:
        done = job.step(d).filter(~F.col("_old")).withColumn("late", F.lit(False)).select(*job.columns)
        as_came = late.withColumn("late", F.lit(True))
        return done.unionByName(as_came.select(*[F.col(c) if c in as_came.columns else F.lit(None).cast(done.schema[c].dataType).alias(c) for c in job.columns]))

    def on_batch(df: DataFrame, n: int) -> None:
        session = df.sparkSession
        old, at = tables.mark(session, n - 1)
        carried = tables.read(session, "carried", at, kept)
        new = df.filter("ts IS NOT NULL")
        mark = _passed(new, job.lateness, old)
        behind = F.coalesce(F.col("ts") < _ntz(old), F.lit(False))
        # only readings behind the watermark can be late: these are looked up among the devices
        ends = carried.groupBy(F.col("device_id").alias("_device")).agg(F.max("_released").alias("_end"))
        seen = new.filter(behind).join(ends, F.col("device_id").eqNullSafe(F.col("_device")), "left")
        late = F.coalesce(F.col("ts") < F.col("_end"), F.lit(False))
        waiting = tables.read(session, "held", n - 1, schema).unionByName(new.filter(~behind)).unionByName(seen.filter(~late).select(*ROWS))
        tables.write(waiting.filter(F.col("ts").isNull() | (F.col("ts") >= _ntz(mark))), "held", n)
        ready = waiting.filter(F.col("ts") < _ntz(mark))
        both = ready.withColumn("_released", _ntz(mark)).withColumn("_old", F.lit(False)).unionByName(carried.withColumn("_old", F.lit(True)))
        # numbered once, for the step and for what is carried on
        d = FR.row_index(both, TM.DEVICE_KEY, TM.DEVICE_ORDER, totals={"_size": (F.count(F.lit(1)), F.sum), "_newest": (F.max("_released"), F.max)})
        tables.write(released(d.drop("_size", "_newest", "_released"), seen.filter(late).select(*ROWS)), "data", n)
        last = d.filter(F.col(FR.POS) >= F.col("_size") - job.carry)
        tables.write(last.select(*ROWS, F.col("_newest").alias("_released")), "carried", n)
        tables.set_mark(session, n, mark, n)

    _start(job.rows, base, on_batch)
    spark = job.rows.sparkSession
    empty = spark.createDataFrame([], schema)
    out = released(empty.withColumn("_old", F.lit(False)), empty)
    out.write.mode("overwrite").parquet(tables.at("data", -1))                     # the columns, where no batch came
    return spark.read.schema(out.schema).parquet(f"{base}/data").select(*job.columns)


def _run_windows(job: Windows, base: str) -> tuple[DataFrame, int]:
    tables, dropped, spark = _Tables(base), [0], job.rows.sparkSession

    def on_batch(df: DataFrame, n: int) -> None:
        session = df.sparkSession
        old, _ = tables.mark(session, n - 1)
        # readings are read once; lateness and the watermark follow from their hours
        tables.write(W.hourly_sums(df, TM.DEVICE_KEY, "ts", "precipitation", F.max("ts").alias("ts")), "taken", n)
        taken = session.read.parquet(tables.at("taken", n))
        late = F.coalesce(F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, CAST(_h AS INT) + 1, 0, 0)") <= _ntz(old), F.lit(False))
        dropped[0] += (taken.filter(late).agg(F.sum("_n")).first()[0] or 0) if old is not None else 0
        tables.write(taken.filter(~late).drop("ts"), "hours", n)
        tables.set_mark(session, n, _passed(taken, job.lateness, old), n)

    _start(job.rows, base, on_batch)
    none = spark.createDataFrame([], job.rows.schema)
    tables.write(W.hourly_sums(none, TM.DEVICE_KEY, "ts", "precipitation"), "hours", -1)
    spark.createDataFrame([], "mark string, carried long").write.mode("overwrite").parquet(tables.at("mark", -1))
    sums = spark.read.parquet(f"{base}/hours").groupBy(TM.DEVICE_KEY, "_h").agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    mark = spark.read.parquet(f"{base}/mark").agg(F.max(F.col("mark").cast("timestamp_ntz")).cast("string")).first()[0]
    windows = W.slide_hours(sums, TM.DEVICE_KEY, job.hours)
    return windows.filter(F.col("window_end") <= _ntz(mark)).select(TM.DEVICE_KEY, "window_start", "window_end", "rain_sum", "n"), dropped[0]


def _run_stream(stream: DataFrame, base: str) -> tuple[DataFrame, int]:
    spark = stream.sparkSession
    old = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        query = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/data")
                 .option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.unset(_STORE) if old is None else spark.conf.set(_STORE, old)
    dropped = sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])
    return spark.read.schema(stream.schema).parquet(f"{base}/data"), dropped


def run_counted(job: DataFrame | Ordered | Windows, base: str) -> tuple[DataFrame, int]:
    """Take up everything that is available now; the job's whole table so far, and how many rows (or partial sums of rows
    that an aggregation made of them) this run left out as late. ``base`` is the job's folder in shared storage: a job
    started again there resumes from its state."""
    if isinstance(job, Ordered):
        return _run_ordered(job, base), 0
    return _run_windows(job, base) if isinstance(job, Windows) else _run_stream(job, base)


def run(job: DataFrame | Ordered | Windows, base: str) -> DataFrame:
    return run_counted(job, base)[0]


def write_feed(rows: DataFrame, folder: str, lateness: str, ends_after: str, steps: int = 4, files: int = 4) -> int:
    """Write device rows as a feed: ``steps`` time ranges one after the other, each in ``files`` files (one micro-batch, any
    order inside), then a record of no device that announces the end: its time moves the watermark to ``ends_after`` past the
    newest reading. Rows without a time are left out. Gives the files per trigger."""
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    cuts = rows.agg(F.percentile_approx(at, [k / steps for k in range(1, steps)], 1000)).first()[0] or []
    bounds = [None, *cuts, None]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        part = rows.filter("ts IS NOT NULL")
        part = part if lo is None else part.filter(at > lo)
        part = part if hi is None else part.filter(at <= hi)
        part.repartition(files).write.mode("append").parquet(folder)
    end = rows.agg(F.expr(f"max(ts) + INTERVAL {lateness} + INTERVAL {ends_after}").alias("ts"))
    end.filter("ts IS NOT NULL").select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
                                        ).coalesce(1).write.mode("append").parquet(folder)
    return files
