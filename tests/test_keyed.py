"""Keyed streaming jobs: per micro-batch output, restart in a named folder, late readings; batch twins as the reference."""

import pytest
from pyspark.sql import functions as F

from floodspark.operators import telemetry as TM
from floodspark.operators import windows as W
from floodspark.plans import bindings as B
from floodspark.session import ship_package
from floodspark.streaming import keyed as K
from floodspark.streaming import telemetry as ST

from paths import SF0001

LATENESS = "400 days"
HISTORY = ["device_id", "seq", "seq2", *K.HISTORY]
CHANGES = ["device_id", "seq", "old_mode", "new_mode"]


def _sorted(df, cols):
    return sorted((tuple(round(x, 9) + 0.0 if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def rows(spark):
    ship_package(spark)
    return B.telemetry(spark, SF0001)


@pytest.fixture(scope="module")
def power(rows):
    return TM.with_power(TM.calibrate(rows)).cache()


def _stream(spark, rows, folder, files=2):
    return ST.decode(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder), wire=False)


@pytest.fixture(scope="module")
def feed(spark, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("feed"))
    K.write_feed(rows, folder, LATENESS, "1 second", files=2)
    return folder


def test_history_and_modes_equal_their_batch_twins(spark, rows, power, feed, tmp_path):
    out = K.run(K.history(_stream(spark, rows, feed), LATENESS), f"{tmp_path}/history")
    assert _sorted(out, HISTORY) == _sorted(TM.device_history(power), HISTORY)
    batches = out.groupBy(F.input_file_name().alias("f")).agg(F.max("ts").alias("newest"))
    assert batches.select("newest").distinct().count() > 1                # not one batch after the feed's end
    out = K.run(K.mode_changes(_stream(spark, rows, feed), LATENESS), f"{tmp_path}/modes")
    assert _sorted(out, CHANGES) == _sorted(W.mode_transitions(power, "power_mode", key="device_id", order=("ts", "seq", "seq2")), CHANGES)


def test_restart_between_two_files_goes_on(spark, rows, power, tmp_path):
    """Half of the feed, stop, the other half in the same folder: rows leave in both runs, none twice."""
    middle = rows.select(F.expr("percentile_approx(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts), 0.5)")).first()[0]
    second = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    folder, base = f"{tmp_path}/feed", f"{tmp_path}/job"
    rows.filter(second <= middle).coalesce(1).write.mode("append").parquet(folder)
    first = K.run(K.history(_stream(spark, rows, folder), "30 days"), base)
    n = first.count()
    assert 0 < n < rows.filter(second <= middle).count()
    K.write_feed(rows.filter(second > middle), folder, "30 days", "1 second", steps=1, files=1)
    out = K.run(K.history(_stream(spark, rows, folder), "30 days"), base)
    assert _sorted(out, HISTORY) == _sorted(TM.device_history(power), HISTORY) and out.count() > n


def test_rain_windows_leave_as_the_watermark_passes(spark, rows, power, feed, tmp_path):
    cols = ["device_id", "window_start", "window_end", "n", "rain"]
    out = K.run(K.rain_windows(_stream(spark, rows, feed), LATENESS), f"{tmp_path}/rain").withColumn("rain", F.round("rain_sum", 6))
    w = F.window(F.col("ts").cast("timestamp"), "24 hours", "1 hour")
    plain = power.groupBy("device_id", w.alias("w")).agg(F.round(F.sum("precipitation"), 6).alias("rain"), F.count(F.lit(1)).alias("n"))
    plain = plain.select("device_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), "n", "rain")
    end = rows.agg(F.max("ts")).first()[0]
    closed = plain.filter(F.col("window_end") <= F.lit(str(end)).cast("timestamp_ntz"))
    assert _sorted(out.filter("device_id IS NOT NULL"), cols) == _sorted(closed, cols)


def test_late_readings_are_handed_on_or_counted(spark, rows, power, tmp_path):
    """The older half comes in a second run, when all of it is behind the watermark."""
    second = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    middle = rows.select(F.percentile_approx(second, 0.5)).first()[0]
    older, newer = rows.filter(second <= middle), rows.filter(second > middle)
    folder = f"{tmp_path}/feed"
    K.write_feed(newer, folder, "1 hour", "1 second", steps=1, files=1)
    out = K.run(K.mode_changes(_stream(spark, rows, folder), "1 hour"), f"{tmp_path}/job")
    windows, late = K.run_counted(K.rain_windows(_stream(spark, rows, folder), "1 hour"), f"{tmp_path}/rain")
    n = windows.count()
    assert out.filter("late").count() == 0 and late == 0 and n > 0
    older.coalesce(1).write.mode("append").parquet(folder)
    out = K.run(K.mode_changes(_stream(spark, rows, folder), "1 hour"), f"{tmp_path}/job")
    seen = [r.device_id for r in newer.select("device_id").distinct().collect()]
    assert _sorted(out.filter("late"), ["device_id", "seq", "seq2"]) == _sorted(older.filter(F.col("device_id").isin(seen)), ["device_id", "seq", "seq2"])
    windows, late = K.run_counted(K.rain_windows(_stream(spark, rows, folder), "1 hour"), f"{tmp_path}/rain")
    assert late > 0 and windows.count() == n
    on_time = power.filter(second > middle)
    changes = W.mode_transitions(on_time, "power_mode", key="device_id", order=("ts", "seq", "seq2"))
    assert _sorted(out.filter("NOT late").filter(F.col("device_id").isin(seen)), CHANGES) == _sorted(changes, CHANGES)


def test_empty_feed_and_rows_without_a_time(spark, rows, tmp_path):
    none = rows.limit(0)
    K.write_feed(none, f"{tmp_path}/feed", LATENESS, "1 second", steps=2, files=1)
    assert K.run(K.history(_stream(spark, rows, f"{tmp_path}/feed"), LATENESS), f"{tmp_path}/job").count() == 0
    untimed = rows.limit(5).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    untimed.write.parquet(f"{tmp_path}/feed2")
    assert K.run(K.mode_changes(_stream(spark, rows, f"{tmp_path}/feed2"), LATENESS), f"{tmp_path}/job2").count() == 0


def test_a_device_is_not_one_task_and_costs_no_call(spark, rows, feed, tmp_path):
    """Steps run on row frames, windows on hourly sums: no grouped Python, no window stored per hour."""
    import os

    job = K.history(_stream(spark, rows, feed), LATENESS)
    plans = []
    seen = K.Ordered(job.rows, lambda d: plans.append((out := job.step(d))._jdf.queryExecution().optimizedPlan().toString()) or out, job.columns, job.carry, job.lateness)
    assert K.run(seen, f"{tmp_path}/history").count() > 0
    assert len(plans) > 2 and not any("InPandas" in p or "TransformWithState" in p for p in plans)
    out = K.run(K.rain_windows(_stream(spark, rows, feed), LATENESS), f"{tmp_path}/rain")
    assert out.count() > 5 * spark.read.parquet(f"{tmp_path}/rain/hours").count() and not os.path.exists(f"{tmp_path}/rain/data")


def test_rain_windows_read_a_batch_once(spark, rows, feed, tmp_path):
    """Hourly sums, late readings and the watermark come from one pass over the readings."""
    passes = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        passes.add(1)
        return x
    stream = _stream(spark, rows, feed)
    K.run(K.rain_windows(stream.withColumn("precipitation", counted("precipitation")), LATENESS), f"{tmp_path}/rain")
    assert passes.value == rows.filter("ts IS NOT NULL").count() + 1       # and the record that ends the feed
    once = spark.read.parquet(f"{tmp_path}/rain/taken")
    assert once.agg(F.sum("_n")).first()[0] == passes.value
