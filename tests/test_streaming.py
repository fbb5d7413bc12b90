"""Streaming jobs equal their batch twins on the same rows, whatever files the feed comes in."""

import pytest
from pyspark.sql import functions as F

from floodspark.operators import telemetry as TM
from floodspark.operators import windows as W
from floodspark.plans import bindings as B
from floodspark.streaming import telemetry as ST

from paths import SF0001

HISTORY = ["device_id", "seq", "seq2", "precipitation_ma_12", "water_level_ma_24", "precip_48h", "water_rise_rate"]
CHANGES = ["device_id", "seq", "old_mode", "new_mode"]


def _sorted(df, cols):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect()), key=repr)


def _power(spark, sf):
    return TM.with_power(TM.calibrate(B.telemetry(spark, sf)))


def _modes(df):
    return W.mode_transitions(df, "power_mode", key="device_id", order=("ts", "seq", "seq2"))


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """The feed dealt at random over the four files of a folder."""
    folder = str(tmp_path_factory.mktemp("shuffled"))
    spark.read.parquet(f"{SF0001}/lineitem.parquet").repartition(4, F.rand(1)).write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.fixture(scope="module")
def by_time(spark, tmp_path_factory):
    """Four files that follow each other in event time, but for rows up to about an hour late."""
    folder = str(tmp_path_factory.mktemp("by_time"))
    raw = spark.read.parquet(f"{SF0001}/lineitem.parquet").repartition(1).cache()
    row = B.telemetry_from(raw).select("ts").collect()
    order = sorted(range(len(row)), key=lambda k: (row[k].ts.timestamp() + (k * 7919) % 3500))
    rows = raw.collect()
    n = len(rows) // 4 + 1
    for k in range(4):
        part = spark.createDataFrame([rows[i] for i in order[k * n:(k + 1) * n]], raw.schema)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/lineitem.parquet")
    return folder


def _feed(spark, folder):
    return ST.decode(ST.source(spark, folder, max_files=1), wire=False)


def test_single_file_equals_batch(spark):
    out, late = ST.run_in_order(_feed(spark, SF0001), "t_history", ST.history, 47)
    assert _sorted(out, HISTORY) == _sorted(TM.device_history(_power(spark, SF0001)), HISTORY) and late.count() == 0


def test_shuffled_files_equal_batch(spark, shuffled):
    pw = _power(spark, shuffled)
    out, late = ST.run_in_order(_feed(spark, shuffled), "t_history", ST.history, 47)
    assert _sorted(out, HISTORY) == _sorted(TM.device_history(pw), HISTORY) and late.count() == 0
    out, _ = ST.run_in_order(_feed(spark, shuffled), "t_modes", ST.mode_changes, 1)
    assert _sorted(out, CHANGES) == _sorted(_modes(pw), CHANGES)


def test_bounded_lateness_equals_batch_across_batches(spark, by_time):
    out, late = ST.run_in_order(_feed(spark, by_time), "t_history", ST.history, 47, lateness="1 hour")
    assert late.count() == 0
    assert _sorted(out, HISTORY) == _sorted(TM.device_history(_power(spark, by_time)), HISTORY)
    out, _ = ST.run_in_order(_feed(spark, by_time), "t_modes", ST.mode_changes, 1, lateness="1 hour")
    assert _sorted(out, CHANGES) == _sorted(_modes(_power(spark, by_time)), CHANGES)


def test_late_rows_are_handed_on(spark, shuffled):
    pw = _power(spark, shuffled)
    out, late = ST.run_in_order(_feed(spark, shuffled), "t_late", ST.history, 47, lateness="1 hour")
    n = late.count()
    assert n > 0 and out.count() + n == pw.count()
    admitted = pw.join(late.select("device_id", "ts", "seq", "seq2"), ["device_id", "ts", "seq", "seq2"], "left_anti")
    assert _sorted(out, HISTORY) == _sorted(TM.device_history(admitted), HISTORY)


def test_dedupe_and_rain_windows_of_shuffled_files(spark, shuffled):
    pw = _power(spark, shuffled)
    got = ST.run_available(ST.dedupe(_feed(spark, shuffled)), "t_dedupe")
    assert _sorted(got, ["device_id", "ts"]) == _sorted(pw.select("device_id", "ts").distinct(), ["device_id", "ts"])
    cols = ["device_id", "window_start", "n"]
    many = ST.run_rain_windows(_feed(spark, shuffled))
    assert _sorted(many, cols) == _sorted(ST.run_rain_windows(_feed(spark, SF0001)), cols)
    end = pw.agg(F.max("ts")).first()[0]
    hour = F.window(F.col("ts").cast("timestamp"), "24 hours", "1 hour")
    plain = pw.groupBy("device_id", hour.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    plain = plain.select("device_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("e"), "n")
    plain = plain.filter(F.col("e") <= F.lit(str(end)).cast("timestamp_ntz") - F.expr("INTERVAL 1 HOUR"))
    assert _sorted(many, cols) == _sorted(plain, cols)


def test_wire_round_trip(spark):
    d = _power(spark, SF0001).withColumn("water_rise_rate", F.lit(0.0))
    d = d.withColumn("risk_score", F.lit(0.5)).withColumn("alert_level", F.lit(1)).withColumn("flood_predicted", F.lit(0))
    back = TM.from_wire(TM.to_wire(d))
    assert back.count() == d.count()
