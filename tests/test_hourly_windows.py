"""Rain windows made from hourly sums against Spark's own sliding windows."""

import datetime as dt

from pyspark.sql import functions as F

from floodspark.operators import windows as W


def test_hourly_windows_equal_sliding_windows(spark):
    at = dt.datetime(1969, 12, 31, 20, 10)
    rows = [(d, at + dt.timedelta(minutes=m), v) for d, m, v in (
        ("a", 0, 1.0), ("a", 5, 2.0), ("a", 70, None), ("a", 60 * 30, 4.0), ("a", 60 * 30 + 9, None), ("b", 60 * 24 * 9, None), (None, 3, 8.0), (None, 3, 8.0))]
    df = spark.createDataFrame([*rows, ("a", None, 5.0)], "k string, ts timestamp_ntz, x double")
    w = F.window("ts", "24 hours", "1 hour")
    plain = df.filter("ts IS NOT NULL").groupBy("k", w.alias("w")).agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n")).select("k", "w.start", "w.end", "s", "n")
    got = W.hourly_windows(df, "k", "ts", "x", 24)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, plain.collect())))


def test_no_row_is_shuffled_once_per_window(spark):
    df = spark.range(200).select(F.lit("a").alias("k"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:30:00' + make_dt_interval(0, CAST(id AS INT))").alias("ts"), F.lit(1.0).alias("x"))
    plan = W.hourly_windows(df, "k", "ts", "x", 24)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    assert W.hourly_windows(df, "k", "ts", "x", 24).agg(F.max("n"), F.count(F.lit(1))).first()[:] == (24, 223)


def test_sums_are_made_once_for_a_run_of_equal_windows(spark):
    """One hour alone is in 24 windows of one sum each; dense hours and gaps give every window its own."""
    panes = spark.createDataFrame([("a", 100, 1.5, 2), *[("b", h, float(h), 1) for h in (*range(30, 60), 83, 84, 200)], ("c", -5, None, 3)], "k string, _h long, _sum double, _n long")
    out = W.slide_hours(panes, "k", 24)
    want = {}
    for k, h, s, n in [tuple(r) for r in panes.collect()]:
        for start in range(h - 23, h + 1):
            a, b = want.get((k, start), (None, 0))
            want[k, start] = (a if s is None else (a or 0.0) + s, b + n)
    hour = "timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', window_start)"
    assert {(r[0], r[1]): (r[2], r[3]) for r in out.select("k", F.expr(hour), "rain_sum", "n").collect()} == want
    assert out.count() == len(want) and out.filter("window_end <> window_start + INTERVAL 24 HOUR").count() == 0
    tree = out._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("Generate explode") == 3                             # spans, runs of windows, windows
