"""Row-window operators on skew-safe frames equal the plain per-key computation (pandas)."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from floodspark.operators import frames as FR
from floodspark.operators import windows as W


def _data(n=400, seed=1):
    rng = np.random.default_rng(seed)
    base = dt.datetime(2024, 1, 1)
    keys = np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b", "c"], n))   # one key ~40 % of rows
    ts = [base + dt.timedelta(minutes=int(m)) for m in rng.integers(0, 3000, n)]
    v = rng.random(n) * 10
    v[rng.random(n) < 0.2] = np.nan
    return pd.DataFrame({"location": keys, "datetime": ts, "seq": np.arange(n), "x": v})


def _sdf(spark, pdf):
    return spark.createDataFrame(pdf.assign(x=pdf.x.astype(object).where(pdf.x.notna(), None)),
                                 "location string, datetime timestamp_ntz, seq long, x double")


def _ref(pdf):
    return pdf.sort_values(["location", "datetime", "seq"]).groupby("location", group_keys=False)


def test_row_index_exact(small_blocks):
    pdf = _data()
    got = FR.row_index(_sdf(small_blocks, pdf), "location", ["datetime", "seq"]).toPandas()
    exp = _ref(pdf).apply(lambda g: g.assign(_pos=np.arange(len(g))))
    m = got.merge(exp[["seq", "_pos"]], on="seq", suffixes=("", "_e"))
    assert len(m) == len(pdf) and (m["_pos"] == m["_pos_e"]).all()


@pytest.mark.parametrize("n", [3, 12, 24])
def test_rolling_sum_mean_std(small_blocks, n):
    pdf = _data()
    specs = {"s": FR.rolling_sum("x", n), "m": FR.rolling_mean_full("x", n), "sd": FR.rolling_std_full("x", n),
             "d": FR.diff("x", 2), "pm": FR.rolling_mean_partial("x", n)}
    got = FR.with_row_features(_sdf(small_blocks, pdf), "location", ["datetime", "seq"], specs).toPandas()
    exp = _ref(pdf).apply(lambda g: g.assign(
        s=g.x.rolling(n, min_periods=1).sum().where(g.x.rolling(n, min_periods=1).count() > 0),
        m=g.x.rolling(n).mean(), sd=g.x.rolling(n).std(), d=g.x.diff(2), pm=g.x.rolling(n, min_periods=1).mean()))
    m = got.merge(exp, on="seq", suffixes=("", "_e"))
    assert len(m) == len(pdf)
    for c in ["s", "m", "sd", "d", "pm"]:
        a, b = m[c].astype(float), m[c + "_e"].astype(float)
        assert ((a - b).abs() < 1e-9).where(a.notna() & b.notna(), a.isna() == b.isna()).all(), c


def test_gap_fill(small_blocks):
    pdf = _data()
    got = W.gap_fill(_sdf(small_blocks, pdf), ["x"], key="location", order=("datetime", "seq")).toPandas()
    exp = _ref(pdf).apply(lambda g: g.assign(x=g.x.ffill().bfill().fillna(0)))
    m = got.merge(exp, on="seq", suffixes=("", "_e"))
    assert np.allclose(m.x.astype(float), m.x_e.astype(float))


def test_floored_running_total_matches_loop(small_blocks):
    pdf = _data().assign(x=lambda d: (d.x.fillna(5.0) - 5.0) / 3)
    sdf = _sdf(small_blocks, pdf).withColumn("start", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(2.0))
    got = FR.floored_running_total(sdf, "location", ["datetime", "seq"], "x", "start", 0.5, "lvl").toPandas()

    def loop(g):
        lvl, out = 2.0, []
        for c in g.x:
            lvl = max(0.5, lvl + c)
            out.append(lvl)
        return g.assign(lvl=out)
    exp = _ref(pdf).apply(loop)
    m = got.merge(exp, on="seq", suffixes=("", "_e"))
    assert np.allclose(m.lvl, m.lvl_e, atol=1e-9)


def test_position_and_count(small_blocks):
    pdf = _data()
    got = FR.position_and_count(_sdf(small_blocks, pdf), "location", ["datetime", "seq"]).toPandas()
    exp = _ref(pdf).apply(lambda g: g.assign(pos=np.arange(1, len(g) + 1), n=len(g)))
    m = got.merge(exp, on="seq", suffixes=("", "_e"))
    assert (m.pos == m.pos_e).all() and (m.n == m.n_e).all()


def test_positions_in_a_burst(spark):
    """90 % of the rows of one key within a minute, ties by the minute: positions stay exact and parts stay even."""
    pdf = _data(3000)
    pdf.loc[pdf.index % 10 != 0, "location"] = "hot"
    pdf.loc[pdf.index % 10 != 0, "datetime"] = dt.datetime(2024, 1, 2)
    d = _sdf(spark, pdf)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # else these few rows are one part
    try:
        _burst(spark, pdf, d)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def _burst(spark, pdf, d):
    parts = FR.ranged(d, ["location", "datetime", "seq"]).selectExpr("shiftright(_number, 33) AS p").groupBy("p").count().toPandas()["count"]
    assert len(parts) > 1 and parts.max() < 2 * len(pdf) / int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = FR.row_index(d, "location", ["datetime", "seq"]).toPandas()
    exp = _ref(pdf).apply(lambda g: g.assign(_pos=np.arange(len(g))))
    m = got.merge(exp[["seq", "_pos"]], on="seq", suffixes=("", "_e"))
    assert len(m) == len(pdf) and (m["_pos"] == m["_pos_e"]).all()


def test_row_index_of_null_keys_and_nothing(spark):
    d = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "location string, seq long")
    assert sorted((r.seq, r._pos) for r in FR.row_index(d, "location", ["seq"]).collect()) == [(1, 0), (2, 1), (5, 0)]
    assert FR.row_index(d.limit(0), "location", ["seq"]).count() == 0


def test_position_and_count_joins_no_rows_by_key_alone(small_blocks):
    """The few rows per key and part bring count and totals along; rows without a key are left out."""
    rows = [(k, i, float(i % 7)) for k in ("a", "b") for i in range(40)] + [(None, 1, 1.0)]
    d = small_blocks.createDataFrame(rows, "location string, seq long, x double")
    got = FR.position_and_count(d, "location", ["seq"], count="_n", totals={"least": (FR.F.min("x"), FR.F.min)})
    assert sorted((r.location, r.seq, r.pos, r._n, r.least) for r in got.collect()) == [(k, i, i + 1, 40, 0.0) for k in ("a", "b") for i in range(40)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
