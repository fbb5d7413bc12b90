"""Metrics against brute force on a small labelled table."""

import numpy as np
import pandas as pd
import pytest

from floodspark.operators import metrics as M
from floodspark.operators import scale as SC
from floodspark.operators import split as SP


def _scores(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    s = np.round(np.clip(rng.normal(0.4 + 0.3 * y, 0.2), 0, 1), 2)     # many ties
    pdf = pd.DataFrame({"id": np.arange(n), "y": y, "score": s})
    return pdf, spark.createDataFrame(pdf)


def test_roc_auc_pair_counting(spark):
    pdf, df = _scores(spark)
    pos, neg = pdf[pdf.y == 1].score.to_numpy(), pdf[pdf.y == 0].score.to_numpy()
    exp = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert M.roc_auc(df).first()[0] == pytest.approx(exp, abs=1e-12)


def test_average_precision(spark):
    pdf, df = _scores(spark)
    P = pdf.y.sum()
    ap = 0.0
    for s in sorted(pdf.score.unique(), reverse=True):
        sel = pdf.score >= s
        tp = pdf.y[sel].sum()
        ap += (pdf.y[pdf.score == s].sum() / P) * tp / sel.sum()
    assert M.average_precision(df).first()[0] == pytest.approx(ap, abs=1e-12)


def test_threshold_sweep_brute_force(spark):
    pdf, df = _scores(spark)
    got = {r["threshold_pct"]: r for r in M.threshold_sweep(df).collect()}
    for p in range(5, 95, 5):
        pred = pdf.score >= p / 100
        assert got[p]["tp"] == int((pred & (pdf.y == 1)).sum())
        assert got[p]["fp"] == int((pred & (pdf.y == 0)).sum())


def test_quantiles_exact(spark):
    pdf, df = _scores(spark, n=501)
    for q in (0.25, 0.5, 0.75):
        assert SC.quantile(df, "score", q) == pytest.approx(float(np.quantile(pdf.score, q)))
    assert SC.kth_smallest(df, "score", 0) == pdf.score.min()
    assert SC.kth_smallest(df, "score", 250) == np.sort(pdf.score)[250]


def test_stratified_split_shares(spark):
    pdf, df = _scores(spark, n=1000)
    got = SP.stratified_split(df).toPandas()
    for cls, g in got.groupby("y"):
        assert (g.split == "test").sum() == int(np.ceil(0.2 * len(g)))


def test_histogram_total(spark):
    pdf, df = _scores(spark)
    h = M.histogram(df, "score").toPandas()
    assert len(h) == 30 and h.n.sum() == len(pdf)
