"""Quantiles of many columns by passes over the bits of doubles."""

import numpy as np
import pytest

from floodspark.operators import scale as SC
from floodspark.session import ship_package


def test_bits_order_like_the_numbers():
    x = np.array([-np.inf, -1e300, -2.5, -5e-324, -0.0, 0.0, 5e-324, 1e-9, 2.5, 1e300, np.inf])
    u = SC.ordered_bits(x)
    assert (np.diff(u[:4].astype(object)) > 0).all() and u[4] == u[5] and all(a < b for a, b in zip(u[5:-1].tolist(), u[6:].tolist()))
    assert [SC.from_bits(int(v)) for v in u] == x.tolist()


def test_all_columns_and_ranks_together(spark):
    ship_package(spark)
    rng = np.random.default_rng(2)
    columns = {"a": rng.normal(0, 1e3, 500), "b": rng.integers(0, 4, 500).astype(float), "c": np.full(500, 7.0), "d": rng.random(500) * 1e-12, "e": -rng.random(500)}
    rows = [[None if (i + k) % 17 == 0 else float("nan") if (i + k) % 19 == 0 else float(v[i]) for k, v in enumerate(columns.values())] + [None] for i in range(500)]
    d = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*columns, "empty"])).repartition(3)
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = SC.quantile_table(d, d.columns, qs)
    for k, c in enumerate(columns):
        want = np.quantile([r[k] for r in rows if r[k] is not None and not np.isnan(r[k])], qs)
        assert got[c] == pytest.approx(want.tolist(), rel=1e-12, abs=1e-24)
    assert got["empty"] == [None] * len(qs)
    assert SC.quantile_table(d.limit(0), ["a"], [0.5]) == {"a": [None]}
    a = sorted(r[0] for r in rows if r[0] is not None and not np.isnan(r[0]))
    assert [SC.kth_smallest(d, "a", k) for k in (0, 123, len(a) - 1, len(a), -1)] == [a[0], a[123], a[-1], None, None]
