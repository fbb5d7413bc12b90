"""As-of join against brute force: ties, NULL keys and values, rows before the first step, blocks of a few rows."""

import random

import pytest

from floodspark.operators import joins as J


@pytest.mark.parametrize("keyed", [True, False])
def test_asof_equals_brute_force(small_blocks, keyed):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", None, "only rows"]), rng.choice([None, *range(60)])) for i in range(200)]
    steps = [(1000 + i, rng.choice(["a", "b", None, "only steps"]), rng.choice([None, *range(10, 60)]), rng.choice([None, 1.5, 2.5, 3.5]), i) for i in range(60)]
    df = small_blocks.createDataFrame(rows, "seq long, k string, at int")
    st = small_blocks.createDataFrame(steps, "seq long, k string, at int, v double, w long")
    got = {r.seq: (r.v, r.w) for r in J.asof_join(df, st, "at", ["v", "w"], "k" if keyed else ()).collect()}

    def last(k, at):
        some = [(s[2], s[0], s[3], s[4]) for s in steps if s[2] is not None and at is not None and s[2] <= at and (s[1] == k or not keyed)]
        return max(some, key=lambda s: s[:2])[2:] if some else (None, None)
    assert got == {i: last(k, at) for i, k, at in rows}


def test_asof_of_nothing(spark):
    df = spark.createDataFrame([(1, 5)], "seq long, at int")
    none = df.limit(0).selectExpr("seq", "at", "1.0D AS v")
    assert [tuple(r) for r in J.asof_join(df, none, "at", ["v"]).collect()] == [(1, 5, None)]
    assert J.asof_join(df.limit(0), none, "at", ["v"]).count() == 0
