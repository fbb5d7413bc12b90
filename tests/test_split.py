"""Stratified split: order by (hash, id) against plain Python, wide ids, NULL ids, small classes."""

import hashlib
import math

from floodspark.operators import split as SP


def _expected(rows, share=0.2, seed=42):
    key = lambda r: (int(hashlib.md5(f"{r[0]}:{seed}".encode()).hexdigest()[:SP.HASH_DIGITS], 16), r[0])
    test = set()
    for cls in {r[1] for r in rows}:
        part = sorted((r for r in rows if r[1] == cls), key=key)
        test |= {r[0] for r in part[:math.ceil(share * len(part))]}
    return test


def _test_ids(df):
    return {r.id for r in SP.stratified_split(df).filter("split = 'test'").collect()}


def test_ids_that_differ_by_powers_of_two(spark):
    rows = [(i + (j << 31), i % 2) for i in range(40) for j in range(3)]
    assert _test_ids(spark.createDataFrame(rows, "id long, y int")) == _expected(rows)


def test_equal_hashes_are_cut_by_id(spark, monkeypatch):
    monkeypatch.setattr(SP, "HASH_DIGITS", 1)
    rows = [(i, i % 3 % 2) for i in range(100)]
    assert _test_ids(spark.createDataFrame(rows, "id long, y int")) == _expected(rows)


def test_rows_without_an_id_are_train_rows_and_empty_is_empty(spark):
    rows = [(i, i % 2) for i in range(20)]
    d = spark.createDataFrame(rows + [(None, 1)] * 5, "id long, y int")
    assert _test_ids(d) == _expected(rows)
    assert SP.stratified_split(d.limit(0)).count() == 0
