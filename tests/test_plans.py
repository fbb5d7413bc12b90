"""Physical-plan guards: no cartesian products or nested-loop joins; row windows are never
partitioned by the station alone; column pruning reaches the parquet scan."""

import re

import pytest

import __spark_entry__ as E

from paths import SF0001

KEYS = ["alert_distribution", "rolling_sum", "gap_fill", "flood_label", "name_match", "river_status",
        "flood_events", "threshold_sweep", "roc_auc", "mode_evaluation", "device_history", "left_join",
        "dedupe_first", "scenario_what_if", "stratified_split", "knn_join"]


def _plan(spark, key):
    return E.queries()[key](spark, SF0001)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", KEYS)
def test_no_cartesian(spark, key):
    plan = _plan(spark, key)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_windows_partition_by_frame(spark):
    plan = _plan(spark, "rolling_sum")
    specs = re.findall(r"windowspecdefinition\(([^,]+), ([^,]+),", plan)
    assert specs and all("_frame" in b or "_bkt" in b or "location" not in a for a, b in specs)


def test_scan_prunes_columns(spark):
    plan = _plan(spark, "critical_readings")
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in plan
    plan = _plan(spark, "sensor_calibration")
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int>" in plan


def test_filter_pushed_to_scan(spark):
    assert "PushedFilters: [IsNotNull(value)]" in _plan(spark, "outlier_filter")


def test_one_window_path(spark):
    """Halo frames at every block size, with equal rows."""
    from floodspark.operators import frames as FR
    from floodspark.plans import bindings as B
    r = B.readings(spark, SF0001)
    old = spark.conf.get("floodspark.frames.blockRows")
    rows = []
    try:
        for size in ("1000000", "5"):
            spark.conf.set("floodspark.frames.blockRows", size)
            d = FR.with_row_features(r, "location", ["datetime", "seq"], {"s": FR.rolling_sum("precipitation_mm", 3)})
            assert "_frame" in d._jdf.queryExecution().executedPlan().toString()
            rows.append(sorted(d.collect()))
    finally:
        spark.conf.set("floodspark.frames.blockRows", old)
    assert rows[0] == rows[1]
