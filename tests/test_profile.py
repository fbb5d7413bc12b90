"""Dataset profile: counts, names and stations, in one row and as a JSON document."""

import json

from floodspark.operators import profile as PR


def test_profile_names_and_counts(spark):
    rows = [("2024-01-01 00:00:00", "b", 1.0, 5, 0, 0), ("2024-01-02 00:00:00", "a", None, 6, 1, 3),
            ("2024-01-03 00:00:00", "a", 2.0, 7, 1, 2), ("2024-01-03 00:00:00", None, 2.0, 8, 0, 0)]
    df = (spark.createDataFrame(rows, "t string, location string, rain double, seq long, teve_enchente int, nivel_alerta int")
          .selectExpr("CAST(t AS timestamp) AS datetime", "location", "rain", "seq", "teve_enchente", "nivel_alerta"))
    doc = json.loads(PR.profile_json(PR.dataset_profile(df, skip=["seq"])).first()["json"])
    assert doc["features"] == ["rain"] and doc["n_features"] == 1
    assert doc["targets"] == ["teve_enchente", "nivel_alerta"] and doc["locations"] == ["a", "b"]
    assert (doc["n_rows"], doc["n_columns"], doc["n_locations"], doc["n_flood"], doc["flood_rate"]) == (4, 6, 2, 2, 0.5)
    assert [doc[f"n_alert_{i}"] for i in range(4)] == [2, 0, 1, 1]


def test_profile_without_targets_and_rows(spark):
    df = spark.createDataFrame([], "datetime timestamp, location string, rain double")
    row = PR.dataset_profile(df).first()
    assert (row.n_rows, row.features, row.targets, row.locations) == (0, ["rain"], [], [])
