"""The fit uses every labelled row, however many shards it takes."""

import pytest
from pyspark.sql import functions as F

from floodspark.llm.toxicity import classify, train


def _rows(n):
    return [(i, f"word{i % 7} {'vile' if i % 4 == 0 else 'kind'} word{i % 5} thing{i}", "en" if i % 2 else None, int(i % 4 == 0)) for i in range(n)]


@pytest.mark.parametrize("shard_rows", [100_000, 150])
def test_all_labelled_rows_are_fitted_or_calibrated_on(spark, shard_rows):
    d = spark.createDataFrame(_rows(600), "doc_id long, text string, lang string, toxic int").cache()
    model = train(d.drop("toxic"), d.select("doc_id", "toxic"), shard_rows=shard_rows)
    shards = -(-600 // shard_rows)
    assert 600 * 0.8 - shards <= model["fit_rows"] <= 600 * 0.8              # every fifth row of a shard calibrates
    out = classify(d, model, "doc_id").join(d.select("doc_id", "toxic"), "doc_id")
    assert out.filter(F.col("predicted") != F.col("toxic")).count() == 0
    again = train(d.repartition(7).drop("toxic"), d.select("doc_id", "toxic").repartition(5), shard_rows=shard_rows)
    assert (again["T"] == model["T"]).all() and again["cut"] == model["cut"] and again["lang_cuts"] == model["lang_cuts"]
