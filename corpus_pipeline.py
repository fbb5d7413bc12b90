"""Training-data pipeline: toxicity, line dedup, near dedup, mixing to target weights, packing.

``STAGES`` are (name, function) pairs; every function takes (spark, docs, sf_dir) and returns a frame
that is written and read again as the next stage's docs. All but the last keep the columns of
``documents``, extra ones too, whatever they are called. NULL and empty texts and repeated rows are
handled as the operators say; rows without a doc_id are never near copies; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodspark.llm.catalog import held_out
from floodspark.llm.common import cut, fresh_folder, ready, table
from floodspark.llm.line_dedup import line_dedup
from floodspark.llm.mixing import mix_documents
from floodspark.llm.near_dedup import near_duplicates
from floodspark.llm.packing import pack_documents
from floodspark.llm.toxicity import classify, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that reach their language's calibrated threshold; learns from the labels that are not held out."""
    ready(spark)
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out())
    aside = docs.select(*[F.col(c).alias(f"in_{c}") for c in docs.columns], "text", "lang")
    good = classify(aside, model, *aside.drop("text").columns).filter("score < lang_threshold")
    return good.select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out repeated and nearly repeated lines; documents that lose all their words go."""
    ready(spark)
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    aside = docs.select("doc_id", "text", *[F.col(c).alias(f"in_{c}") for c in rest])
    kept = line_dedup(aside, keep=[f"in_{c}" for c in rest]).filter("NOT emptied")
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text")}
    return kept.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"in_{c}")).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8)."""
    ready(spark)
    gone = near_duplicates(docs, shingle=5, percent=80).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    ready(spark)
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixture's documents placed in sequences of 4096 tokens."""
    ready(spark)
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_repeats), ("near_dedup", near_copies),
          ("mixing", mixing), ("packing", packing)]

#: The trained classifier and the tokenizer have no SQL form; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = fresh_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
