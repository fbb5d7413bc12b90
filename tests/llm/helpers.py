import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def docs(spark, rows):
    """rows: (doc_id, text[, source]) -> a documents frame of several partitions."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def prose(rng: random.Random, n: int, vocabulary: int = 300) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


#: Texts that every operator must take: NULL, empty, white space only, one word, other scripts, no spaces.
ODD = [None, "", " \t\n\x0b\x0c\r ", "one", "ÄÖÜ été ñandú 漢字 ☃", "x" * 5000, "a b  c", "'s it's . , !! 3 44"]
