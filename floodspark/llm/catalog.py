"""Queries of this subpackage (name -> plan) and their DuckDB oracles (name -> SQL)."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from .common import ready, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

_WS = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    def deco(fn):
        @wraps(fn)
        def run(spark, sf_dir):
            ready(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run
    return deco


@query("op5_mix_sources", f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS BIGINT) AS weight, 2 * source_size AS cap FROM s),
f AS (SELECT *, row_number() OVER o AS place,
        (CAST(sum(source_size) OVER () AS BIGINT)::DOUBLE * 1.5::DOUBLE
          - coalesce(CAST(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0)::DOUBLE)
        / (CAST(sum(weight) OVER () AS BIGINT) - coalesce(CAST(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))::DOUBLE AS level
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source NULLS LAST)),
l AS (SELECT arg_min(level, place) AS level FROM f WHERE level * weight <= cap),
t AS (SELECT source, source_size, CASE WHEN l.level IS NULL THEN cap::DOUBLE ELSE least(l.level * weight, cap::DOUBLE) END AS target FROM f, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT d.doc_id, d.size, r.source_size, r.target,
  CAST(d.size * (floor(r.rate) + CAST(CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 12)) AS BIGINT)::DOUBLE / 281474976710656.0::DOUBLE
     < r.rate - floor(r.rate) AS BIGINT)) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source""")
def op5_mix_sources(spark, sf_dir):
    from .mixing import mix_report
    return mix_report(table(spark, sf_dir, "documents"))


@query("op7_nra_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""")
def op7_nra_top_k(spark, sf_dir):
    from .common import cut
    from .topk import quantised, top_k
    v = cut(quantised(table(spark, sf_dir, "embeddings")))
    return top_k(v.filter("vec_id % 20 = 0"), v, k=20)


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@query("op9_warc_round_trip", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first_id, sha1(body) AS h FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('{_B32}',
     CAST(((CAST(('0x' || substr(h, CAST(floor(i / 4) AS INTEGER) * 5 + 1, 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER) + 1, 1)),
     'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL WHEN page_id IS NULL THEN NULL ELSE first_id END AS refers_to
FROM f""")
def op9_warc_round_trip(spark, sf_dir):
    from .warc import warc_round_trip
    return warc_round_trip(spark, table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


@query("op10_exact_dedup", f"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""")
def op10_exact_dedup(spark, sf_dir):
    """The history is the older half of the id range, the rest arrives as a new batch."""
    from .exact_dedup import exact_dedup
    docs = table(spark, sf_dir, "documents")
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if lo is None else (lo + hi) // 2
    return exact_dedup(docs, F.col("doc_id") <= F.lit(middle)).drop("in_history")


_SHINGLES = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN s sa ON p.a = sa.doc_id JOIN s sb ON p.b = sb.doc_id WHERE 100 * n >= 80 * (len(sa.s) + len(sb.s) - n)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON r.v = l.a AND r.c < l.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.c) AS component_id, min(r.c) = s.doc_id AS kept
FROM s JOIN r ON s.doc_id = r.v GROUP BY s.doc_id, s.s"""


@query("op3_near_duplicates", _SHINGLES)
def op3_near_duplicates(spark, sf_dir):
    from .near_dedup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80).drop("n_words")


@query("op1_repeated_passages", f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 48, 1))) AS i, w FROM w WHERE len(w) >= 50),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM g),
m AS (SELECT h, min(doc_id) AS first FROM x GROUP BY h),
c AS (SELECT DISTINCT x.doc_id, unnest(range(x.i, x.i + 50)) AS p FROM x JOIN m ON x.h = m.h WHERE m.first < x.doc_id),
k AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(len(k.gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN k.gone IS NULL THEN array_to_string(w.w, ' ')
    ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(w.w) + 1), lambda i: NOT list_contains(k.gone, i)), lambda i: w.w[i]), ' '), '') END) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id""")
def op1_repeated_passages(spark, sf_dir):
    from .substring_dedup import substring_dedup
    return substring_dedup(table(spark, sf_dir, "documents"), window=50).drop("n_repeats")


@query("op6_line_dedup")
def op6_line_dedup(spark, sf_dir):
    from .line_dedup import line_dedup
    return line_dedup(table(spark, sf_dir, "documents")).withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256)).drop("text")


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark, sf_dir):
    from .packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"))


@query("op2_token_counts")
def op2_token_counts(spark, sf_dir):
    from .token_counts import token_counts
    return token_counts(table(spark, sf_dir, "documents"))


def held_out():
    """Rows that no label may be learnt from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    from .toxicity import classify, train
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out())
    return classify(docs, model, "doc_id", "lang").drop("lang").withColumn("held_out", F.coalesce(held_out(), F.lit(False)))


def _round(n: int) -> str:
    """Assignment to centroids c{n}, distances by the scalar product, and the centroids after it."""
    return f""", d{n} AS (SELECT v.vec_id, v.row, c.c, c.q AS centre, CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
  FROM v CROSS JOIN c{n} c),
a{n} AS (SELECT row, any_value(vec_id) AS vec_id, arg_min(c, (distance, c)) AS c, min(distance) AS distance FROM d{n} GROUP BY row),
u{n} AS (SELECT a.c, unnest(v.q) AS x, unnest(range(0, 64)) AS i FROM a{n} a JOIN v USING (row)),
m{n} AS (SELECT c, list(x ORDER BY i) AS q FROM (SELECT c, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM u{n} GROUP BY c, i) GROUP BY c),
c{n + 1} AS (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{n} c LEFT JOIN m{n} m ON c.c = m.c)"""


@query("op11_centroid_clusters", """
WITH v AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c1 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, q) - 1 AS INTEGER) AS c, q FROM v
  QUALIFY c < 16)""" + "".join(map(_round, (1, 2, 3))) + """,
d4 AS (SELECT v.vec_id, v.row, c.c, CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
  FROM v CROSS JOIN c4 c),
a4 AS (SELECT row, any_value(vec_id) AS vec_id, arg_min(c, (distance, c)) AS c, min(distance) AS distance FROM d4 GROUP BY row)
SELECT a.vec_id, a.c AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c4.q, ',')) AS centroid_sha256
FROM a4 a JOIN c4 ON a.c = c4.c""")
def op11_centroid_clusters(spark, sf_dir):
    from .centroids import cluster_vectors, usable
    return cluster_vectors(usable(table(spark, sf_dir, "embeddings"))).drop("n_fetched")


@query("op12_byte_bpe")
def op12_byte_bpe(spark, sf_dir):
    from .byte_bpe import round_trip
    return round_trip(table(spark, sf_dir, "documents"))


@query("op13_token_alignment")
def op13_token_alignment(spark, sf_dir):
    from .alignment import align_tokens
    return align_tokens(table(spark, sf_dir, "documents"))
