"""Operators 11 to 13 against brute force on small tables."""

import hashlib
import os
import random
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from floodspark.llm import alignment as AL
from floodspark.llm import byte_bpe as BB
from floodspark.llm import centroids as CE
from floodspark.llm.catalog import SQL
from floodspark.llm.packing import vocabulary

from llm.helpers import ODD, docs, prose

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
SEAMS = ["<|endoftext|> stays text", "x▁y", "a b c　d", "tab\tend\r\n\r\n  ", "   lead", "'s 's''s I'll", "\x00\x1c\x1f", "é é", "😀 family 👨‍👩‍👧", "1234567 8 9"]


def _texts():
    rng = random.Random(5)
    return [*ODD, *SEAMS, *(" ".join(prose(rng, rng.randrange(1, 120))) + rng.choice(["", "\n", " . "]) for _ in range(40))]


def _rows():
    rows = [(i, t) for i, t in enumerate(_texts())]
    return rows + [(3, "one"), (3, "one"), (None, "no id here"), (None, "no id here"), (None, None)]


# ---- operator 12 -----------------------------------------------------------------------------------

def _tiktoken(path=None):
    return BB._encoder(path or vocabulary("byte_bpe_multi_50k.tiktoken"), BB.word_pattern())


def _key(r):
    return repr(r)


@pytest.mark.parametrize("slice_bytes", [50, 4_000_000])
def test_bpe_ids_and_bytes(spark, slice_bytes):
    rows = _rows()
    got = BB.decode(BB.encode(docs(spark, rows), slice_bytes=slice_bytes)).collect()
    want = [(d, tuple(_tiktoken().encode_ordinary(t or "")), (t or "").encode()) for d, t in rows]
    assert sorted(((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.bytes)) for r in got), key=_key) == sorted(want, key=_key)


def test_bpe_digests_empty_table_and_clashing_names(spark):
    rows = _rows()
    extra = docs(spark, rows).withColumns({c: F.lit("x") for c in ("ids", "bytes", "slice", "bucket", "words", "positions", "sizes")})
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in BB.round_trip(extra).collect()}
    assert got == {(d, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
                   for d, t in rows for i in [_tiktoken().encode_ordinary(t or "")]}
    assert BB.round_trip(docs(spark, [])).count() == 0


def test_bpe_each_distinct_word_is_encoded_once():
    seen = []

    class Spy:
        def encode_ordinary(self, w):
            seen.append(w)
            return [1]
    import pyarrow as pa
    old, BB._encoder = BB._encoder, lambda *_: Spy()
    try:
        t = pa.Table.from_pylist([{"bucket": 0, "slice": s, "packed": BB.pack_strings([b"a", b" b", str(s).encode()])} for s in range(5)], BB._ASK)
        BB._encode("", "")(t)
    finally:
        BB._encoder = old
    assert sorted(seen) == sorted(["a", " b", *map(str, range(5))])


def test_bpe_plan_reads_one_exchange_twice(spark):
    frame = BB.encode(docs(spark, _rows()))
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "CartesianProduct" not in plan


# ---- operator 13 -----------------------------------------------------------------------------------

@lru_cache
def _libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model")), {c: b for b, c in AL._byte_letters().items()}


def _plain_tokens(text):
    """(A bytes and ids, B bytes and ids) or None, by the libraries themselves."""
    if not text:
        return None
    a, m, letter = _libraries()
    enc = a.encode(" " + text, add_special_tokens=False)
    one = [(i, bytes(letter[c] for c in t)) for i, t in zip(enc.ids, enc.tokens)]
    two = [(i, bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()) for i in m.encode(text)]
    full = (" " + text).encode()
    return (one, two) if all(b"".join(t for _, t in x) == full for x in (one, two)) else None


def _spans(tokens):
    out, at = [], 0
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def _brute(rows):
    parts = []
    for d, t in rows:
        both = _plain_tokens(t)
        if both is None:
            parts.append((d, [], [], [], []))
            continue
        a, b = map(_spans, both)
        links = [(x, y) for x, s, e in a for y, u, v in b if s < v and u < e]
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [([x for x, _, e in a if lo < e <= hi], [y for y, _, e in b if lo < e <= hi]) for lo, hi in zip([0, *ends], ends)]
        parts.append((d, a, b, links, groups))
    count = {}
    for *_, links, _ in parts:
        for p in set(links):
            count[p] = count.get(p, 0) + 1
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for d, a, b, links, groups in parts:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((d, len(a), len(b), len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=_key)


_COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("slice_bytes", [60, 2_000_000])
def test_alignment_equals_brute_force(spark, slice_bytes):
    rows = [(d, t if t is None or len(t) < 700 else t[:700]) for d, t in _rows()]
    frame = docs(spark, rows).withColumns({c: F.lit(1) for c in ("slice", "bucket", "pairs", "n_a", "groups")})
    got = sorted((tuple(r[c] for c in _COLUMNS) for r in AL.align_tokens(frame, slice_bytes=slice_bytes).collect()), key=_key)
    assert got == _brute(rows)


def test_alignment_of_nothing(spark):
    assert AL.align_tokens(docs(spark, [])).count() == 0
    got = AL.align_tokens(docs(spark, [(1, None), (2, ""), (3, "x▁y")])).collect()
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in got) and len(got) == 3


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 'é漢.\n1"), min_size=1, max_size=30), min_size=1, max_size=6))
def test_align_kernel(texts):
    first, second = AL.byte_level(vocabulary("byte_bpe_50k.json")), AL.pieces(vocabulary("piece_bpe_32k.model"))
    good, numbers, digest, pairs, entry, times = AL.align(texts, first, second)
    want = [r for r in ((t, _plain_tokens(t)) for t in texts) if r[1]]
    assert good.sum() == len(want)
    for k, (_, (a, b)) in enumerate(want):
        assert numbers[0][k] == len(a) and numbers[1][k] == len(b)
        links = [(x, y) for x, s, e in _spans(a) for y, u, v in _spans(b) if s < v and u < e]
        mine = {int(pairs[e % len(pairs)]): int(n) for e, n in zip(entry, times) if e // len(pairs) == k}
        assert mine == {x * len(second.table) + y: links.count((x, y)) for x, y in set(links)} and numbers[3][k] == len(links)


def test_windows_of_equal_hash_are_told_apart(monkeypatch):
    """All hashes equal: every window still gets its own alignment."""
    first, second = AL.byte_level(vocabulary("byte_bpe_50k.json")), AL.pieces(vocabulary("piece_bpe_32k.model"))
    texts = ["one two three one two", "naïve ☃ snow one"]
    want = AL.align(texts, first, second)
    monkeypatch.setattr(AL, "mix", lambda x, salt=0: np.zeros_like(x))
    got = AL.align(texts, first, second)
    assert all(np.array_equal(x, y) for x, y in zip(want, got))


# ---- operator 11 -----------------------------------------------------------------------------------

def _vectors(spark, n=300, dim=64, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.2, (n, dim)) + rng.normal(0, 0.4, (5, dim))[rng.integers(0, 5, n)]
    x[0, 0], x[1] = 40.0, x[2]                                           # an outlier and a repeated vector
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    rows += [(7, rows[7][1]), (None, rows[9][1]), (900, None), (901, [0.0] * 63), (902, [float("nan")] * dim), (903, [None] * dim), (904, [float("inf")] + [0.0] * 63), (905, [])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def _brute_clusters(rows, k=16, rounds=3):
    keep = [(r.vec_id, np.floor(64 * np.array(r.embedding)).astype(int)) for r in rows
            if r.embedding is not None and len(r.embedding) == 64 and all(v is not None and np.isfinite(v) for v in r.embedding)]
    order = sorted(keep, key=lambda v: (v[0] is None, hashlib.sha256(f"1:{v[0]}".encode()).hexdigest(), v[1].tolist()))
    c = [v.copy() for _, v in order[:k]]

    def place():
        return [min((int(((v - m) ** 2).sum()), j) for j, m in enumerate(c)) for _, v in keep]
    for _ in range(rounds):
        at = place()
        for j in range(len(c)):
            own = [v for (_, v), p in zip(keep, at) if p[1] == j]
            if own:
                c[j] = np.array([sum(int(v[d]) for v in own) // len(own) for d in range(64)])
    at = place()
    total = sum(p[0] for p in at)
    return sorted(((i, p[1], p[0], sum(x[0] for x in at if x[1] == p[1]), total, hashlib.sha256(",".join(map(str, c[p[1]].tolist())).encode()).hexdigest())
                   for (i, _), p in zip(keep, at)), key=_key)


@pytest.mark.parametrize("bits", [2, 6])
def test_clusters_equal_brute_force(spark, bits):
    v = _vectors(spark)
    got = CE.cluster_vectors(CE.usable(v.withColumn("cluster", F.lit(1)).withColumn("q", F.lit(2))), bits=bits).collect()
    assert sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in got), key=_key) == _brute_clusters(v.collect())
    if bits == 6:                                                         # most distances are never computed
        assert sum(r.n_fetched for r in got) < 0.25 * 16 * len(got) and any(r.n_fetched == 0 for r in got)


def test_few_and_no_vectors(spark):
    few = CE.usable(_vectors(spark, 10))
    assert {r.distance for r in CE.cluster_vectors(few).collect()} == {0}
    assert CE.cluster_vectors(few.limit(0)).count() == 0


def test_oversized_component_is_an_error(spark):
    big = spark.createDataFrame([(1, [1e12] + [0.0] * 63)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="2\\^27"):
        CE.usable(big).collect()


def test_cluster_sql(spark, tmp_path):
    v = _vectors(spark, 60).filter("vec_id IS NOT NULL AND vec_id != 7")
    v.write.parquet(f"{tmp_path}/v")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/v/*.parquet'")
    want = sorted(con.execute(SQL["op11_centroid_clusters"]).fetchall())
    got = CE.cluster_vectors(CE.usable(spark.read.parquet(f"{tmp_path}/v"))).drop("n_fetched").collect()
    assert sorted(map(tuple, got)) == want
