import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodspark.llm.mixing import mix_documents, mix_report, source_targets
from floodspark.llm.packing import Plan, pack_documents, pieces, vocabulary
from floodspark.llm.token_counts import BYTE_SCORE, token_counts, unigram
from floodspark.llm.topk import Lists, nra, quantised, top_k
from floodspark.llm.warc import MAGIC, read_warc, warc_round_trip, write_warc
from llm.helpers import ODD, WORD, docs, prose


def test_token_counts_match_plain_viterbi(spark):
    rng = random.Random(5)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(50 + k, " ".join(rng.choice(["thereon", "Understanding", "naïve", "☃☃", "the", "thereof", "x1y2"]) for _ in range(40))) for k in range(5)]
    vocab = unigram(vocabulary("piece_bpe_32k.model"))

    def plain(word):
        w = "▁" + word
        best = [(0, 0)] + [None] * len(w)
        for i in range(1, len(w) + 1):
            got = [(best[j][0] + vocab[w[j:i]], best[j][1] - 1) for j in range(max(0, i - 64), i) if w[j:i] in vocab]
            n = len(w[i - 1].encode())
            if w[i - 1] not in vocab:
                got.append((best[i - 1][0] + n * BYTE_SCORE, best[i - 1][1] - n))
            best[i] = max(got)
        return -best[-1][1], best[-1][0]
    want = []
    for i, t in rows:
        got = [plain(w) for w in WORD.findall(t or "")]
        want.append((i, len(got), sum(g[0] for g in got), sum(g[1] for g in got)))
    rows += [(None, "thereof the"), (50, rows[-5][1])]
    want += [(None, 2, *map(sum, zip(plain("thereof"), plain("the")))), (50, *want[-5][1:])]
    for size in (30, 4_000_000):                               # many slices, one slice
        got = token_counts(docs(spark, rows).withColumns({c: F.lit("x") for c in ("score", "n_tokens", "words")}), slice_bytes=size)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert token_counts(docs(spark, [])).count() == 0


def test_pieces_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary())
    rng = random.Random(1)
    texts = ODD + ["The THE the, the. don't it's x.y a,b, end", " ".join(prose(rng, 300)), "Straße ΣΑΣ İstanbul é ́x"]
    rows = [(k, x) for k, x in enumerate(texts)] + [(None, "null id")]
    got = {(r.doc_id, r.piece): r for r in pieces(docs(spark, rows), capacity=64, keep_ids=True).collect()}
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        for p, a in enumerate(range(0, len(ids), 64)):
            r = got.pop((i, p))
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[a:a + 64]
            assert (r.start, r.length, r.ids_crc32) == (a, len(ids[a:a + 64]), zlib.crc32(np.array(ids[a:a + 64], "<u4").tobytes()))
    assert not got


def test_packing_is_gapless_and_tight(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(prose(rng, rng.choice([3, 10, 40, 100, 300])))) for k in range(150)] + [(9, "again"), (9, "again"), (None, None)]
    got = pack_documents(docs(spark, rows), capacity=256).collect()
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for seq in by.values():
        at = 0
        for o, n in sorted(seq):
            assert o == at
            at += n
        assert at <= 256
    assert len(by) <= math.ceil(1.1 * sum(r.length for r in got) / 256) + 1
    whole = defaultdict(Counter)
    for r in got:
        whole[r.doc_id][r.piece] += 1
    assert whole[9] == {0: 3}
    assert pack_documents(docs(spark, []), capacity=256).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_rank_once(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 97, 1000])
    counts = Counter(min(cap, 1 + int(rng.expovariate(4 / cap))) for _ in range(3000))
    plan = Plan(counts, cap)
    fill, seen = defaultdict(list), Counter()
    for length, a, b, s, o in plan.runs:
        seen[length] += b - a
        for k in range(b - a):
            fill[s + k].append((o, length))
    assert seen == counts
    for seq in fill.values():
        at = 0
        for o, n in sorted(seq):
            assert o == at
            at += n
        assert at <= cap
        assert sum(3 * n > cap for _, n in seq) <= 2
    total = sum(k * v for k, v in counts.items())
    assert len(fill) <= 1.07 * total / cap + 2 + sum(v for k, v in counts.items() if 3 * k > 2 * cap) * 0.2
    assert len(plan.runs) < 40 * cap


def water(sizes, weights, share, cap):
    """Targets by repeated resharing of what exceeds the caps."""
    target = dict.fromkeys(sizes, 0.0)
    budget, open_ = share * sum(sizes.values()), set(sizes)
    while open_:
        level = budget / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > cap * sizes[s]}
        if not over:
            return target | {s: weights[s] * level for s in open_}
        for s in over:
            target[s] = float(cap * sizes[s])
            budget -= cap * sizes[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_mix_targets_match_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 10, 500, 20_000]) for s in ["a", "B", "é", "z", "m", None]}
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = water(sizes, weights, 1.5, 2)
    for s in sizes:
        assert got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6)


def test_mix_takes_near_target_and_agrees(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(prose(rng, rng.randrange(1, 60))), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(1500)]
    rows += [(2000 + k, t, "c") for k, t in enumerate(ODD)] + [(None, "x y", "a"), (3, "dup id", "b")]
    d = docs(spark, rows)
    r = mix_report(d).toPandas()
    assert len(r) == len(rows) and (r.taken <= 2 * r["size"]).all()
    by = r.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) < 0.1 * by.target + 50).all()
    assert sorted(map(tuple, mix_report(d).collect()), key=repr) == sorted(map(tuple, mix_report(d.repartition(7)).collect()), key=repr)
    out = mix_documents(d)
    assert out.columns == d.columns
    assert out.filter("text IS NOT NULL").selectExpr("sum(size(split(trim(text), ' +')))").first()[0] > 0
    assert mix_report(docs(spark, [])).count() == 0 and mix_documents(docs(spark, [])).count() == 0


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    v = [(int(i), [float(x) for x in rng.normal(0, 0.15, 16)]) for i in range(300)]
    v += [(1000 + i, v[3][1]) for i in range(150)]                       # ties
    v += [(2000, None), (2001, [float("nan")] * 16), (2002, [float("inf")] * 16), (2003, [None] + [1.0] * 15), (2004, [0.5] * 8),
          (2005, []), (None, [0.1] * 16), (2006, [1e6] * 16), (2008, [-3.0e7] * 16)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").repartition(5)
    q = quantised(df)
    rows = {i: [math.floor(64 * x) for x in e] for i, e in v if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    want = []
    for i in rows:
        if i % 4 == 0:
            s = sorted((-sum(a * b for a, b in zip(rows[i], rows[j])), j) for j in rows if j != i and len(rows[j]) == len(rows[i]))
            want += [(i, k + 1, j, -x) for k, (x, j) in enumerate(s[:20])]
    got = top_k(q.filter("vec_id % 4 = 0"), q, 20, item_block=64, query_block=16, queries_per_cell=40)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert top_k(q.limit(0), q.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [20, 2**20, 2**27])
def test_nra_stops_before_the_ends_of_the_lists(scale):
    """Vectors in a few directions: outsiders fall out early. The scales take float32, float64 and bounds past 53 bits."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (12, 24))
    X = np.rint(scale * (centres[rng.integers(0, 12, 1500)] + rng.normal(0, 0.05, (1500, 24)))).astype(np.int64)
    X[10:14] = X[9]                                                      # ties
    ids, at = np.arange(1500)[::-1].copy(), np.arange(0, 1500, 50)
    depths = []
    for j, best, score, depth in nra(X[at], ids[at], Lists(X, ids), 10):
        s = X @ X[at[j]]
        want = sorted((i for i in range(1500) if i != at[j]), key=lambda i: (-s[i], ids[i]))[:10]
        assert best.tolist() == want and score.tolist() == s[want].tolist()
        depths.append(depth)
    assert len(depths) == len(at) and max(depths) <= 1500 and np.mean(depths) < 0.7 * 1500


def test_warc_round_trip_with_magic_in_payloads(spark):
    trick = "x\r\n\r\n" + MAGIC + "WARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(k, f"http://h/{k} \r\n", t) for k, t in enumerate([None, "", "a", "a", trick, MAGIC, trick * 3, "é" * 999, "a" * 70000, MAGIC * 500])]
    rows += [(50 + k, None, f"<p>{k % 7}</p>" + trick * (k % 3)) for k in range(40)] + [(None, "u", "a"), (2, "again", "a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")       # many byte ranges per file
        got = warc_round_trip(spark, pages).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    from floodspark.llm.warc import digest32
    want = sorted((repr(i), len((h or "").encode()), digest32((h or "").encode()),
                   "revisit" if i is not None and first[h or ""] != i else "response",
                   repr(first[h or ""] if i is not None and first[h or ""] != i else None)) for i, _, h in rows)
    assert sorted((repr(r.page_id), r.payload_bytes, r.payload_digest, r.type, repr(r.refers_to)) for r in got) == want
    assert all(r.digest_ok is (True if r.type == "response" else None) for r in got)


@pytest.mark.parametrize("alter", [False, True])
def test_warc_splits_that_change_and_altered_payloads(spark, tmp_path, monkeypatch, alter):
    """The second reading of the archives is split otherwise than the first; altered bytes are noticed."""
    from floodspark.llm import warc
    rows = [(k, "u", f"page {k} " + MAGIC * (k % 3) + "y" * (37 * k)) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"file": F.lit("f"), "key": F.lit(1)}).repartition(2)
    folder = write_warc(pages, f"{tmp_path}/w")
    if alter:
        import glob
        for f in glob.glob(f"{folder}/part*"):
            raw = open(f, "rb").read()
            open(f, "wb").write(raw.replace(b"page ", b"PAGE "))
        for f in glob.glob(f"{folder}/.*.crc"):
            open(f, "wb").close()
    plain, old = warc._whole, spark.conf.get("spark.sql.files.maxPartitionBytes")

    def other(*a):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1900")
        return plain(*a)
    monkeypatch.setattr(warc, "_whole", other)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = read_warc(spark, folder).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r.page_id: r.payload_bytes for r in got} == {k: len(t.encode()) for k, _, t in rows} and len(got) == 60
    assert {r.digest_ok for r in got} == {not alter}


def test_warc_empty_and_least_size(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_round_trip(spark, empty).count() == 0
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "b" * 20), (4, "u", "b" * 20)], "page_id long, url string, html string")
    got = read_warc(spark, write_warc(pages, f"{tmp_path}/w", min_revisit_bytes=10))
    assert {r.page_id: (r.type, r.refers_to) for r in got.collect()} == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_cache_of_words_is_bounded_and_keeps_what_is_asked_for():
    from floodspark.llm.packing import Known
    learnt = Counter()

    def learn(key):
        learnt[key] += 1
        return key * 2
    known = Known(learn, 20_000)
    for i in range(3000):
        for key in (b"often", str(i).encode()):
            assert known[key] == key * 2
        assert len(known) + len(known.old) < 150
    assert learnt[b"often"] == 1 and known.find(b"0") is None and known.find(b"often") == b"oftenoften"
