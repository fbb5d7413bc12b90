import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from floodspark.llm.components import components
from floodspark.llm.exact_dedup import MinimalPerfectHash, exact_dedup
from floodspark.llm.line_dedup import _without, line_dedup
from floodspark.llm.near_dedup import near_duplicates
from floodspark.llm.substring_dedup import substring_dedup
from floodspark.llm.text import Words, check_prefix, run_check, word_checks
from llm.helpers import ODD, WORD, docs, prose

INF = 2**63 - 1


def corpus(seed=1):
    """Texts with shared passages, near copies, exact copies, repeated ids and odd texts."""
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([5, 30, 120, 400])) for _ in range(25)]
    rows = []
    for i, b in enumerate(base):
        rows.append((i * 3 + 1, " ".join(b)))
        c = list(b)
        for _ in range(max(1, len(c) // 60)):
            c[rng.randrange(len(c))] = "edit"
        rows.append((100 + i, "\n".join(" ".join(c[k:k + 12]) for k in range(0, len(c), 12))))
    passage = " ".join(base[7][:70]) if len(base[7]) > 70 else " ".join(prose(rng, 70))
    rows += [(200 + k, " ".join(prose(rng, 20)) + " " + passage + "  " + " ".join(prose(rng, 20))) for k in range(12)]
    rows += [(300 + k, t) for k, t in enumerate(ODD)] + [(400 + k, t) for k, t in enumerate(ODD)]
    rows += [(200, rows[0][1]), (200, passage), (None, passage), (None, None), (-5, passage + " end")]
    rng.shuffle(rows)
    return rows


def collect(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_substring_matches_brute_force(spark):
    rows = corpus()
    n = 50
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - n + 1):
            key = tuple(w[k:k + n])
            first[key] = min(first.get(key, INF), INF if i is None else i)
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k:k + n])] < (INF if i is None else i):
                gone |= set(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = substring_dedup(docs(spark, rows), n).drop("n_repeats")
    assert collect(got) == sorted(want, key=repr)
    assert sum(r[2] for r in want) > 500


def test_substring_texts_and_empty(spark):
    d = docs(spark, [(1, "a b c d e f"), (2, "x a b c d y")])
    got = {r.doc_id: (r.kept_text, r.n_repeats) for r in substring_dedup(d, window=4, texts=True).collect()}
    assert got == {1: ("a b c d e f", 0), 2: ("x y", 1)}
    assert substring_dedup(docs(spark, []), 50).count() == 0


def near_brute(rows, n=4):
    sets = []
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        sets.append((i, s))
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return sorted(((i, len(s), (root(i) if s else i) if i is not None else None,
                    i is None or (root(i) if s else i) == i) for i, s in sets), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_matches_brute_force(spark, seed):
    rows = corpus(seed)
    # A chain of near copies around the threshold: links that hold only between neighbours.
    rng = random.Random(seed)
    w = prose(rng, 120)
    for k in range(40):
        w = list(w)
        w[rng.randrange(120)] = f"n{k}"
        rows.append((1000 + rng.randrange(10**6), " ".join(w)))
    got = collect(near_duplicates(docs(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept"))
    assert got == near_brute(rows)
    assert near_duplicates(docs(spark, [])).count() == 0


def colliding_words():
    """Two words with one 64-bit polynomial hash, whatever its odd base: a Thue-Morse word and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_checks_tell_apart_what_the_first_hash_does_not(spark):
    """The hashes of the two texts are equal by construction; nothing of either is removed."""
    a, b = colliding_words()
    w = Words(pa.array([a, b]))
    assert w.hash[0] == w.hash[1] and w.spans_check(np.array([0]), np.array([1])) != w.spans_check(np.array([1]), np.array([2]))
    rest = [f"w{i}" for i in range(70)]
    rows = [(1, " ".join(rest[:30] + [a] + rest[30:])), (2, " ".join(rest[:30] + [b] + rest[30:]))]
    windows = {i: {tuple(t.split()[k:k + 50]) for k in range(22)} for i, t in rows}
    covered = sum(1 for k in range(71) if any(tuple(rows[1][1].split()[s:s + 50]) in windows[1] for s in range(max(0, k - 49), min(22, k + 1))))
    assert [(r.doc_id, r.n_removed) for r in substring_dedup(docs(spark, rows), 50).sort("doc_id").collect()] == [(1, 0), (2, covered)]
    assert covered == 0
    got = line_dedup(docs(spark, [(1, " ".join([a] + rest[:3])), (2, " ".join([b] + rest[:3]))])).sort("doc_id").collect()
    assert [r.text for r in got] == [" ".join([a] + rest[:3]), " ".join([b] + rest[:3])]


def test_run_checks_match_plain_arithmetic():
    rng = np.random.default_rng(4)
    v = rng.integers(0, 2**31 - 1, 500).astype(np.uint64)
    pre = check_prefix(v)
    a = rng.integers(0, 400, 60)
    b = a + rng.integers(1, 100, 60)
    i = a + (b - a) // 2
    plain = lambda run: sum(int(x) * pow(0x4F6CDD1D, k, 2**31 - 1) for k, x in enumerate(run)) % (2**31 - 1)
    assert run_check(pre, a, b).tolist() == [plain(v[x:y]) for x, y in zip(a, b)]
    words = Words(pa.array([" ".join(c * n for n in (1, 7, 8, 9, 16, 17, 63, 64, 65, 3000) for c in "abé漢")]))
    checks = word_checks(words.data, words.start, words.end)
    assert len(set(checks.tolist())) == len(words) == 40 and int(checks.max()) < 2**31
    alone = [word_checks(words.data[s:e].copy(), np.array([0]), np.array([e - s]))[0] for s, e in zip(words.start, words.end)]
    assert checks.tolist() == alone                      # whatever stands beside a word
    assert _without(pre, a, i, b).tolist() == [plain(np.delete(v[x:y], z - x)) for x, z, y in zip(a, i, b)]


def test_components_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 200), (200, 150)], "a long, b long")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {k: 1 for k in range(2, 61)} | {200: 100, 150: 100}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:k] + a[k + 1:] == b for k in range(len(a)))


def line_brute(rows, near_words=8):
    order = sorted(range(len(rows)), key=lambda r: (INF if rows[r][0] is None else rows[r][0], rows[r][1] is None, rows[r][1] or ""))
    first, seen = {}, []
    for r in order:
        for k, line in enumerate((rows[r][1] or "").split("\n")):
            w = tuple(WORD.findall(line))
            if w and w not in first:
                first[w] = (r, k)
                seen.append(w)
    near = {w for p, w in enumerate(seen) if len(w) >= near_words
            and any(len(v) >= near_words and one_edit(v, w) for v in seen[:p])}
    out = []
    for r, (i, t) in enumerate(rows):
        lines = (t or "").split("\n")
        keep, rep, nr, had, left = [], 0, 0, False, False
        for k, line in enumerate(lines):
            w = tuple(WORD.findall(line))
            had |= bool(w)
            if w and first[w] != (r, k):
                rep += 1
            elif w in near:
                nr += 1
            else:
                keep.append(line)
                left |= bool(w)
        out.append((i, len(lines), rep, nr, had and not left, "\n".join(keep) if rep or nr or t is not None else None))
    return sorted(out, key=repr)


def test_lines_match_brute_force(spark):
    rng = random.Random(3)
    pool = [prose(rng, rng.randrange(1, 16), 40) for _ in range(60)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 9)):
            w = list(rng.choice(pool))
            k = rng.randrange(len(w))
            act = rng.randrange(5)
            if act == 0:
                w[k] = "q"
            elif act == 1:
                del w[k]
            elif act == 2:
                w.insert(k, rng.choice(w or ["z"]))
            elif act == 3 and len(w) > 2:                   # two edits: a word moved
                w.insert(rng.randrange(len(w)), w.pop(k))
            lines.append("  ".join(w) if act == 4 else " ".join(w))
        rows.append((rng.choice([i, i, i, 7, None if i % 20 == 0 else i]), "\n".join(lines)))
    rows += [(500 + k, t) for k, t in enumerate(ODD)]
    rows = [(i, t if i is not None and i != 7 else f"{t}\nunique {n}") for n, (i, t) in enumerate(rows)]
    got = collect(line_dedup(docs(spark, rows)))
    want = line_brute(rows)
    assert got == want
    assert sum(r[3] for r in want) > 10
    assert line_dedup(docs(spark, [])).count() == 0


def test_lines_of_many_rows_without_an_id(spark):
    """One header and shared, repeated and nearly repeated lines in rows without a doc_id, at two shuffle widths."""
    rng = random.Random(5)
    pool = [prose(rng, rng.randrange(2, 14), 40) for _ in range(30)]
    rows = []
    for i in range(120):
        lines = ["the same header stands over each of these many pages"]
        for _ in range(rng.randrange(4)):
            w = list(rng.choice(pool))
            if rng.random() < 0.4:
                w[rng.randrange(len(w))] = f"q{rng.randrange(3)}"
            lines.append(" ".join(w))
        rng.shuffle(lines)
        rows.append((i // 2 if i % 4 == 0 else None, "\n".join(lines)))
    rows += [(None, None), (None, None), (None, ""), (None, rows[1][1]), (2**63 - 1, rows[2][1]), (2**63 - 1, "last of all ids")]
    rng.shuffle(rows)
    want, old = line_brute([(i, t) for i, t in rows if i != 2**63 - 1]), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for width in ("2", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            assert collect(line_dedup(docs(spark, [r for r in rows if r[0] != 2**63 - 1]))) == want
            kept = [x for r in line_dedup(docs(spark, rows)).collect() for x in (r.text or "").split("\n") if x]
            assert len(kept) == len(set(map(tuple, map(WORD.findall, kept))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sum(r[3] for r in want if r[0] is None) > 10


def test_minimal_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 1000):
        d = rng.integers(0, 2**63, (n, 4)).astype(np.uint64)
        m = MinimalPerfectHash(d)
        assert sorted(m.slot(d).tolist()) == list(range(n))


def test_exact_matches_brute_force(spark):
    rows = corpus()
    rows += [(900, "a  b"), (901, "a\tb"), (902, "a b "), (903, "a b"), (903, "a b")]
    for split in (-100, 150, 10**9):
        groups = defaultdict(list)
        for i, t in rows:
            groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
        want = []
        for i, t in rows:
            norm = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
            keep = min((x for x in groups[norm] if x is not None), default=None)
            want.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
        got = exact_dedup(docs(spark, rows), F.col("doc_id") <= split, digests_per_bucket=9).drop("in_history")
        assert collect(got) == sorted(want, key=repr)
    assert exact_dedup(docs(spark, []), F.lit(True)).count() == 0
