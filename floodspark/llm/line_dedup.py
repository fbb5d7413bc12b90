"""Operator 6 - repeated and nearly repeated lines by a deletion-neighbourhood join.

A line is a sequence of words. Lines with equal words are repeats. Two lines are also joined when one
word inserted, deleted or replaced turns one into the other: every line emits itself and all its
one-word-deletion variants as hashed keys, and equal keys meet. The variant's position travels along
and verifies the edit distance without pairing lines: equal variants with the word taken out at the
same place are a replacement, a variant equal to a whole line is an insertion or deletion; equal
variants from different places are two edits and do not count. So a key only needs its earliest line,
and a line shared by any number of documents is one entry per chunk of documents.

Steps (see ``exchange``): 1. the first occurrence of every distinct line; 2. which variant keys occur
twice among first occurrences; 3. for those, the earliest compatible line; 4. rebuild the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .exchange import PACKED, Presence, answers_of, chunked, groups_of, merge, pack_rows, with_answers
from .text import Words, check_powers, flat, ids_of, mix, prefix, run_check, run_hash, slices, _powers, _PRIME

_LINE = np.dtype([("h", "<u8"), ("check", "<u4"), ("line", "<u4"), ("doc", "<i8")])
_KEY = np.dtype([("h", "<u8"), ("check", "<u4"), ("place", "<i4"), ("line", "<u4"), ("to_line", "<u4"), ("doc", "<i8"), ("to_doc", "<i8")])
_SALT = 61
_P = np.uint64(_PRIME)
#: Top bit of a line number: the row has no doc_id, ``doc`` is its place among such rows and it comes after all others.
_NO_ID = 31


class _Chunk:
    """Lines of a chunk of documents in a fixed order: arrays over all its lines."""

    def __init__(self, t: pa.Table):
        if len(t) > pc.count_distinct(t["doc_id"], mode="all").as_py():      # repeated ids: their lines follow each other
            t = t.sort_by([("doc_id", "ascending"), ("nth", "ascending"), ("text", "ascending")])
        self.table = t
        null = flat(t["doc_id"]).is_null().to_numpy(zero_copy_only=False)
        text, ids = flat(t["text"]), np.where(null, ids_of(t["nth"]), ids_of(t["doc_id"]))
        self.parts = []                           # (row of first text, Words, lines' first word, end word, start byte, end byte, row)
        self.row, self.h, self.check, self.n = [], [], [], []
        for a, b in slices(text):
            w = Words(text.slice(a, b - a))
            nl = np.flatnonzero(w.data == 10)
            start = np.concatenate([w.off[:-1], nl + 1])
            own = np.concatenate([np.arange(b - a), np.searchsorted(w.off, nl, "right") - 1])
            order = np.lexsort((start, own))
            start, own = start[order], own[order]
            end = np.empty_like(start)
            end[:-1] = start[1:] - 1
            last = np.r_[own[1:] != own[:-1], True]
            end[last] = w.off[own[last] + 1]
            x, y = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
            self.parts.append((w, x, y, start, end))
            self.row.append(own + a)
            self.h.append(w.spans_hash(x, y, _SALT))
            self.check.append(w.spans_check(x, y))
            self.n.append(y - x)
        none = np.zeros(0, np.int64)
        self.row, self.n = (np.concatenate(v) if v else none for v in (self.row, self.n))
        self.h = np.concatenate(self.h) if self.h else np.zeros(0, np.uint64)
        self.check = np.concatenate(self.check) if self.check else np.zeros(0, np.uint32)
        self.doc = ids[self.row] if len(self.row) else none
        null = null[self.row]
        new = np.r_[True, (self.doc[1:] != self.doc[:-1]) | (null[1:] != null[:-1])] if len(self.doc) else np.zeros(0, bool)
        at = np.arange(len(self.doc))
        # Lines count on through rows that share a doc_id.
        self.line = at - np.maximum.accumulate(np.where(new, at, 0)) + (null.astype(np.int64) << _NO_ID) if len(at) else none

    def records(self) -> np.ndarray:
        r = np.empty(len(self.h), _LINE)
        r["h"], r["check"], r["doc"], r["line"] = self.h, self.check, self.doc, self.line
        return r

    def is_first(self, answers: np.ndarray) -> np.ndarray:
        """Lines that are the first occurrence of their words anywhere; blank lines are."""
        r = self.records()
        both = np.concatenate([r, answers])
        order, first, number = groups_of(both["h"], both["check"])
        best = both[_earliest(both, order, first)][number[:len(r)]]
        return (self.n == 0) | ((best["doc"] == r["doc"]) & (best["line"] == r["line"]))

    def variants(self, chosen: np.ndarray, checks: bool = True):
        """Keys of the chosen lines: (line index, place of the deleted word or -1, hash, check); without ``checks`` all
        checks are 0."""
        out, base = [], 0
        for w, x, y, _, _ in self.parts:
            mine = np.flatnonzero(chosen[base:base + len(x)])
            n = y[mine] - x[mine]
            a, b = np.repeat(x[mine], n), np.repeat(y[mine], n)
            i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + a
            pre = prefix(w.hash)
            up, down = _powers(len(pre) + 1)
            value = run_hash(pre, a, i) + (pre[b] - pre[i + 1]) * down[i + 1] * up[i - a]
            size = (b - a - 1).astype(np.uint64)
            whole = run_hash(pre, x[mine], y[mine]) + n.astype(np.uint64)
            check = np.zeros(len(i) + len(mine), np.uint32)
            if checks:
                cut_ = _without(w.check_prefix, a, i, b) + size
                check = np.concatenate([(cut_ % _P).astype(np.uint32), w.spans_check(x[mine], y[mine])])
            out.append((np.concatenate([np.repeat(mine, n), mine]) + base,
                        np.concatenate([i - a, np.full(len(mine), -1)]).astype(np.int32),
                        np.concatenate([mix(value + size, _SALT), mix(whole, _SALT)]), check))
            base += len(x)
        if not out:
            return (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        return tuple(np.concatenate(v) for v in zip(*out))


def _without(pre: np.ndarray, a: np.ndarray, i: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``run_check`` of the runs [a, b) with their word i left out."""
    up, down = check_powers(len(pre) + 1)
    tail = (pre[b] + _P - pre[i + 1]) % _P * down[i + 1] % _P * up[i - a]
    return (run_check(pre, a, i) + tail) % _P


def _earliest(r: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Index of the earliest line of each group of ``groups_of``."""
    if not len(order):
        return order
    size = np.diff(np.r_[first, len(order)])
    out = order[first]
    more = np.flatnonzero(np.repeat(size > 1, size))         # of the groups with several lines
    number = np.repeat(np.arange(len(first)), size)[more]
    s = order[more]
    line, doc = r["line"][s], r["doc"][s]
    null = line >> _NO_ID
    again = np.lexsort((line, doc, null, number) if null.any() else (line, doc, number))
    at = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(more) else more
    out[number[at]] = s[again[at]]
    return out


def _before(doc: np.ndarray, line: np.ndarray, other_doc: np.ndarray, other_line: np.ndarray) -> np.ndarray:
    """Whether lines come before other lines, pair by pair."""
    null, other = line >> _NO_ID, other_line >> _NO_ID
    return (null < other) | ((null == other) & ((doc < other_doc) | ((doc == other_doc) & (line < other_line))))


def _split(answers: pa.Table):
    """(answers of the lines step, answers of the keys step): the former are marked by negative buckets."""
    if "packed" not in answers.column_names:
        return answers, answers
    old = pc.less(answers["bucket"], 0)
    return answers.filter(old), answers.filter(pc.invert(old))


def _lines(buckets: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        c = _Chunk(t)
        r = c.records()[c.n > 0]
        order, first, _ = groups_of(r["h"], r["check"])
        r = r[_earliest(r, order, first)]
        return pack_rows(key[0].as_py(), r["h"], r, buckets)
    return run


def _first_of_lines(r: np.ndarray, own: np.ndarray):
    """Lines of several chunks, each with its earliest place."""
    order, first, number = groups_of(r["h"], r["check"])
    size = np.diff(np.r_[first, len(r)])
    best = r[_earliest(r, order, first)]
    return best[number], size[number] > 1


def _keys(buckets: int, near_words: int):
    def run(chunk: int, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if "text" not in docs.column_names:
            return pack_rows(chunk, np.zeros(0, np.uint64), np.zeros(0, np.uint32), buckets)
        c = _Chunk(docs)
        line, _, h, _ = c.variants(c.is_first(answers_of(answers, _LINE)[0]) & (c.n >= near_words), checks=False)
        return Presence.rows(chunk, h, np.ones(len(h), bool), line, buckets)
    return run


def _places(buckets: int, near_words: int):
    def run(chunk: int, docs: pa.Table, answers: pa.Table) -> pa.Table:
        r = np.zeros(0, _KEY)
        if "text" in docs.column_names:
            lines, keys = _split(answers)
            c = _Chunk(docs)
            line, place, h, check = c.variants(c.is_first(answers_of(lines, _LINE)[0]) & (c.n >= near_words))
            live = Presence.found(h, buckets, keys)
            r = np.zeros(int(live.sum()), _KEY)
            r["h"], r["check"], r["place"] = h[live], check[live], place[live]
            r["doc"], r["line"] = c.doc[line[live]], c.line[line[live]]
        return pack_rows(chunk, r["h"], r, buckets)
    return run


def _near(r: np.ndarray, own: np.ndarray):
    """Entries with an earlier line one edit away; ``to_doc``, ``to_line`` name that line."""
    whole = r["place"] < 0
    # Earliest line per key and place, per key among whole lines, and per key among deletions.
    o1, f1, n1 = groups_of(r["h"], r["check"], r["place"])
    same = r[_earliest(r, o1, f1)][n1]
    o2, f2, n2 = groups_of(r["h"], r["check"], whole)
    by_kind = r[_earliest(r, o2, f2)]
    key = np.cumsum(np.r_[True, (by_kind["h"][1:] != by_kind["h"][:-1]) | (by_kind["check"][1:] != by_kind["check"][:-1])]) - 1
    other = np.full((key[-1] + 1, 2), -1)
    other[key, (by_kind["place"] < 0).astype(int)] = np.arange(len(by_kind))
    across = other[key[n2], 1 - whole.astype(int)]              # the other kind under the same key
    out = r.copy()
    best_doc, best_line = r["doc"].copy(), r["line"].copy()
    for cand, valid in ((same, ~whole), (by_kind[across], across >= 0)):
        better = valid & _before(cand["doc"], cand["line"], best_doc, best_line)
        best_doc, best_line = np.where(better, cand["doc"], best_doc), np.where(better, cand["line"], best_line)
    out["to_doc"], out["to_line"] = best_doc, best_line
    return out, (best_doc != r["doc"]) | (best_line != r["line"])


def _rebuild(chunk: int, docs: pa.Table, answers: pa.Table) -> pa.Table:
    if "text" not in docs.column_names:
        return pa.table({})
    lines, keys = _split(answers)
    c = _Chunk(docs)
    first = c.is_first(answers_of(lines, _LINE)[0])
    near = np.zeros(len(c.doc), bool)
    hit = answers_of(keys, _KEY)[0]
    if len(hit):
        pos = np.rec.fromarrays([c.doc, c.line])
        near = first & np.isin(pos, np.rec.fromarrays([hit["doc"], hit["line"].astype(np.int64)]))
    gone = ~first | near
    n_rows = len(c.table)
    count = lambda m: np.bincount(c.row[m], minlength=n_rows)
    total, repeats, nears, left = count(slice(None)), count(~first), count(near), count(~gone & (c.n > 0))
    had = count(c.n > 0) > 0
    text = flat(c.table["text"]).to_pylist()
    base = 0
    for w, x, _, start, end in c.parts:
        g, row = gone[base:base + len(x)], c.row[base:base + len(x)]
        raw = w.data.tobytes()
        for r in np.unique(row[g]):
            lo, hi = np.searchsorted(row, r), np.searchsorted(row, r, "right")
            text[r] = b"\n".join([raw[s:e] for s, e, k in zip(start[lo:hi].tolist(), end[lo:hi].tolist(), g[lo:hi]) if not k]).decode("utf-8", "replace")
        base += len(x)
    new = {"n_lines": total, "n_repeats": repeats, "n_near": nears, "emptied": had & (left == 0), "text": pa.array(text, pa.string())}
    kept = {n: c.table[n] for n in c.table.column_names if n not in ("chunk", "nth", "text")}
    return pa.table({"doc_id": kept.pop("doc_id")} | new | kept)


def _numbered(d: DataFrame) -> DataFrame:
    """``d`` with ``nth``, which orders the rows without a doc_id by text, whatever chunk they are dealt to.

    Texts of such rows are sorted over all tasks and materialised: the numbers grow with the text, but
    another run of the sort may cut its ranges elsewhere. Columns that can be ordered settle ties.
    """
    simple = (T.NumericType, T.StringType, T.BooleanType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)
    ties = [f"`{f.name}`" for f in d.schema if f.name not in ("doc_id", "text") and isinstance(f.dataType, simple)]
    null = d.filter("doc_id IS NULL").orderBy(F.col("text").asc_nulls_last(), *ties)
    return d.filter("doc_id IS NOT NULL").withColumn("nth", F.lit(0).cast("long")).unionByName(
        cut(null.withColumn("nth", F.monotonically_increasing_id())))


def line_dedup(docs: DataFrame, near_words: int = 8, keep: list[str] = ()) -> DataFrame:
    """doc_id, n_lines, n_repeats, n_near, emptied, text for every row of ``docs`` (doc_id, text).

    Order is (doc_id, line number). A line with words goes if an earlier line has the same words, or
    - from ``near_words`` words on - if an earlier first occurrence of a line (of ``near_words`` words or
    more) is one word edit away; both are judged on the input. Blank lines stay. ``emptied``: the text
    had words and lost all of them. NULL texts stay NULL with one blank line. Rows that share a doc_id
    are read one after the other in the order of their texts; a NULL doc_id comes after all others, and
    rows without one are in the order of their texts too. The result does not depend on the shuffle width.
    Columns named in ``keep`` are passed on, other extra columns are ignored; an empty table gives no rows.
    """
    d, buckets = chunked(_numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                                               *[F.col(c).alias(f"_{c}") for c in keep])))
    firsts = merge(d.groupBy("chunk").applyInArrow(_lines(buckets), PACKED), _LINE, _first_of_lines)
    keys = with_answers(d, firsts, _keys(buckets, near_words), PACKED)
    live = merge(keys, Presence.dtype, Presence.decide)
    marked = firsts.withColumn("bucket", -1 - F.col("bucket"))
    places = with_answers(d, marked.unionByName(live), _places(buckets, near_words), PACKED)
    near = merge(places, _KEY, _near)
    kept = "".join(f", `_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    out = with_answers(d, marked.unionByName(near), _rebuild,
                       "doc_id long, n_lines long, n_repeats long, n_near long, emptied boolean, text string" + kept)
    return out.withColumnsRenamed({f"_{c}": c for c in keep})
