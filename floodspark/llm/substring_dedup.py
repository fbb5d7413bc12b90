"""Operator 1 - repeated passages (windows of n words) by fixed-block anchors.

Reference side: the non-overlapping blocks of n/2 words of every document are indexed. Probe side:
every rolling window of n/2 words is looked up in that index. Any window of n words contains a whole
block of its own document, so a passage that occurs in two documents hits the index. Around the hits,
and only there, the windows of n words are compared across documents by a 64-bit hash and an independent
31-bit check of their word sequence: each learns the smallest doc_id in which it starts. Overlapping repeated windows are joined
to maximal exact repeats, whose words are removed.

Hits are not paired: a passage shared by m documents costs one entry per chunk of documents in the
index and in the comparison (see ``exchange``), not m^2 pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import PACKED, Presence, answers_of, chunked, groups_of, merge, pack_rows, with_answers
from .text import Words, flat, ids_of, slices

_SEEN = np.dtype([("h", "<u8"), ("check", "<u4"), ("doc", "<i8")])     # check: 31 bits, top bit: several documents
_TOP = np.uint32(1 << 31)


def _texts(t: pa.Table):
    """(doc ids, Words) of a chunk, slice by slice."""
    text, ids = flat(t["text"]), ids_of(t["doc_id"])
    for a, b in slices(text):
        yield ids[a:b], Words(text.slice(a, b - a)), a


def _probe(half: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        h, flag, owner = [], [], []
        for ids, w, _ in _texts(t):
            i, doc, x = w.windows(half, 25)
            h.append(x)
            flag.append((i - w.first[doc]) % half == 0)               # the document's own blocks
            owner.append(ids[doc])
        return Presence.rows(key[0].as_py(), np.concatenate(h), np.concatenate(flag), np.concatenate(owner), buckets)
    return run


def _around(w: Words, live: np.ndarray, at: np.ndarray, n: int, half: int):
    """First words, documents and hashes of the windows of n words that contain a live anchor."""
    i, doc, h = w.windows(n, 50)
    hits = np.zeros(len(w) + 1, np.int64)
    hits[at[live] + 1] = 1
    hits = np.cumsum(hits)
    last = np.minimum(i + n - half + 1, len(w))
    near = hits[last] > hits[i]
    i, doc, h = i[near], doc[near], h[near]
    return i, doc, h, w.spans_check(i, i + n)


def _compare(n: int, half: int, buckets: int):
    def run(chunk: int, docs: pa.Table, answers: pa.Table) -> pa.Table:
        found = []
        if "text" in docs.column_names and "packed" in answers.column_names:
            for ids, w, _ in _texts(docs):
                at, _, x = w.windows(half, 25)
                i, doc, h, check = _around(w, Presence.found(x, buckets, answers), at, n, half)
                r = np.empty(len(i), _SEEN)
                r["h"], r["check"], r["doc"] = h, check, ids[doc]
                found.append(_smallest(r))
        r = _smallest(np.concatenate(found)) if found else np.zeros(0, _SEEN)
        return pack_rows(chunk, r["h"], r, buckets)
    return run


def _smallest(r: np.ndarray) -> np.ndarray:
    """Per window the smallest document, and whether there are several."""
    check = r["check"] & ~_TOP
    order, first, number = groups_of(r["h"], check)
    if not len(order):
        return r
    s = r[order]
    out = s[first].copy()
    low, high = np.minimum.reduceat(s["doc"], first), np.maximum.reduceat(s["doc"], first)
    several = (low != high) | (np.maximum.reduceat(s["check"], first) >= _TOP)
    out["doc"] = low
    out["check"] = check[order][first] | np.where(several, _TOP, np.uint32(0))
    return out


def _decide(r: np.ndarray, own: np.ndarray):
    """Windows of several documents, each with the smallest doc_id of all chunks."""
    check = r["check"] & ~_TOP
    order, first, number = groups_of(r["h"], check)
    s = r[order]
    low, high = np.minimum.reduceat(s["doc"], first), np.maximum.reduceat(s["doc"], first)
    several = (low != high) | (np.maximum.reduceat(s["check"], first) >= _TOP)
    out = r.copy()
    out["doc"], out["check"] = low[number], check
    return out, several[number]


def _remove(n: int, half: int, spans: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_repeats", pa.int64()),
                        ("kept_sha256", pa.string())] + ([("kept_text", pa.string())] if spans else []))

    def run(chunk: int, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if "text" not in docs.column_names:
            return schema.empty_table()
        known, _ = answers_of(answers, _SEEN)
        known = known[np.argsort(known["h"], kind="stable")]
        real, out = docs["doc_id"].to_pylist(), []
        for ids, w, a in _texts(docs):
            gone = np.zeros(len(w) + 1, np.int64)
            if len(known) and len(w):
                i, doc, h = w.windows(n, 50)
                # A hash may repeat in ``known``: look at each of its entries.
                lo, hi = np.searchsorted(known["h"], h), np.searchsorted(known["h"], h, "right")
                some = np.flatnonzero(hi > lo)
                i, doc, lo, hi = i[some], doc[some], lo[some], hi[some]
                check = w.spans_check(i, i + n)
                cover = np.zeros(len(w) + 1, np.int64)
                for step in range(int((hi - lo).max(initial=0))):
                    j = np.minimum(lo + step, hi - 1)
                    yes = (known["check"][j] == check) & (known["doc"][j] < ids[doc])
                    s = np.unique(i[yes])
                    np.add.at(cover, s, 1)
                    np.add.at(cover, s + n, -1)
                gone = np.cumsum(cover)
            gone = gone[:len(w)] > 0
            raw = w.data.tobytes()
            for d in range(len(ids)):
                x, y = w.first[d], w.first[d + 1]
                g = gone[x:y]
                s, e = w.start[x:y], w.end[x:y]
                kept = b" ".join([raw[p:q] for p, q in zip(s[~g].tolist(), e[~g].tolist())])
                runs = int((np.diff(np.r_[0, g.astype(np.int8)]) > 0).sum())
                row = [real[a + d], int(y - x), int(g.sum()), runs, hashlib.sha256(kept).hexdigest()]
                out.append(row + [kept.decode("utf-8", "replace")] if spans else row)
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else schema.empty_table()
    return run


def substring_dedup(docs: DataFrame, window: int = 50, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, n_repeats (maximal repeats removed), kept_sha256 per row of
    ``docs`` (doc_id, text); with ``texts`` also kept_text.

    A word goes if a window of ``window`` words that covers it also starts in a document with a
    smaller doc_id. Windows are judged on the input. NULL and empty texts and texts shorter than a
    window lose nothing. Rows that share a doc_id do not remove words from each other; a NULL doc_id
    counts as larger than every other. Extra columns are ignored; an empty table gives no rows.
    """
    half = window // 2
    d, buckets = chunked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    probes = d.groupBy("chunk").applyInArrow(_probe(half, buckets), PACKED)
    live = merge(probes, Presence.dtype, Presence.decide)
    seen = with_answers(d, live, _compare(window, half, buckets), PACKED)
    smallest = merge(seen, _SEEN, _decide)
    out = "doc_id long, n_words long, n_removed long, n_repeats long, kept_sha256 string" + (", kept_text string" if texts else "")
    return with_answers(d, smallest, _remove(window, half, texts), out)
