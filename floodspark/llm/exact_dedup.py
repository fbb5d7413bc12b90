"""Operator 10 - exact deduplication against a history with minimal perfect hashing.

The texts seen so far (the history) are reduced to distinct digests with their winner (smallest
doc_id) and count. Digests are dealt to buckets by their first bytes; each bucket builds a minimal
perfect hash over its history digests and keeps, at slot h(d), the full digest and the locator of
its winner. A new digest is looked up in one probe and compared byte by byte with the slot's digest
(a minimal perfect hash maps strangers to arbitrary slots): equal means a repeat of the history,
unequal means a nonmember, and nonmembers are grouped among themselves by digest.

Both sides are aggregated by digest before they are dealt out, so a text with any number of copies
is one row per bucket; buckets hold a bounded number of distinct digests (about
``digests_per_bucket``) whatever the size of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, cut, renewed, side

_SEEDS = 1 << 16


def digest_of(text) -> F.Column:
    """sha256 (lowercase hex) of the text with every white-space run replaced by one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WS, " "), 256)


class MinimalPerfectHash:
    """Compress-hash-displace over 32-byte digests: groups of about 4 keys share a displacement
    that sends all of them to free slots of a table exactly as large as the key set."""

    def __init__(self, digests: np.ndarray):
        """digests: (n, 4) uint64, distinct rows."""
        n = len(digests)
        self.n, self.groups = n, max(1, (n + 3) // 4)
        self.seed = np.zeros(self.groups, np.int64)
        if not n:
            return
        group = (digests[:, 0] % np.uint64(self.groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        bounds = np.searchsorted(group[order], np.arange(self.groups + 1))
        size = np.diff(bounds)
        used = np.zeros(n, bool)
        for g in np.argsort(-size, kind="stable"):
            k = size[g]
            if not k:
                break
            rows = digests[order[bounds[g]:bounds[g + 1]]]
            if k == 1:                                # singletons take the next free slot directly
                break
            for s in range(1, _SEEDS * 64):
                slot = self._slot(rows, np.full(k, s, np.int64))
                if not used[slot].any() and len(np.unique(slot)) == k:
                    used[slot] = True
                    self.seed[g] = s
                    break
            else:
                raise ValueError("digests repeat: no displacement separates them")
        free = iter(np.flatnonzero(~used))
        for g in np.flatnonzero(size == 1):
            self.seed[g] = -1 - int(next(free))       # a direct slot, kept as a negative number

    def _slot(self, d: np.ndarray, seed: np.ndarray) -> np.ndarray:
        x = d[:, 1] + d[:, 2] * (seed.astype(np.uint64) * np.uint64(2) + np.uint64(1))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return (x % np.uint64(self.n)).astype(np.int64)

    def slot(self, digests: np.ndarray) -> np.ndarray:
        """The slot of every digest; for nonmembers an arbitrary slot."""
        if not self.n:
            return np.full(len(digests), -1, np.int64)
        s = self.seed[(digests[:, 0] % np.uint64(self.groups)).astype(np.int64)]
        return np.where(s < 0, -1 - s, self._slot(digests, np.maximum(s, 0)))


_SIDE = pa.schema([("digest", pa.string()), ("winner", pa.int64()), ("n", pa.int64())])


def _raw(column) -> np.ndarray:
    rows = b"".join(bytes.fromhex(x) for x in column.to_pylist())
    return np.frombuffer(rows, np.uint64).reshape(-1, 4)


def _lookup(known: pa.Table, fresh: pa.Table) -> pa.Table:
    """One bucket: build the table over ``known``, probe it with ``fresh``."""
    known, fresh = side(known, _SIDE), side(fresh, _SIDE)
    kd, fd = _raw(known["digest"]), _raw(fresh["digest"])
    mph = MinimalPerfectHash(kd)
    slot_row = np.zeros(mph.n, np.int64)              # slot -> row that holds the digest and the locator
    slot_row[mph.slot(kd)] = np.arange(mph.n)
    hit = np.zeros(len(fd), bool)
    at = np.zeros(len(fd), np.int64)
    if mph.n and len(fd):
        at = slot_row[mph.slot(fd)]
        hit = (kd[at] == fd).all(axis=1)
    kw, kc = known["winner"].to_pylist(), known["n"].to_pylist()
    fw, fc = fresh["winner"].to_pylist(), fresh["n"].to_pylist()
    total = list(kc)
    winner = list(kw)
    out = {"digest": known["digest"].to_pylist(), "keep_id": winner, "group_size": total, "in_history": [True] * len(kw)}
    for j, d in enumerate(fresh["digest"].to_pylist()):
        if hit[j]:
            i = int(at[j])
            total[i] += fc[j]
            winner[i] = min((x for x in (winner[i], fw[j]) if x is not None), default=None)
        else:
            out["digest"].append(d)
            winner.append(fw[j])
            total.append(fc[j])
            out["in_history"].append(False)
    return pa.table(out, schema=pa.schema([("digest", pa.string()), ("keep_id", pa.int64()),
                                           ("group_size", pa.int64()), ("in_history", pa.bool_())]))


def groups(history: DataFrame, fresh: DataFrame, n_buckets: int) -> DataFrame:
    """(digest, keep_id, group_size, in_history) over both sides.

    history, fresh: (doc_id, digest). The winner is the smallest doc_id (NULL ids never win unless
    all are NULL)."""
    def per_digest(df):
        d = df.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))
        return d.withColumn("bucket", F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(n_buckets)))
    return (per_digest(history).groupBy("bucket").cogroup(renewed(per_digest(fresh)).groupBy("bucket"))
            .applyInArrow(_lookup, "digest string, keep_id long, group_size long, in_history boolean"))


def exact_dedup(docs: DataFrame, is_history, digests_per_bucket: int = 20_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, in_history for every row of ``docs``.

    docs: any frame with doc_id and text; other columns are ignored. ``is_history``: boolean column
    telling the rows whose digests are already known. NULL text counts as empty; texts of any length
    are digested whole inside the JVM. Rows that repeat a doc_id with an equal text are all counted
    and all marked kept when their id is the winner's; a NULL doc_id never wins over a real id, and
    among NULL ids only, keep_id is NULL and kept is true. An empty table gives an empty result.
    """
    d = cut(docs.select("doc_id", digest_of(F.col("text")).alias("digest"),
                        F.coalesce(is_history, F.lit(False)).alias("_old")))
    n = d.count()
    buckets = max(1, -(-n // digests_per_bucket))
    g = groups(d.filter("_old"), d.filter("NOT _old"), buckets)
    return d.join(g, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"), "in_history")
