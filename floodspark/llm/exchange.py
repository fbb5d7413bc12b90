"""Packed key exchange: which hashes occur in more than one place, without a row per hash.

Documents are dealt to chunks by their id. A chunk sends every bucket one row with the distinct
hashes that fall into it (packed numpy bytes), so a passage shared by a third of all documents is
one entry per chunk, not one per document. A bucket merges its rows and answers each chunk with the
part of its hashes that qualified; the chunk looks its own hashes up in the answers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, release, renewed

_PACKED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("packed", pa.binary())])
PACKED = "bucket int, chunk int, packed binary"
DEAL_BITS = np.uint64(24)                # top bits of a hash that choose the bucket


def chunked(docs: DataFrame, chunks_per_task: int = 2) -> tuple[DataFrame, int]:
    """docs with a ``chunk`` number, and the number of buckets. The chunk depends on doc_id alone;
    a NULL id counts as one id. Both numbers follow the session's shuffle width."""
    width = parallelism(docs.sparkSession)
    n = width * chunks_per_task
    key = F.xxhash64(F.coalesce(F.col("doc_id"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    return docs.withColumn("chunk", F.pmod(key, F.lit(n)).cast("int")), width


def deal(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket of every hash, from its top bits."""
    return ((h >> np.uint64(40)) * np.uint64(n) >> DEAL_BITS).astype(np.int64)


def pack_rows(chunk: int, h: np.ndarray, record: np.ndarray, n: int) -> pa.Table:
    """One row per bucket with the records of the hashes that fall into it."""
    b = deal(h, n)
    order = np.argsort(b, kind="stable")
    b, record = b[order], record[order]
    at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, int)
    end = np.r_[at[1:], len(b)] if len(b) else at
    return pa.table([pa.array(b[at], pa.int32()), pa.array(np.full(len(at), chunk), pa.int32()),
                     pa.array([record[x:y].tobytes() for x, y in zip(at, end)], pa.binary())], schema=_PACKED)


def merge(packed: DataFrame, dtype, decide) -> DataFrame:
    """Per bucket: ``decide(records, chunk index of each record)`` -> records to answer and a mask or
    index of the asking entries; every chunk gets its own answers as one row."""
    dtype = np.dtype(dtype)

    def answers(t: pa.Table) -> pa.Table:
        chunk = t["chunk"].to_numpy()
        parts = [np.frombuffer(x, dtype) for x in t["packed"].to_pylist()]
        size = np.array([len(x) for x in parts])
        own = np.repeat(np.arange(len(parts)), size)
        answer, keep = decide(np.concatenate(parts), own)
        answer, own = answer[keep], own[keep]
        cutoffs = np.searchsorted(own, np.arange(len(parts) + 1))
        rows = [(chunk[i], answer[x:y].tobytes()) for i, (x, y) in enumerate(zip(cutoffs[:-1], cutoffs[1:])) if y > x]
        b = t["bucket"][0].as_py()
        return pa.table([pa.array([b] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()),
                         pa.array([r[1] for r in rows], pa.binary())], schema=_PACKED)

    def run(t: pa.Table) -> pa.Table:
        try:
            return answers(t)
        finally:
            release(powers=False)
    return packed.groupBy("bucket").applyInArrow(run, PACKED)


def with_answers(docs: DataFrame, answers: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(chunk, docs, answers)`` for every chunk, as Arrow tables."""
    def run(key, left: pa.Table, right: pa.Table):
        try:
            return fn(key[0].as_py(), left, right)
        finally:
            release(powers=False)
    return docs.groupBy("chunk").cogroup(renewed(answers).groupBy("chunk")).applyInArrow(run, schema)


def answers_of(t: pa.Table, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(records, bucket of each) of the answers to a chunk."""
    if "packed" not in t.column_names or not len(t):
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    parts = [np.frombuffer(x, dtype) for x in t["packed"].to_pylist()]
    return np.concatenate(parts), np.repeat(t["bucket"].to_numpy().astype(np.int64), [len(x) for x in parts])


def groups_of(*keys: np.ndarray):
    """(order, first position of each group in that order, group number by original position); the order
    inside a group is any."""
    n = len(keys[0])
    order = np.argsort(keys[0])           # the first key mostly decides
    s = [k[order] for k in keys]
    same = s[0][1:] == s[0][:-1]
    if any((same & (k[1:] != k[:-1])).any() for k in s[1:]):
        order = np.lexsort(keys[::-1])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(new) - 1
    return order, first, number


class Presence:
    """First exchange: 30 bits of each hash beside its bucket, a flag bit and a 'several' bit.

    It only has to rule hashes out, so a chance agreement of the shortened hashes (odds below one in
    a million at any size, as buckets grow in number with the data) costs work, not correctness.
    """
    dtype = np.uint32
    BITS = np.uint64((1 << 30) - 1)

    @staticmethod
    def rows(chunk: int, h: np.ndarray, flag: np.ndarray, owner: np.ndarray, n: int) -> pa.Table:
        """h: hashes with repeats; flag: whether the entry is of the flagged kind; owner: what counts as
        one place (a document or line)."""
        order = np.argsort(h)
        h, flag, owner = h[order], flag[order], owner[order]
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
        if not len(at):
            return _PACKED.empty_table()
        several = np.minimum.reduceat(owner, at) != np.maximum.reduceat(owner, at)
        code = ((h[at] & Presence.BITS) << np.uint64(2)) | (several.astype(np.uint64) << np.uint64(1)) | np.maximum.reduceat(flag, at).astype(np.uint64)
        return pack_rows(chunk, h[at], code.astype(np.uint32), n)

    @staticmethod
    def decide(code: np.ndarray, own: np.ndarray):
        """Hashes with a flagged entry that occur in two places or more."""
        key = code >> np.uint32(2)
        order = np.argsort(key)
        s = key[order]
        at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        flagged = np.bitwise_or.reduceat(code[order] & np.uint32(1), at)
        places = np.add.reduceat((1 + ((code[order] >> np.uint32(1)) & np.uint32(1))).astype(np.int64), at)
        live = np.empty(len(key), bool)
        live[order] = np.repeat((flagged > 0) & (places > 1), np.diff(np.r_[at, len(s)]))
        return key, live

    @staticmethod
    def found(h: np.ndarray, n: int, answers: pa.Table) -> np.ndarray:
        """Which of the chunk's hashes were answered."""
        key, bucket = answers_of(answers, np.uint32)
        live = np.sort((bucket.astype(np.uint64) << np.uint64(30)) | key.astype(np.uint64))
        return member(live, (deal(h, n).astype(np.uint64) << np.uint64(30)) | (h & Presence.BITS))


def member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return sorted_keys[at] == x
