"""Operator 7 - exact top-k inner-product search by no-random-access aggregation.

Each component is one sorted list. For a query q, list d is read in the order of falling
contribution q_d * x_d (from the top where q_d > 0, from the bottom where q_d < 0), entry after
entry. An entry read raises its candidate's lower bound from the worst value of that list to the
value read; the upper bound adds, for the lists in which the candidate has not come up yet, the
list's frontier (the last value read). Reading stops for a query when all but a handful of
candidates have an upper bound under the k-th best lower bound; the rest are resolved to their
final scores.

Candidates are dealt out in blocks. A block sorts its lists once; the queries that visit it read
them in steps of equal depth and together, so the bounds of a step's entries are a few matrix
products, and a query that has stopped reads no further. Queries visit blocks in groups, and every
visit returns at most k rows per query, so the final merge handles (blocks x k) rows per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import renewed

#: Steps in which a list is read, at most.
STEPS = 8


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, q (long components floor(scale * x)) of usable vectors.

    Left out: NULL ids, NULL vectors and vectors with a NULL, NaN or infinite component.
    """
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good)
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).alias("q")))


def _matrix(column, dim: int) -> np.ndarray:
    if not dim:
        return np.zeros((len(column), 0), np.int64)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def _top(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (score descending, id ascending)."""
    if len(score) > k:
        cut_ = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= cut_)
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))][:k]


class Lists:
    """A block's candidates as one ascending list per component."""

    def __init__(self, items: np.ndarray, ids: np.ndarray):
        self.items, self.ids = items, ids
        self.order = np.argsort(items, axis=0, kind="stable")
        self.sorted = np.take_along_axis(items, self.order, axis=0)
        self.cols = np.arange(items.shape[1])

    def entries(self, a: int, b: int, top: bool):
        """Candidates and values of entries a to b of every list, counted from its top or from its bottom."""
        n = len(self.ids)
        part = slice(n - b, n - a) if top else slice(a, b)
        return self.order[part], self.sorted[part]


def nra(queries: np.ndarray, qids: np.ndarray, lists: Lists, k: int):
    """Yield (query position, candidate positions, scores, depth): the k best candidates of this block
    per query, and how many entries of every list were read for it.

    Bounds are sums of integers, exact in the float type chosen; where they could leave it, candidates
    within the rounding error of the k-th bound stay. Final scores are integer products always."""
    items, ids = lists.items, lists.ids
    n, dim = items.shape
    if not n:
        return
    largest = float(np.abs(items).max(initial=0)) * float(np.abs(queries).max(initial=0))
    peak = 4.0 * largest * max(dim, 1)
    kind = np.float32 if peak < 2**24 else np.float64
    slack = 0.0 if peak < 2**53 else peak * max(dim, 1) * 2.0**-50
    lo, hi = lists.sorted[0].astype(kind), lists.sorted[-1].astype(kind)
    todo = np.arange(len(queries))
    up, down = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
    lower = np.repeat((up @ lo + down @ hi)[:, None], n, axis=1)
    unread = np.ones((2, n, dim), kind)                # from the top, from the bottom
    step = max(1, -(-n // STEPS))
    for depth in range(0, n, step):
        end = min(n, depth + step)
        gain = np.zeros((2, n, dim), kind)
        front = []
        for side, worst in enumerate((lo, hi)):
            rows, values = lists.entries(depth, end, side == 0)
            gain[side][rows, lists.cols] = values - worst
            unread[side][rows, lists.cols] = 0
            front.append(values[0 if side == 0 else -1].astype(kind) - worst)
        lower += up @ gain[0].T + down @ gain[1].T
        upper = lower + (up * front[0]) @ unread[0].T + (down * front[1]) @ unread[1].T
        going = []
        for r, j in enumerate(todo):
            low, own = lower[r], ids != qids[j]
            if own.sum() > k:
                bar = np.partition(low[own], own.sum() - k)[own.sum() - k]
                own &= upper[r] >= bar - slack         # outsiders cannot qualify any more
            rest = np.flatnonzero(own)
            if end < n and len(rest) > max(8 * k, n // 8):
                going.append(r)
                continue
            score = items[rest] @ queries[j]
            best = _top(ids[rest], score, k)
            yield j, rest[best], score[best], end
        if not going:
            return
        todo, lower, up, down = todo[going], lower[going], up[going], down[going]


_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _cell(k: int, query_block: int):
    def run(key, queries: pa.Table, items: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        if not ("q" in queries.column_names and "q" in items.column_names):
            return _OUT.empty_table()
        qid, vid = (np.array(t["vec_id"].to_pylist(), np.int64) for t in (queries, items))
        Q, X = _matrix(queries["q"], dim), _matrix(items["q"], dim)
        out = tuple([np.zeros(0, np.int64)] for _ in range(3))
        lists = Lists(X, vid)
        for a in range(0, len(qid), query_block):
            for j, at, score, _ in nra(Q[a:a + query_block], qid[a:a + query_block], lists, k):
                out[0].append(np.full(len(at), qid[a + j]))
                out[1].append(vid[at])
                out[2].append(score)
        return pa.table([pa.array(np.concatenate(x).astype(np.int64)) for x in out], schema=_OUT)
    return run


def top_k(queries: DataFrame, items: DataFrame, k: int = 20, item_block: int = 4096, query_block: int = 256,
          queries_per_cell: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products, ties to the smaller id.

    queries, items: (vec_id, q array<long>) as made by ``quantised``. A query is never its own
    candidate. Scores must fit in a long. Vectors of other lengths than the query's take no part in its search. A candidate id
    that repeats is listed once per row; a repeated query id is searched once per row and merged.
    Every (query group, item block) pair meets in one task of bounded size: item_block items by
    queries_per_cell queries.
    """
    sizes = items.agg(F.count(F.lit(1))).first()[0], queries.agg(F.count(F.lit(1))).first()[0]
    n_blocks, n_groups = max(1, -(-sizes[0] // item_block)), max(1, -(-sizes[1] // queries_per_cell))

    def cells(df, own, own_n, other, other_n):
        return (df.select("vec_id", "q", F.size("q").alias("dim"),
                          F.pmod(F.xxhash64("vec_id"), F.lit(own_n)).cast("int").alias(own))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1)))))
    keys = ["dim", "block", "cell"]
    found = (cells(queries, "cell", n_groups, "block", n_blocks).groupBy(*keys)
             .cogroup(renewed(cells(items, "block", n_blocks, "cell", n_groups)).groupBy(*keys))
             .applyInArrow(_cell(k, query_block), "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
