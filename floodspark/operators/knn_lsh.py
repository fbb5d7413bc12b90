"""Approximate k-nearest-neighbour join by bucketed random projections, several tables and several probes.

The exact join (:mod:`floodspark.operators.knn`) has to compute most distances where no bound separates the
data. This one is chosen by the caller, never by size; it has the same arguments and columns:

1. equal vectors are one: a point vector keeps its ``need`` smallest ids (no query can use more), a query vector
   is searched once and its result handed to all of its rows, so masses of copies cost one search;
2. every vector gets one key per table: its projections on ``projections`` random directions, cut into cells of
   ``width`` standard deviations; a query also visits the ``probes`` cells of a table whose borders it is nearest to;
3. point and query rows of one key meet: every block of points with every block of queries, the keys being made and matched
   inside the group, so a query is sent once per block of points and hands on ``need`` rows of it. Where the cells of a block overlap
   so much that they hold more pairs than the block, each of its pairs is compared once. Where the points have more blocks
   than a query has keys, the rows are sent by key instead, to bounded (key, point block, query block) groups;
4. the k best over all tables are kept; queries that met fewer than ``need`` points are answered by the exact join.

Distances are exact; only the set of points compared is approximate. Rows without an id or vector take no part.
What is compared grows with the square of a cell's different vectors (spread over bounded tasks): cells must be narrow
enough for the data, and where neighbours are hardly nearer than other points, no width saves much.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .knn import (_CELLS, _FOUND, _PAIRS, BLOCK, Near, _pair_dists, _stack, default_block, knn, matrix, nearest,
                  nearest_in_block)

SALTS = 16
_ROWS = 4096                               # rows whose keys are made at once
_CALL = 1 << 16                            # pairs that cost as much as the search of a cell does beside its pairs
LOOK = 4                                   # nearest points looked at per wanted one


class Projections:
    """Random directions of all tables, made from a seed; ``sigma`` is the spread of one projection."""

    def __init__(self, dim: int, sigma: float, tables: int, projections: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.tables, self.projections = tables, projections
        self.directions = rng.normal(size=(dim, tables * projections)) / (width * sigma)
        self.offsets = rng.uniform(size=tables * projections)
        self.mix = rng.integers(1, 2**62, size=(tables, projections)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(1, 2**62, size=tables).astype(np.uint64)

    def keys(self, X: np.ndarray, probes: int) -> np.ndarray:
        """len(X) x (tables * (1 + probes)) keys: the own cell of every table, then the cells next to the nearest borders."""
        place = (X @ self.directions + self.offsets).reshape(len(X), self.tables, self.projections)
        cell = np.floor(place)
        within = place - cell
        own = (cell.astype(np.int64).astype(np.uint64) * self.mix).sum(axis=2, dtype=np.uint64) + self.salt
        out = [own]
        if probes:
            gap = np.concatenate([within, 1.0 - within], axis=2)              # to the lower and to the upper border
            shift = np.concatenate([np.uint64(0) - self.mix, self.mix], axis=1)
            near = np.argsort(gap, axis=2, kind="stable")[:, :, :probes]
            for j in range(near.shape[2]):
                out.append(own + np.take_along_axis(np.broadcast_to(shift, gap.shape), near[:, :, j:j + 1], axis=2)[:, :, 0])
        return np.concatenate(out, axis=1).view(np.int64)


def _cells(visited: np.ndarray, own: np.ndarray, pairs_only: bool = False):
    """(rows of the queries, rows of the points) of every cell of a table that has both; or how many pairs and cells these are."""
    order = np.argsort(own, kind="stable")
    keys, start = np.unique(own[order], return_index=True)
    end = np.r_[start[1:], len(own)]
    flat = visited.ravel()
    at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == flat)
    if pairs_only:
        return int((end - start)[at[hit]].sum()), len(np.unique(at[hit]))
    hit = hit[np.argsort(at[hit], kind="stable")]
    cell, row = at[hit], hit // visited.shape[1]
    cuts = np.flatnonzero(np.r_[True, np.diff(cell) != 0, True]) if len(cell) else np.empty(0, np.int64)
    return ((row[a:b], order[start[cell[a]]:end[cell[a]]]) for a, b in zip(cuts[:-1], cuts[1:]))


def _best(found: list[tuple], need: int) -> tuple:
    """Of (query, point, distance) the ``need`` best different ones per query."""
    q, ids, d = (np.concatenate(v) for v in zip(*found))
    o = np.lexsort((ids, d, q))
    q, ids, d = q[o], ids[o], d[o]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (np.diff(q) != 0) | (np.diff(d) != 0) | (np.diff(ids) != 0)
    q, ids, d = q[fresh], ids[fresh], d[fresh]
    start = np.flatnonzero(np.r_[True, np.diff(q) != 0]) if len(q) else np.empty(0, np.int64)
    keep = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)])) < need
    return q[keep], ids[keep], d[keep]


def _share_a_key(visited: np.ndarray, own: np.ndarray, q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether query q and point p of a pair meet in any table."""
    tables, met = own.shape[1], np.zeros(len(q), bool)
    for a in range(0, len(q), _PAIRS):
        r, c = q[a:a + _PAIRS], p[a:a + _PAIRS]
        for t in range(tables):
            met[a:a + _PAIRS] |= (visited[:, t::tables][r] == own[c, t][:, None]).any(axis=1)
    return met


def _met_by_cells(Q, X, pid, visited, own, need: int) -> tuple:
    """(row of Q, id, squared distance) of the nearest met points, every cell compared; what is held is one table's results and the best so far."""
    tables = own.shape[1]
    best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for t in range(tables):
        best = _best([best, *(nearest(Q[q], q, X[p], pid[p], need) for q, p in _cells(visited[:, t::tables], own[:, t]))], need)
    return best


def _met_by_products(Q, X, pid, visited, own, need: int) -> tuple:
    """The same where cells overlap so much that every pair is compared more cheaply once: of the ``LOOK`` x need nearest points of a query
    (and their ties) those that it meets count. A query that meets fewer than ``need`` of them goes by cells."""
    look, out, settled = LOOK * need, [], np.zeros(len(Q), bool)
    step, near = max(1, _CELLS // len(X)), Near(X, look)
    for a in range(0, len(Q), step):
        q = Q[a:a + step]
        r, c = near.candidates(q)
        d = _pair_dists(q, X, r, c)
        o = np.lexsort((pid[c], d, r))
        r, c, d = r[o], c[o], d[o]
        start = np.searchsorted(r, np.arange(len(q) + 1))
        last = start[:-1] + look - 1                                 # no point that is not at hand is nearer than this one
        far = np.where(last < start[1:], d[np.minimum(last, len(d) - 1)], np.inf)
        met = _share_a_key(visited[a:a + step], own, r, c)
        r, c, d = r[met], c[met], d[met]
        settled[a:a + step] = (np.bincount(r[d <= far[r]], minlength=len(q)) >= need) | (len(X) <= look)
        keep = settled[a:a + step][r] & np.isfinite(d)
        out.append((r[keep] + a, pid[c[keep]], d[keep]))
    left = np.flatnonzero(~settled)
    if len(left):
        r, ids, d = _met_by_cells(Q[left], X, pid, visited[left], own, need)
        out.append((left[r], ids, d))
    return _best(out, need)


def met_in_block(proj: Projections, probes: int, need: int):
    """Grouped-map function of one (query block, point block): (_qid, nn_id, d2) of the ``need`` nearest per query among
    the points that it shares a key with."""
    def keys(X: np.ndarray, n: int) -> np.ndarray:
        return np.concatenate([proj.keys(X[a:a + _ROWS], n) for a in range(0, len(X), _ROWS)])

    def run(queries: pa.Table, points: pa.Table) -> pa.Table:
        Q, X = matrix(queries["_v"]), matrix(points["_v"])
        qid, pid = queries["_qid"].to_numpy(), points["_pid"].to_numpy()
        fine_q, fine_x = np.isfinite(Q).all(axis=1), np.isfinite(X).all(axis=1)      # others are at no finite distance
        Q, qid, X, pid = Q[fine_q], qid[fine_q], X[fine_x], pid[fine_x]
        best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if len(Q) and len(X):
            visited, own = keys(Q, probes), keys(X, 0)
            pairs, calls = np.sum([_cells(visited[:, t::proj.tables], own[:, t], True) for t in range(proj.tables)], axis=0)
            once = pairs + _CALL * calls > len(Q) * len(X) and len(np.unique(pid)) == len(pid)      # rows of one id: by cells
            best = (_met_by_products if once else _met_by_cells)(Q, X, pid, visited, own, need)
        return pa.table([pa.array(v) for v in (qid[best[0]], *best[1:])], names=["_qid", "nn_id", "d2"])
    return run


def _spread(points: DataFrame, dim: int) -> float:
    """Standard deviation of a projection on a standard normal direction: root of the summed variances."""
    row = points.agg(*[F.var_pop(F.get("_v", F.lit(j))).alias(f"v{j}") for j in range(dim)]).first()     # one row
    return float(np.sqrt(sum(v or 0.0 for v in row))) or 1.0


def _by_block(distinct: DataFrame, pts: DataFrame, proj: Projections, probes: int, need: int, n_q: int, n_p: int) -> DataFrame:
    """The nearest met points, every one of ``n_q`` blocks of queries searched with every one of ``n_p`` blocks of points."""
    n_q, n_p = max(1, n_q), max(1, n_p)

    def blocks(df, own_id, own, own_n, other, other_n):
        return (df.select(own_id, "_v", F.pmod(F.xxhash64(own_id), F.lit(own_n)).alias(own),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_n - 1).cast("long"))).alias(other))
                .repartition(n_q * n_p, "_ps", "_qs").groupBy("_ps", "_qs"))
    return (blocks(distinct, "_qid", "_qs", n_q, "_ps", n_p)
            .cogroup(blocks(pts, "_pid", "_ps", n_p, "_qs", n_q)).applyInArrow(met_in_block(proj, probes, need), _FOUND))


def _by_key(distinct: DataFrame, pts: DataFrame, proj: Projections, probes: int, need: int, block: int, seed: int) -> DataFrame:
    """The nearest met points of every key, found where the rows of the key meet."""
    def keyed(df, n_probes):
        @F.pandas_udf(T.ArrayType(T.LongType()))
        def keys(vecs: pd.Series) -> pd.Series:
            return pd.Series(list(proj.keys(_stack(vecs), n_probes)) if len(vecs) else [], dtype=object)
        return cut(df.withColumn("_keys", keys("_v")))

    p_rows = keyed(pts, 0).select("_pid", "_v", F.explode("_keys").alias("_key"))
    q_rows = keyed(distinct, probes).select("_qid", "_v", F.explode("_keys").alias("_key"))
    sizes = (p_rows.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / block).alias("_np"))
             .join(q_rows.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / block).alias("_nq")), ["_key"])
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))

    def blocks(df, own_id, own, own_n, other, other_n):
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(own_id, F.lit(seed)), F.lit(SALTS)).cast("int"))
        return (salted.join(sizes, ["_key", "_salt"])
                .withColumn(own, F.pmod(F.xxhash64(own_id), F.col(own_n)))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_n) - 1)))
                .select(own_id, "_v", "_key", "_ps", "_qs"))

    keys = ["_key", "_ps", "_qs"]
    return (blocks(q_rows, "_qid", "_qs", "_nq", "_ps", "_np").groupBy(*keys)
            .cogroup(blocks(p_rows, "_pid", "_ps", "_np", "_qs", "_nq").groupBy(*keys))
            .applyInArrow(nearest_in_block(need, False), _FOUND))


def knn_lsh(queries: DataFrame, points: DataFrame, k: int, features: str = "features", id_col: str = "id",
            exclude_self: bool = True, tables: int = 12, projections: int = 4, width: float = 1.0, probes: int = 4,
            block: int | None = None, seed: int = 42) -> DataFrame:
    """For each query row about its ``k`` nearest rows of ``points`` -> (id, nn_id, rank, d2), ties by id.

    More tables, wider cells and more probes find more of the true neighbours and compare more rows. All vectors have the
    same number of components. Fewer than ``k`` rows come back only where ``points`` has no more."""
    spark = queries.sparkSession
    need = k + (1 if exclude_self else 0)
    pts = points.select(F.col(id_col).alias("_pid"), F.col(features).alias("_v")).dropna()
    qs = queries.select(F.col(id_col).alias("_qid"), F.col(features).alias("_v")).dropna()
    first = pts.first()
    if k <= 0 or first is None:
        return spark.createDataFrame([], f"{id_col} long, nn_id long, rank int, d2 double")
    proj = Projections(len(first["_v"]), _spread(pts, len(first["_v"])), tables, projections, width, seed)

    copies = Window.partitionBy("_v").orderBy("_pid")                    # limited before its shuffle (rank <= need)
    pts = cut(pts.withColumn("_r", F.row_number().over(copies)).filter(F.col("_r") <= need).drop("_r"))
    distinct = cut(qs.groupBy("_v").agg(F.min("_qid").alias("_qid")))
    n = pts.count()
    size = block or default_block(n)
    if -(-n // size) <= tables * (1 + probes):
        met = _by_block(distinct, pts, proj, probes, need, -(-distinct.count() // size), -(-n // size))
    else:
        met = _by_key(distinct, pts, proj, probes, need, block or BLOCK, seed)
    # a point met in several tables ranks once; at most need rows per query and group
    order = Window.partitionBy("_qid").orderBy("d2", "nn_id")
    best = cut(met.withColumn("_r", F.dense_rank().over(order)).filter(F.col("_r") <= need)
               .groupBy("_qid").agg(F.array_sort(F.collect_set(F.struct("d2", "nn_id"))).alias("_found")))
    full = best.filter(F.size("_found") >= need)
    short = cut(distinct.select("_qid", "_v").join(full, ["_qid"], "left_anti"))
    if not short.isEmpty():
        rest = knn(short.select(F.col("_qid").alias("id"), F.col("_v").alias("features")),
                   pts.select(F.col("_pid").alias("id"), F.col("_v").alias("features")), need, exclude_self=False)
        full = full.unionByName(rest.groupBy(F.col("id").alias("_qid")).agg(
            F.array_sort(F.collect_set(F.struct("d2", "nn_id"))).alias("_found")))

    # back to all rows of a vector, which may be a third of the queries: both sides salted
    answers = (distinct.select("_qid", "_v").join(full, ["_qid"]).drop("_qid")
               .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    own = qs.withColumn("_salt", F.pmod(F.xxhash64("_qid"), F.lit(SALTS)).cast("int")).join(answers, ["_v", "_salt"])
    found = F.filter("_found", lambda x: x["nn_id"] != F.col("_qid")) if exclude_self else F.col("_found")
    return (own.select("_qid", F.posexplode(F.slice(found, 1, k)).alias("_pos", "_x"))
            .select(F.col("_qid").alias(id_col), F.col("_x.nn_id").alias("nn_id"),
                    (F.col("_pos") + 1).cast("int").alias("rank"), F.col("_x.d2").alias("d2")))
