"""Operator 11 - centroid clustering over a vector-approximation file (VA-file).

Every dimension is divided into ``2^bits`` cells; a vector's approximation is its cell number in each
dimension. The file's rows are blocks of vectors: the packed cell numbers, and the full vectors beside
them. To assign a block, lookup tables (cell -> least and greatest squared distance to each centroid,
per dimension) are added up over the dimensions, which gives an interval for the distance to every centroid. Only
centroids whose interval reaches below the least upper end can be the nearest; where one is left the
assignment is settled by the approximation alone, and only where intervals overlap is the full vector fetched
and its distances to the centroids left over computed. Everything is in whole numbers, so the intervals are exact
bounds and the result equals that of comparing every full vector with every centroid.

The new centroids need the sums of the full vectors of each cluster: tasks add them up per block, and
k x dimensions sums per task travel.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_folder
from .packed import expand, rows_table, squeeze

BLOCK_ROWS = 4096
LIMIT = 1 << 27                            # components beyond this have squared distances beyond a long
_LONG = pa.int64()


def usable(vectors: DataFrame, dim: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, q (whole components floor(scale * x)) of the vectors with exactly ``dim`` components, none NULL, NaN or infinite."""
    x = F.col("embedding").cast("array<double>")
    good = (F.size("embedding") == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
    q = vectors.filter(F.col("embedding").isNotNull() & good).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("q"))
    fits = F.forall("q", lambda v: F.abs(v) < LIMIT)
    return q.withColumn("q", F.when(fits, F.col("q")).otherwise(F.raise_error(F.lit("component beyond 2^27")).cast("array<long>")))


def first_centroids(q: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The vectors with the k smallest sha256 of "seed:vec_id" (NULL ids after all others, equal ids by vector): k rows."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = q.orderBy(order.asc_nulls_last(), "q").limit(k).select("q").collect()          # k rows
    return np.array([r["q"] for r in rows], np.int64)


def _matrix(column, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if isinstance(column, pa.ChunkedArray) \
        else column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _spans(dim: int):
    """Per task: count, sum, sum of squares, least and greatest value of every dimension."""
    schema = pa.schema([("d", pa.int32())] + [(c, pa.float64()) for c in ("n", "s", "ss")] + [("lo", _LONG), ("hi", _LONG)])

    def run(batches):
        n, total = 0, np.zeros((4, dim))
        total[2], total[3] = np.inf, -np.inf
        for b in batches:
            x = _matrix(b.column("q"), dim)
            if len(x):
                f = x.astype(float)
                n += len(x)
                total = np.vstack([total[0] + f.sum(axis=0), total[1] + (f * f).sum(axis=0), np.minimum(total[2], x.min(axis=0)), np.maximum(total[3], x.max(axis=0))])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, float(n))), pa.array(total[0]), pa.array(total[1]),
                                              pa.array(total[2].astype(np.int64)), pa.array(total[3].astype(np.int64))], schema=schema)
    return run


class Cells:
    """Cell borders of every dimension: equal widths within ``reach`` deviations of the mean (or of all
    values, where those span less); the outer cells take in all that lies beyond."""

    def __init__(self, n, total, squares, lo, hi, bits: int = 6, reach: float = 3.0):
        mean = total / n
        deviation = np.sqrt(np.maximum(squares / n - mean * mean, 0))
        a = np.maximum(lo, np.floor(mean - reach * deviation)).astype(np.int64)
        b = np.minimum(hi, np.ceil(mean + reach * deviation)).astype(np.int64)
        self.cells, self.bits = 1 << bits, bits
        self.start, self.width = a, np.maximum(-(-(b - a + 1) // self.cells), 1)
        edge = a + self.width * np.arange(self.cells)[:, None]
        self.low, self.high = edge.copy(), edge + self.width - 1                      # cell x dimension
        self.low[0], self.high[-1] = np.minimum(lo, self.low[0]), np.maximum(hi, self.high[-1])

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.start) // self.width, 0, self.cells - 1).astype(np.uint8)

    def pack(self, cell: np.ndarray) -> bytes:
        """``bits`` bits per dimension."""
        planes = np.unpackbits(cell[..., None], axis=-1)[..., 8 - self.bits:]
        return np.packbits(planes.ravel()).tobytes()

    def unpack(self, raw: bytes, rows: int, dim: int) -> np.ndarray:
        planes = np.unpackbits(np.frombuffer(raw, np.uint8))[:rows * dim * self.bits].reshape(rows, dim, self.bits)
        return np.packbits(np.concatenate([np.zeros((rows, dim, 8 - self.bits), np.uint8), planes], axis=-1), axis=-1)[..., 0]

    def tables(self, centroids: np.ndarray) -> np.ndarray:
        """dimension x cell x (k least, then k greatest) squared distances to the centroids."""
        c = centroids[:, None, :]
        below, above = self.low - c, c - self.high                                     # k x cell x dimension
        least = np.maximum(np.maximum(below, above), 0) ** 2
        greatest = np.maximum(np.abs(self.low - c), np.abs(self.high - c)) ** 2
        return np.ascontiguousarray(np.concatenate([least, greatest]).transpose(2, 1, 0))


def build(q: DataFrame, dim: int, bits: int = 6) -> tuple[DataFrame, Cells | None]:
    """The VA-file: blocks (ids, cells, vectors) in the shared folder, and the cell borders; None for no vectors."""
    spark = q.sparkSession
    stats = (q.mapInArrow(_spans(dim), "d int, n double, s double, ss double, lo long, hi long")
             .groupBy("d").agg(F.sum("n"), F.sum("s"), F.sum("ss"), F.min("lo"), F.max("hi")).orderBy("d").collect())    # dim rows
    if not stats:
        return q, None
    cells = Cells(*(np.array([r[i] for r in stats]) for i in range(1, 6)), bits=bits)
    schema = pa.schema([("ids", pa.list_(_LONG)), ("cells", pa.binary()), ("vectors", pa.binary())])

    def run(batches):
        for b in batches:
            for a in range(0, len(b), BLOCK_ROWS):
                part = b.slice(a, BLOCK_ROWS)
                x = _matrix(part.column("q"), dim)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("vec_id").to_pylist()], schema[0].type),
                                                  pa.array([squeeze(cells.pack(cells.of(x)))], pa.binary()),
                                                  pa.array([x.astype("<i4").tobytes()], pa.binary())], schema=schema)
    folder = fresh_folder(spark, "va-file")
    q.mapInArrow(run, "ids array<long>, cells binary, vectors binary").write.parquet(folder)
    return spark.read.parquet(folder), cells


def nearest(cell: np.ndarray, full: np.ndarray, centroids: np.ndarray, tables: np.ndarray):
    """(cluster of every vector, number of full distances computed for it).

    cell: cell numbers; full: the vectors, of which only the undecided are read."""
    k, rows = len(centroids), len(cell)
    bound = np.zeros((rows, 2 * k), np.int64)
    for d in range(cell.shape[1]):
        bound += tables[d].take(cell[:, d], axis=0)
    least, greatest = bound[:, :k], bound[:, k:]
    open_ = least <= greatest.min(axis=1, keepdims=True)
    cluster, fetched = open_.argmax(axis=1), np.zeros(rows, np.int64)
    undecided = np.flatnonzero(open_.sum(axis=1) > 1)
    if len(undecided):
        x = full[undecided].astype(np.int64)                                            # the fetch
        best = np.full(len(undecided), np.iinfo(np.int64).max)
        for c in range(k):
            i = np.flatnonzero(open_[undecided, c])
            distance = ((x[i] - centroids[c]) ** 2).sum(axis=1)
            better = distance < best[i]
            best[i[better]], cluster[undecided[i[better]]] = distance[better], c
        fetched[undecided] = open_[undecided].sum(axis=1)
    return cluster, fetched


def _blocks(batches, cells: Cells, dim: int, centroids: np.ndarray):
    tables = cells.tables(centroids)
    for b in batches:
        for ids, packed, raw in zip(b.column("ids"), b.column("cells").to_pylist(), b.column("vectors").to_pylist()):
            full = np.frombuffer(raw, "<i4").reshape(-1, dim)
            cell = cells.unpack(expand(packed), len(full), dim)
            yield ids, full, *nearest(cell, full, centroids, tables)


def _sums(cells: Cells, dim: int, centroids: np.ndarray):
    """Per task: count and component sums of every cluster."""
    schema = pa.schema([("cluster", pa.int32()), ("d", pa.int32()), ("n", _LONG), ("s", _LONG)])

    def run(batches):
        k = len(centroids)
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for _, full, cluster, _ in _blocks(batches, cells, dim, centroids):
            order = np.argsort(cluster, kind="stable")
            at = np.flatnonzero(np.r_[True, np.diff(cluster[order]) != 0])
            total[cluster[order][at]] += np.add.reduceat(full[order].astype(np.int64), at, axis=0)
            n += np.bincount(cluster, minlength=k)
        some = np.repeat(np.flatnonzero(n), dim)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.tile(np.arange(dim), len(some) // dim), pa.int32()),
                                          pa.array(n[some]), pa.array(total[n > 0].ravel())], schema=schema)
    return run


def _assign(cells: Cells, dim: int, centroids: np.ndarray):
    schema = pa.schema([("vec_id", _LONG), ("cluster", pa.int32()), ("distance", _LONG), ("n_fetched", pa.int32())])

    def run(batches):
        for ids, full, cluster, fetched in _blocks(batches, cells, dim, centroids):
            distance = ((full.astype(np.int64) - centroids[cluster]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids.as_py(), _LONG), pa.array(cluster.astype(np.int32)), pa.array(distance),
                                              pa.array(fetched.astype(np.int32))], schema=schema)
    return run


def cluster_vectors(q: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, bits: int = 6, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance (squared, to its centroid), n_fetched (full distances that the last assignment
    had to compute), cluster_inertia, inertia, centroid_sha256 of every row of q (vec_id, q array<long>).

    The centroids start as k of the vectors (all, if fewer), see ``first_centroids``; each round assigns every
    vector to the nearest (ties: smaller number) and moves each centroid that has vectors to their
    floor(mean), computed in whole numbers. Repeated rows and rows without an id count like any other. An empty table gives
    an empty result; extra columns are ignored. On the driver: k x dim sums a round and 5 x dim statistics.
    """
    spark = q.sparkSession
    q = cut(q.select("vec_id", "q"))
    out = "vec_id long, cluster int, distance long, n_fetched int"
    file, cells = build(q, dim, bits)
    if cells is None:
        return spark.createDataFrame([], out + ", cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = first_centroids(q, k, seed)
    for _ in range(rounds):
        sums = (file.mapInArrow(_sums(cells, dim, centroids), "cluster int, d int, n long, s long")
                .groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())  # k x dim rows
        centroids = centroids.copy()
        for r in sums:
            centroids[r["cluster"], r["d"]] = int(r["s"]) // r["n"]
    placed = cut(file.mapInArrow(_assign(cells, dim, centroids), out))
    per = {r[0]: r[1] for r in placed.groupBy("cluster").agg(F.sum("distance")).collect()}                               # k rows
    facts = [(c, n, sum(per.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in per.items()]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "n_fetched", "cluster_inertia", "inertia", "centroid_sha256")
