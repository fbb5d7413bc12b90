"""Extra trees: trees whose cuts are drawn at random, grown level by level over the whole frame.

Every tree sees all rows. At a node, ``sqrt(features)`` of the features that are not constant there are drawn, for each
one cut uniformly between its least and greatest value, and the cut with the best weighted Gini gain is taken.
Draws are seeded by (seed, node number), and nodes are numbered in growing order, so neither partitioning nor
retries change a tree. A level takes two grouped aggregations: least and greatest value per node and
feature, then class counts left of each drawn cut. Counts and extremes are exact in any order of
summation. At most ``NODES_PER_PASS`` nodes are looked at in one pass, which bounds what tasks and driver hold: tasks
get the trees of those nodes only, route their rows through them and pre-aggregate per node. A level's nodes are in the order
of their trees, so a level routes a row through a tree once or, where passes part a tree, twice, however many passes it takes.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasProbabilityCol, HasSeed
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

NODES_PER_PASS = 50_000
_PAIRS = 200_000                           # (row, tree) pairs that are scored together
_ROWS = 100_000                            # rows that a task looks at together while growing
_NEAR = 8_192                              # rows that go down a tree together: they stay in the processor's cache
_HOPS = 3                                  # steps down a tree between two looks at which rows have arrived


class Forest:
    """All nodes of all trees in one table; node t is the root of tree t. Leaves have feature -1."""

    COLUMNS = ("feature", "cut", "left", "n0", "n1")

    def __init__(self, feature, cut, left, n0, n1):
        self.feature, self.cut, self.left, self.n0, self.n1 = (np.asarray(x) for x in (feature, cut, left, n0, n1))

    def grown(self, n0: np.ndarray, n1: np.ndarray) -> "Forest":
        m = len(n0)
        return Forest(np.r_[self.feature, np.full(m, -1)], np.r_[self.cut, np.zeros(m)], np.r_[self.left, np.zeros(m, np.int64)],
                      np.r_[self.n0, n0], np.r_[self.n1, n1])

    def route(self, x: np.ndarray, trees: int) -> np.ndarray:
        """The leaf of every row in every tree; a missing value goes left."""
        at = np.tile(np.arange(trees), (len(x), 1))
        row = np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            at = np.where(inner, self.left[at] + (x[row, np.maximum(f, 0)] > self.cut[at]), at)

    def score(self, x: np.ndarray, trees: int, weights: np.ndarray) -> np.ndarray:
        """Mean over the trees of the leaf's weighted share of class 1."""
        a, b = self.n0 * weights[0], self.n1 * weights[1]
        share = b / np.maximum(a + b, 1e-300)
        out = np.zeros(len(x))
        step = max(1, _PAIRS // trees)
        for k in range(0, len(x), step):
            out[k:k + step] = share[self.route(x[k:k + step], trees)].mean(axis=1)
        return out


def _chunks(batches):
    """(values, class) of ``_ROWS`` rows or more at a time."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= _ROWS:
            yield _rows(held)
            held, n = [], 0
    if n:
        yield _rows(held)


def _rows(batches):
    t = pa.Table.from_batches(batches).combine_chunks()
    x = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
    return x, t["y"].combine_chunks().to_numpy(zero_copy_only=False)


class Opened:
    """The open nodes of a pass and the trees that have them, as a table of its own: tasks get and route through no other tree.

    ``level`` nodes are in the order of their trees, so the open nodes of a tree are the run ``spans[t]`` of the pass."""

    def __init__(self, forest: Forest, owner: np.ndarray, opened: np.ndarray):
        tree, first = np.unique(owner[opened], return_index=True)
        self.spans = list(zip(first.tolist(), [*first[1:].tolist(), len(opened)]))
        mine = np.zeros(int(owner.max()) + 1, bool)
        mine[tree] = True
        node = np.flatnonzero(mine[owner])
        new = np.full(len(owner), -1, np.int32)
        new[node] = np.arange(len(node), dtype=np.int32)
        self.root, self.feature = new[tree], forest.feature[node].astype(np.int16)
        # a leaf leads back to itself, so rows that have arrived may take further steps
        inner = self.feature >= 0
        self.left = np.where(inner, new[forest.left[node]], np.arange(len(node), dtype=np.int32)).astype(np.int32)
        self.cut, self.looks_at = np.where(inner, forest.cut[node], np.inf), np.maximum(self.feature, 0).astype(np.int32)
        self.place = np.full(len(node), -1, np.int32)
        self.place[new[opened]] = np.arange(len(opened), dtype=np.int32)
        self.size = len(opened)

    def __iter__(self):
        return iter(zip(self.root.tolist(), self.spans))

    def leaves(self, x: np.ndarray, root: int) -> np.ndarray:
        """The leaf of every row in the tree of ``root``; a missing value goes left."""
        at, flat, width = np.full(len(x), root, np.int32), x.ravel(), x.shape[1]
        rows, node = np.arange(len(x), dtype=np.int32 if x.size < 1 << 31 else np.int64), at
        if self.feature[root] < 0:
            return at
        start = rows * width
        while True:
            for _ in range(_HOPS):
                node = self.left.take(node) + (flat.take(start + self.looks_at.take(node)) > self.cut.take(node))
            going = self.feature.take(node) >= 0
            left = np.count_nonzero(going)
            if left < 0.75 * len(rows):
                at[rows] = node
                rows, node, start = rows[going], node[going], start[going]
            if not left:
                return at


def _pairs(batches, opened: Opened):
    """Per chunk of rows and tree: (values, classes, rows at open nodes, their nodes as numbers in the tree's run, that run)."""
    for x, y in _chunks(batches):
        for root, (a, b) in opened:
            own = opened.place.take(np.concatenate([opened.leaves(x[k:k + _NEAR], root) for k in range(0, len(x), _NEAR)]))
            row = np.flatnonzero(own >= 0)
            if len(row):
                yield x, y, row, own.take(row) - a, slice(a, b)


def _extremes(shared, width: int):
    def run(batches):
        opened = shared.value
        lo, hi = np.full((width, opened.size), np.inf), np.full((width, opened.size), -np.inf)
        last, columns, least, most = None, None, None, None
        for x, _, row, own, run in _pairs(batches, opened):
            if x is not last:
                last, columns = x, np.ascontiguousarray(x.T)             # runs of a column are much faster to reduce
                whole = not np.isnan(x).any()
                least, most = (np.minimum, np.maximum) if whole else (np.fmin, np.fmax)
            order = np.argsort(own.astype(np.uint16) if run.stop - run.start <= 1 << 16 else own, kind="stable")
            row, own = row.take(order), own.take(order)
            at = np.flatnonzero(np.r_[True, np.diff(own) != 0])
            node = own[at] + run.start
            for i in range(width):
                values = columns[i].take(row)
                lo[i, node] = np.fmin(lo[i, node], least.reduceat(values, at))
                hi[i, node] = np.fmax(hi[i, node], most.reduceat(values, at))
        seen = np.flatnonzero((lo <= hi).any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen)] + [pa.array(v[i, seen]) for v in (lo, hi) for i in range(width)],
                                         names=["node"] + [f"{n}{i}" for n in ("lo", "hi") for i in range(width)])
    return run


def _left_counts(shared, tries: int):
    def run(batches):
        opened, feature, at_cut = shared.value
        n = opened.size
        count = np.zeros((2, tries, n), np.int64)
        for x, y, row, own, run in _pairs(batches, opened):
            both, flat, start = own * 2 + (y.take(row) > 0), x.ravel(), row * x.shape[1]
            for t in range(tries):
                left = ~(flat.take(start + feature[run, t].take(own)) > at_cut[run, t].take(own))
                count[:, t, run] += np.bincount(both[left], minlength=2 * (run.stop - run.start)).reshape(-1, 2).T
        flat = count.reshape(2 * tries, n)
        seen = np.flatnonzero(flat.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen)] + [pa.array(v[seen]) for v in flat], names=["node"] + [f"c{i}" for i in range(2 * tries)])
    return run


def _aggregated(d: DataFrame, run, columns: dict, kind: str, n: int, empty: float) -> list[np.ndarray]:
    """``run`` per task, then one row per node: n values of every column (``columns``: name -> aggregate)."""
    schema = "node long" + "".join(f", {c} {kind}" for c in columns)
    t = d.mapInArrow(run, schema).groupBy("node").agg(*[f(c).alias(c) for c, f in columns.items()]).toArrow()
    node, out = t["node"].to_numpy(), []
    for c in columns:
        v = np.full(n, empty)
        v[node] = t[c].to_numpy()
        out.append(v)
    return out


def _gini(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted impurity times weight."""
    total = a + b
    return np.where(total > 0, 2 * a * b / np.where(total > 0, total, 1), 0)


def _draws(seed: int, nodes: np.ndarray, width: int, tries: int) -> tuple[np.ndarray, np.ndarray]:
    """What is drawn for every node: an order of the features, and where between least and greatest value the cuts are."""
    order, place = np.empty((len(nodes), width), np.int64), np.empty((len(nodes), tries))
    for i, node in enumerate(nodes.tolist()):
        draw = np.random.default_rng([seed, node])
        order[i], place[i] = draw.permutation(width), draw.random(tries)
    return order, place


def _cuts(order: np.ndarray, place: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, cut) of every node: the first features in its order that are not constant there; none is a cut at infinity."""
    lo, hi = (np.take_along_axis(v.T, order, axis=1) for v in span)
    first = np.argsort(~(hi > lo), axis=1, kind="stable")[:, :place.shape[1]]
    order, lo, hi = (np.take_along_axis(v, first, axis=1) for v in (order, lo, hi))
    there = hi > lo
    return np.where(there, order, 0), np.where(there, lo + place * (hi - lo), np.inf)


def grow(d: DataFrame, trees: int, depth: int, min_split: int, min_leaf: int, seed: int) -> tuple[Forest, np.ndarray]:
    """Forest over d (x array<double>, y) and the balanced class weights n / (2 n_class)."""
    spark = d.sparkSession
    first = d.select(F.size("x")).first()
    per = {int(r[0]): r[1] for r in d.groupBy((F.col("y") > 0).cast("int")).agg(F.count(F.lit(1))).collect()}      # 2 rows
    total = np.array([per.get(0, 0), per.get(1, 0)], float)
    weights = np.where(total > 0, total.sum() / np.maximum(2 * total, 1), 0)
    one = np.ones(trees, np.int64)
    forest = Forest(-one, 0.0 * one, 0 * one, one * int(total[0]), one * int(total[1]))
    if first is None:
        return forest, weights
    width = first[0]
    tries = max(1, int(np.sqrt(width)))
    level = owner = np.arange(trees)
    with ThreadPoolExecutor(1) as drawing:
        for _ in range(depth):
            n = forest.n0[level] + forest.n1[level]
            level = level[(n >= max(min_split, 2 * min_leaf)) & (forest.n0[level] > 0) & (forest.n1[level] > 0)]
            known, born = len(forest.feature), []
            for k in range(0, len(level), NODES_PER_PASS):
                opened = level[k:k + NODES_PER_PASS]
                drawn = drawing.submit(_draws, seed, opened, width, tries)   # needs no rows, so it is done beside the first pass
                routes = Opened(forest, owner, opened)
                shared = spark.sparkContext.broadcast(routes)
                names = {f"lo{i}": F.min for i in range(width)} | {f"hi{i}": F.max for i in range(width)}
                span = np.array(_aggregated(d, _extremes(shared, width), names, "double", len(opened), np.nan)).reshape(2, width, -1)
                feature, at_cut = _cuts(*drawn.result(), span)
                counted = spark.sparkContext.broadcast((routes, feature, at_cut))
                names = {f"c{i}": F.sum for i in range(2 * tries)}
                left = np.array(_aggregated(d, _left_counts(counted, tries), names, "long", len(opened), 0)).reshape(2, tries, -1)
                right = np.stack([forest.n0[opened], forest.n1[opened]])[:, None, :] - left
                gain = -_gini(left[0] * weights[0], left[1] * weights[1]) - _gini(right[0] * weights[0], right[1] * weights[1])
                allowed = (left.sum(axis=0) >= min_leaf) & (right.sum(axis=0) >= min_leaf)
                best = np.where(allowed, gain, -np.inf).argmax(axis=0)
                i = np.flatnonzero(allowed.any(axis=0))
                children = len(forest.feature) + 2 * np.arange(len(i))
                forest.feature[opened[i]], forest.cut[opened[i]], forest.left[opened[i]] = feature[i, best[i]], at_cut[i, best[i]], children
                both = np.stack([left[:, best[i], i], right[:, best[i], i]], axis=-1).reshape(2, -1).astype(np.int64)
                forest = forest.grown(both[0], both[1])
                owner = np.r_[owner, np.repeat(owner[opened[i]], 2)]
                born.append(np.arange(known, len(forest.feature)))
                known = len(forest.feature)
                shared.destroy()
                counted.destroy()
            level = np.concatenate(born) if born else level[:0]
            if not len(level):
                break
    return forest, weights


class _Shared(HasFeaturesCol, HasLabelCol, HasProbabilityCol, HasSeed):
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of a tree", TypeConverters.toInt)
    minSplit = Param(Params._dummy(), "minSplit", "least rows of a node that is divided", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows of a child", TypeConverters.toInt)

    def getNumTrees(self) -> int:
        return self.getOrDefault(self.numTrees)

    def getMaxDepth(self) -> int:
        return self.getOrDefault(self.maxDepth)


class ExtraTreesClassifier(Estimator, _Shared):
    """Binary extra-trees classifier on balanced class weights; see the module."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", probabilityCol="probability", numTrees=100, maxDepth=15, minSplit=10,
                 minInstancesPerNode=5, seed=42):
        super().__init__()
        self._set(**self._input_kwargs)
        for k, v in (("numTrees", 100), ("maxDepth", 15), ("minSplit", 10), ("minInstancesPerNode", 5), ("seed", 42), ("probabilityCol", "probability")):
            self._setDefault(**{k: v})

    def _fit(self, dataset: DataFrame) -> "ExtraTreesModel":
        d = cut(dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y")))
        p = [self.getOrDefault(x) for x in (self.numTrees, self.maxDepth, self.minSplit, self.minInstancesPerNode, self.seed)]
        model = ExtraTreesModel(*grow(d, *p))
        return self._copyValues(model)


class ExtraTreesModel(Model, _Shared, MLWritable, MLReadable):
    def __init__(self, forest: Forest | None = None, weights: np.ndarray | None = None):
        super().__init__()
        self.forest, self.weights = forest, weights

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast((self.forest, self.weights, self.getOrDefault(self.numTrees)))

        @F.arrow_udf("double")
        def score(column: pa.Array) -> pa.Array:
            forest, weights, trees = shared.value
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            return pa.array(forest.score(x, trees, weights) if len(x) else [], pa.float64())
        p = score(vector_to_array(self.getFeaturesCol()))
        return (dataset.withColumn("_p1", p).withColumn(self.getProbabilityCol(), array_to_vector(F.array(1.0 - F.col("_p1"), F.col("_p1")))).drop("_p1"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: ExtraTreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark, f = self.sparkSession, self.model.forest
        DefaultParamsWriter.saveMetadata(self.model, path, spark, {"weights": [float(w) for w in self.model.weights]})
        columns = {"node": np.arange(len(f.feature))} | {c: getattr(f, c) for c in Forest.COLUMNS}
        spark.createDataFrame(pa.table({c: pa.array(v) for c, v in columns.items()})).write.parquet(f"{path}/nodes")


class _Reader(MLReader):
    def load(self, path: str) -> ExtraTreesModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        t = self.sparkSession.read.parquet(f"{path}/nodes").orderBy("node").toArrow()          # bounded by trees x 2^depth
        model = ExtraTreesModel(Forest(*(t[c].to_numpy() for c in Forest.COLUMNS)), np.array(meta["weights"]))
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model
