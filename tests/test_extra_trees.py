"""Extra trees: quality, the rules of a split, equal trees under repartitioning, save and load."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from floodspark.operators import extra_trees as ET
from floodspark.operators import metrics as M
from floodspark.session import ship_package


@pytest.fixture(scope="module")
def rows(spark):
    ship_package(spark)
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (900, 5))
    y = ((x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.2 * rng.normal(0, 1, 900)) > 1.4).astype(int)
    return spark.createDataFrame([(i, *map(float, v), 1.0, int(c)) for i, (v, c) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, e double, constant double, y int")


COLUMNS = ["a", "b", "c", "d", "e", "constant"]


def _pipeline(**kw):
    return Pipeline(stages=[VectorAssembler(inputCols=COLUMNS, outputCol="features"), ET.ExtraTreesClassifier(labelCol="y", numTrees=30, maxDepth=8, seed=3, **kw)])


def _scored(model, d):
    return model.transform(d).select("id", "y", vector_to_array("probability").getItem(1).alias("score"))


def test_quality_repartitioning_and_reload(spark, rows, tmp_path):
    train, test = rows.filter("id % 3 != 0"), rows.filter("id % 3 = 0")
    model = _pipeline().fit(train)
    scored = _scored(model, test)
    assert M.roc_auc(scored).first()[0] > 0.93
    again = _pipeline().fit(train.repartition(7, F.rand(1)))
    a, b = model.stages[-1].forest, again.stages[-1].forest
    assert all(np.array_equal(getattr(a, c), getattr(b, c)) for c in ET.Forest.COLUMNS)
    model.write().overwrite().save(f"{tmp_path}/m")
    assert sorted(map(tuple, _scored(PipelineModel.load(f"{tmp_path}/m"), test).collect())) == sorted(map(tuple, scored.collect()))


def test_node_counts_and_limits(rows):
    stage = _pipeline().fit(rows).stages[-1]
    f = stage.forest
    inner = np.flatnonzero(f.feature >= 0)
    n = f.n0 + f.n1
    assert (n[inner] >= 10).all() and (n[f.left[inner]] >= 5).all() and (n[f.left[inner] + 1] >= 5).all()
    for c in ("n0", "n1"):
        v = getattr(f, c)
        assert (v[f.left[inner]] + v[f.left[inner] + 1] == v[inner]).all()
    assert 5 not in f.feature[inner]                                      # a constant feature is never cut
    x = np.array(rows.select(*COLUMNS).collect(), float)
    y = np.array([r.y for r in rows.select("y").collect()])
    leaf = f.route(x, 30)
    for t in range(30):
        assert np.array_equal(np.bincount(leaf[:, t], minlength=len(n))[np.unique(leaf[:, t])], n[np.unique(leaf[:, t])])
        assert (np.bincount(leaf[y > 0, t], minlength=len(n))[np.unique(leaf[:, t])] == f.n1[np.unique(leaf[:, t])]).all()
    cuts = f.cut[:30][f.feature[:30] >= 0]
    assert len(np.unique(cuts)) == len(cuts) > 20                         # random cuts, not the best ones


def test_passes_of_few_nodes_give_a_forest_of_the_same_kind(rows, monkeypatch):
    monkeypatch.setattr(ET, "NODES_PER_PASS", 17)
    model = _pipeline().fit(rows)
    assert M.roc_auc(_scored(model, rows)).first()[0] > 0.95


def test_one_class_scores_it(rows):
    model = _pipeline().fit(rows.filter("y = 0"))
    assert {r.score for r in _scored(model, rows.limit(5)).collect()} == {0.0}


def test_a_pass_ships_and_routes_through_its_own_trees_only(rows):
    f = _pipeline().fit(rows).stages[-1].forest
    owner = np.arange(30)
    for node in range(len(f.feature)):
        if f.feature[node] >= 0:
            owner = np.r_[owner, node * 0 + owner[node], owner[node]]
    x = np.array(rows.select(*COLUMNS).collect(), float)
    x[::7, 0] = np.nan
    deep = np.flatnonzero((f.feature < 0) & np.isin(owner, [4, 9]))
    deep = deep[np.argsort(owner[deep], kind="stable")]
    opened = ET.Opened(f, owner, deep)
    assert len(opened.feature) == np.isin(owner, [4, 9]).sum() < len(owner) / 5
    whole = f.route(x, 30)
    for (root, (a, b)), tree in zip(opened, (4, 9)):
        place = opened.place[opened.leaves(x, root)]
        assert np.array_equal(deep[place], whole[:, tree]) and place.min() >= a and place.max() < b


def test_cuts_of_a_pass_equal_those_drawn_node_by_node():
    rng = np.random.default_rng(2)
    lo = rng.normal(size=(7, 50))
    hi = lo + np.maximum(rng.normal(size=(7, 50)), 0)                      # about half of the features are constant
    lo[3, ::4] = hi[3, ::4] = np.nan
    hi[:, 11] = lo[:, 11]
    nodes = np.arange(100, 150)
    feature, at_cut = ET._cuts(*ET._draws(3, nodes, 7, 2), np.stack([lo, hi]))
    for i, node in enumerate(nodes):
        draw = np.random.default_rng([3, int(node)])
        some = draw.permutation(7)
        some = some[hi[some, i] > lo[some, i]][:2]
        u = draw.random(2)[:len(some)]
        assert feature[i, :len(some)].tolist() == some.tolist() and at_cut[i, :len(some)].tolist() == (lo[some, i] + u * (hi[some, i] - lo[some, i])).tolist()
        assert np.isinf(at_cut[i, len(some):]).all()


def test_rows_that_arrive_early_stay_at_their_leaf(monkeypatch):
    """A tree whose leaves are at very different depths, rows that arrive at any step."""
    depth = 40
    inner = 2 * np.arange(depth)
    f = ET.Forest([-1], [0.0], [0], [1], [1])
    for d, node in enumerate([0, *(inner[1:])]):
        f.feature[node], f.cut[node], f.left[node] = 0, float(d), len(f.feature)
        f = f.grown(np.ones(2, np.int64), np.ones(2, np.int64))
    x = np.random.default_rng(1).uniform(-2, depth + 2, (1000, 2))
    x[::50, 0] = np.nan
    leaves = np.flatnonzero(f.feature < 0)
    monkeypatch.setattr(ET, "_NEAR", 64)
    opened = ET.Opened(f, np.zeros(len(f.feature), int), leaves)
    (root, (a, b)), = opened
    assert np.array_equal(leaves[opened.place[opened.leaves(x, root)]], f.route(x, 1)[:, 0])
