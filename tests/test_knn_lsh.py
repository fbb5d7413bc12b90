"""Approximate kNN join: recall against the exact one, copies, short answers, missing values, use in the balancing."""

from functools import partial

import numpy as np
import pytest

import __spark_entry__ as E
from floodspark.operators import balance as BL
from floodspark.operators import knn as KN
from floodspark.operators import knn_lsh as KL
from floodspark.operators.knn_lsh import Projections, knn_lsh
from floodspark.plans import bindings as B

from paths import SF0001


def _frame(spark, X, ids=None):
    ids = range(len(X)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in x]) for i, x in zip(ids, X)], "id long, features array<double>").repartition(5)


def _exact(X, at, k):
    out = {}
    for i in at:
        d = ((X - X[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        out[i] = np.lexsort((np.arange(len(X)), d))[:k].tolist()
    return out


def _clustered(n=3000, d=32, seed=11):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (40, d))
    return centres[rng.integers(0, 40, n)] + rng.normal(0, 0.3, (n, d))


def test_recall_and_work(spark):
    X = _clustered()
    df = _frame(spark, X)
    at = list(range(0, len(X), 10))
    got = {}
    for r in knn_lsh(df.filter("id % 10 = 0"), df, 5, block=256).collect():
        got.setdefault(r.id, {})[r["rank"]] = (r.nn_id, r.d2)
    want = _exact(X, at, 5)
    assert sorted(got) == at and all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values())
    for i, v in got.items():                                     # exact distances, in order
        for nn, d2 in v.values():
            assert nn != i and np.isclose(d2, ((X[i] - X[nn]) ** 2).sum())
        assert [v[r][1] for r in range(1, 6)] == sorted(d2 for _, d2 in v.values())
    recall = np.mean([len({n for n, _ in got[i].values()} & set(want[i])) / 5 for i in at])
    assert recall >= 0.9, recall
    # far fewer pairs than all: shared keys of the same projections, counted once a pair
    spread = float(np.sqrt(X.var(axis=0).sum()))
    proj = Projections(X.shape[1], spread, 12, 4, 1.0, 42)
    own, visited = proj.keys(X, 0), proj.keys(X[at], 4)
    holders = {}
    for i, row in enumerate(own):
        for key in row:
            holders.setdefault(int(key), set()).add(i)
    pairs = sum(len(set().union(*(holders.get(int(key), set()) for key in row))) for row in visited)
    assert pairs < 0.5 * len(at) * len(X), pairs / (len(at) * len(X))


def test_recall_on_the_given_vectors(spark):
    """The registered query; these vectors are close to random (nearest 1.1, typical 1.4), so it needs wide cells."""
    v = B.vectors(spark, SF0001)
    exact = {(r.id, r.nn_id) for r in KN.knn(v, v, 3).collect()}
    near = {(r.id, r.nn_id) for r in E.queries()["knn_join_lsh"](spark, SF0001).collect()}
    assert len(near) == len(exact) and len(near & exact) >= 0.9 * len(exact)


def test_masses_of_copies(spark):
    """Half of the rows are one vector: each gets the smallest other ids of it, no pair of copies is compared twice."""
    X = _clustered(400, 8)
    X[200:] = X[7]
    got = {}
    for r in knn_lsh(_frame(spark, X), _frame(spark, X), 3, block=16).collect():
        got.setdefault(r.id, []).append((r["rank"], r.nn_id, r.d2))
    assert len(got) == 400
    for i in [7, *range(200, 400)]:
        assert sorted(got[i]) == [(n + 1, j, 0.0) for n, j in enumerate([j for j in [7, 200, 201, 202] if j != i][:3])]


def test_far_points_missing_values_and_empty(spark):
    X = np.array([[0.0, 0.0], [1e6, 1e6], [-1e6, 1e6], [5e5, -1e6], [2.0, 2.0]])     # alone in their cells: answered exactly
    df = _frame(spark, X).union(spark.createDataFrame([(None, [1.0, 1.0]), (9, None)], "id long, features array<double>"))
    got = {(r.id, r["rank"]): r.nn_id for r in knn_lsh(df, df, 2).collect()}
    want = _exact(X, range(5), 2)
    assert got == {(i, n + 1): j for i, v in want.items() for n, j in enumerate(v)}
    assert knn_lsh(df, df, 10).count() == 5 * 4                  # no more points than that
    assert knn_lsh(df, df, 0).count() == knn_lsh(df.limit(0), df, 2).count() == knn_lsh(df, df.limit(0), 2).count() == 0


@pytest.mark.parametrize("strategy", ["smote_tomek", "smote_enn"])
def test_balancing_by_approximate_neighbours(spark, strategy):
    X = _clustered(260, 8, 3)
    rows = [(i, [float(v) for v in x], int(i < 40)) for i, x in enumerate(X)]
    df = spark.createDataFrame(rows, "id long, features array<double>, y int")
    out = BL.balance(df, strategy, search=partial(knn_lsh, tables=6))
    made = out.filter("synthetic").toPandas()
    assert len(made) > 100 and (made.y == 1).all() and made.id.is_unique and (made.id < 0).all()


def test_blocks_find_what_the_keys_find(spark):
    """Both ways to bring the rows of a key together give the same neighbours; by blocks, a query hands on ``need`` rows per
    block of points instead of as many per key."""
    X = _clustered(900, 8, 5)
    X[850:] = X[3]
    df = _frame(spark, X)
    points, queries = df.select(df.id.alias("_pid"), df.features.alias("_v")), df.select(df.id.alias("_qid"), df.features.alias("_v"))
    proj = Projections(8, float(np.sqrt(X.var(axis=0).sum())), 6, 3, 1.0, 42)

    def nearest(met):
        out = {}
        for r in met:
            out.setdefault(r["_qid"], set()).add((r["d2"], r["nn_id"]))
        return {q: sorted(v)[:4] for q, v in out.items()}
    by_block = KL._by_block(queries, points, proj, 3, 4, 2, 3).collect()
    assert nearest(by_block) == nearest(KL._by_key(queries, points, proj, 3, 4, 64, 42).collect())
    assert len(by_block) <= 900 * 3 * 4


def test_a_query_is_sent_once_per_block_of_points(spark, monkeypatch):
    X = _clustered(300, 8)
    monkeypatch.setattr(KL, "_by_key", lambda *a: pytest.fail("rows were sent once per key"))
    assert knn_lsh(_frame(spark, X), _frame(spark, X), 3).count() == 900


@pytest.mark.parametrize("width, probes", [(0.3, 1), (1.0, 3), (3.0, 4)])
def test_each_pair_once_or_by_cells(width, probes):
    """Nearest met points of a block against all pairs, ties and points at equal places among them; unmet ones never count."""
    rng = np.random.default_rng(8)
    X = np.round(_clustered(700, 6, 9), 1)
    X[650:] = X[rng.integers(0, 650, 50)]
    Q, pid = np.concatenate([X[:150], np.full((1, 6), 50.0)]), rng.permutation(700) * 3
    proj = Projections(6, float(np.sqrt(X.var(axis=0).sum())), 5, 3, width, 1)
    visited, own = proj.keys(Q, probes), proj.keys(X, 0)
    d2 = KN.sq_dists(Q, X)
    want = {}
    for i in range(len(Q)):
        met = [j for j in range(len(X)) if set(visited[i].tolist()) & set(own[j].tolist())]
        want[i] = sorted((d2[i, j], pid[j]) for j in met)[:4]
    for way in (KL._met_by_cells, KL._met_by_products):
        got = {i: [] for i in want}
        for i, j, d in zip(*way(Q, X, pid, visited, own, 4)):
            got[i].append((d, j))
        assert got == want
