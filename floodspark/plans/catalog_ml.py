"""Catalog part 4: exact neighbours, Tomek links, edited neighbours and the SMOTE family (SQL-checked by
brute force), the models (rows-only: their invariants are tested in tests/)."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from .. import params as P
from ..operators import balance as BL
from ..operators import frames as FR
from ..operators import knn as KN
from ..operators import knn_lsh as KL
from ..operators import labels as LB
from ..operators import models as MD
from ..operators import split as SP
from ..operators import windows as W
from ..operators import features as FE
from ..session import cut, scratch_path
from . import bindings as B
from . import oracle as O
from .registry import query

D2 = """list_reduce(list_transform(range(1, len(a.features) + 1), lambda i: (a.features[i] - b.features[i]) * (a.features[i] - b.features[i])), lambda x, z: x + z)"""
PAIRS = O.with_(O.VECTORS) + f""", d AS (SELECT a.id, a.y, b.id AS nn_id, b.y AS nn_y, {D2} AS d2
  FROM vectors a JOIN vectors b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, nn_id) AS rank FROM d)"""


@query("knn_join", PAIRS + " SELECT id, nn_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def q_knn_join(spark, sf):
    v = B.vectors(spark, sf)
    return KN.knn(v, v, 3).select("id", "nn_id", "rank")


@query("knn_join_lsh")
def q_knn_join_lsh(spark, sf):
    """The same join by bucketed random projections; wide cells, as these vectors are close to random."""
    v = B.vectors(spark, sf)
    return KL.knn_lsh(v, v, 3, tables=16, projections=6, width=2.0, probes=8)


@query("tomek_links", PAIRS + """, n1 AS (SELECT id, y, nn_id, nn_y FROM r WHERE rank = 1)
SELECT DISTINCT x.id FROM (SELECT a.id FROM n1 a JOIN n1 b ON a.nn_id = b.id AND b.nn_id = a.id WHERE a.y <> a.nn_y
  UNION ALL SELECT a.nn_id FROM n1 a JOIN n1 b ON a.nn_id = b.id AND b.nn_id = a.id WHERE a.y <> a.nn_y) x""")
def q_tomek_links(spark, sf):
    return BL.tomek_links(B.vectors(spark, sf))


@query("enn_filter", PAIRS + " SELECT DISTINCT id FROM r WHERE rank <= 3 AND y <> nn_y")
def q_enn_filter(spark, sf):
    return BL.enn_drop(B.vectors(spark, sf))


def _hash(*cols: str, seed: int = P.SEED) -> str:
    text = "concat_ws(':', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + f", '{seed}')"
    return f"CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT)"


COMPONENTS = 64


def _wide(df):
    """The rows as a training set: one column per feature."""
    return df.select("id", "y", "synthetic", *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(COMPONENTS)])


WIDE = "id, y, synthetic, " + ", ".join(f"features[{i + 1}] AS f{i}" for i in range(COMPONENTS))


def _neighbours(name: str, queries: str, points: str, k: str) -> str:
    """CTE (id, nn_id, nn_y, nf, rank, d2): the k nearest points of every query."""
    return f"""{name} AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY id ORDER BY d2, nn_id) AS rank
  FROM (SELECT a.id, b.id AS nn_id, b.y AS nn_y, b.features AS nf, {D2} AS d2 FROM {queries} a JOIN {points} b ON a.id <> b.id) p) WHERE rank <= {k})"""


def _ranked(source: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {_hash('id')}, id) - 1 AS pos FROM {source}"


def _evenly(source: str) -> str:
    """Seeds with their copies: the new rows spread evenly, the remainder to the first in hash order."""
    return f"""s AS (SELECT s.*, n_new // n + CASE WHEN pos < n_new % n THEN 1 ELSE 0 END AS copies, (n_new + n - 1) // n AS most
  FROM ({_ranked(source)}) s, (SELECT count(*) AS n FROM {source}), c)"""


START = O.with_(O.VECTORS) + """, mino AS (SELECT * FROM vectors WHERE y = 1),
c AS (SELECT count(*) FILTER (WHERE y = 1) AS n_min, count(*) FILTER (WHERE y <> 1) - count(*) FILTER (WHERE y = 1) AS n_new FROM vectors)"""
K = f"(SELECT least({P.SMOTE_K}, n_min - 1) FROM c)"
SYNTH = f"""{_neighbours('mnn', 's', 'mino', K)},
j AS (SELECT s.id, s.features, s.pos, s.most, unnest(range(s.copies)) AS j FROM s WHERE s.copies > 0),
pick AS (SELECT j.*, least({_hash('j.id', 'j.j')} % {K} + 1, m.kmax) AS rank, {_hash('j.id', 'j.j', seed=P.SEED + 1)} / 4503599627370496.0::DOUBLE AS gap
  FROM j JOIN (SELECT id, max(rank) AS kmax FROM mnn GROUP BY id) m ON m.id = j.id),
syn AS (SELECT -(p.pos * p.most + p.j) - 1 AS id, list_transform(range(1, len(p.features) + 1), lambda i: p.features[i] + p.gap * (n.nf[i] - p.features[i])) AS features,
  1 AS y, true AS synthetic FROM pick p JOIN mnn n ON n.id = p.id AND n.rank = p.rank),
bal AS (SELECT id, features, y, false AS synthetic FROM vectors UNION ALL SELECT * FROM syn)"""
SMOTE_SQL = f"{START}, {_evenly('mino')}, {SYNTH}"
TOMEK = f""", {_neighbours('n1', 'bal', 'bal', '1')}, l AS (SELECT a.id, a.nn_id, x.y, a.nn_y FROM n1 a JOIN n1 b ON a.nn_id = b.id AND b.nn_id = a.id JOIN bal x ON x.id = a.id)
SELECT {WIDE} FROM bal WHERE id NOT IN (SELECT id FROM l WHERE y <> nn_y UNION SELECT nn_id FROM l WHERE y <> nn_y)"""


@query("repeat_minority", f"""{START}, r AS ({_ranked('mino')}),
draws AS (SELECT range AS draw, {_hash('range')} % (SELECT n_min FROM c) AS pos FROM range((SELECT CAST(least(greatest(n_new, 0), 3 * n_min) AS BIGINT) FROM c))),
bal AS (SELECT id, features, y, false AS synthetic FROM vectors UNION ALL SELECT -draw - 1, r.features, r.y, true FROM draws JOIN r USING (pos))
SELECT {WIDE} FROM bal""")
def q_repeat_minority(spark, sf):
    return _wide(BL.repeat_minority(B.vectors(spark, sf)))


@query("smote", f"{SMOTE_SQL} SELECT {WIDE} FROM bal")
def q_smote(spark, sf):
    return _wide(BL.smote(B.vectors(spark, sf)))


@query("adasyn", f"""{START}, {_neighbours('near', 'mino', 'vectors', str(P.SMOTE_K))},
share AS (SELECT id, count(*) FILTER (WHERE nn_y <> 1) AS r FROM near GROUP BY id),
s AS (SELECT m.*, CAST(round_even(h.r * n_new / (SELECT CAST(sum(r) AS DOUBLE) FROM share), 0) AS BIGINT) AS copies, n_new + 1 AS most
  FROM ({_ranked('mino')}) m JOIN share h USING (id), c), {SYNTH} SELECT {WIDE} FROM bal""")
def q_adasyn(spark, sf):
    return _wide(BL.adasyn(B.vectors(spark, sf)))


@query("smote_tomek", SMOTE_SQL + TOMEK)
def q_smote_tomek(spark, sf):
    return _wide(BL.smote_tomek(B.vectors(spark, sf)))


@query("smote_enn", f"""{SMOTE_SQL}, {_neighbours('n3', 'bal', 'bal', '3')}
SELECT {WIDE} FROM bal WHERE id NOT IN (SELECT n3.id FROM n3 JOIN bal x ON x.id = n3.id WHERE x.y <> n3.nn_y)""")
def q_smote_enn(spark, sf):
    return _wide(BL.smote_enn(B.vectors(spark, sf)))


@query("borderline_smote", f"""{START}, {_neighbours('near', 'mino', 'vectors', '10')},
danger AS (SELECT m.* FROM mino m JOIN (SELECT id, count(*) FILTER (WHERE nn_y <> 1) AS maj, count(*) AS n FROM near GROUP BY id) d USING (id)
  WHERE maj * 2 >= n AND maj < n), {_evenly('danger')}, {SYNTH} SELECT {WIDE} FROM bal""")
def q_borderline_smote(spark, sf):
    return _wide(BL.borderline_smote(B.vectors(spark, sf)))


@query("oversample_union", SMOTE_SQL + TOMEK)
def q_oversample_union(spark, sf):
    """The balanced training set chosen by the driver-side rule (default strategy)."""
    return _wide(BL.balance(B.vectors(spark, sf), "smote_tomek"))


# ---- models on the labelled feature table -------------------------------------------------------

ML_FEATURES = ["precipitation_mm", "temperature_c", "humidity_pct", "pressure_hpa", "wind_speed_kmh",
               "soil_moisture_pct", "nivel_metros", "taxa_subida_m_h", "hora", "dia_semana", "mes",
               "hora_sin", "hora_cos", "precip_24h", "precip_48h", "precip_72h",
               "precipitation_mm_ma_12h", "nivel_metros_ma_12h", "nivel_metros_std_12h", "nivel_metros_diff"]


def ml_table(spark, sf):
    """Readings -> window features -> calendar -> interval labels -> id / y / split."""
    r = B.readings(spark, sf)
    specs = {**W.rain_window_specs(), "precipitation_mm_ma_12h": FR.rolling_mean_full("precipitation_mm", 12),
             "nivel_metros_ma_12h": FR.rolling_mean_full("nivel_metros", 12),
             "nivel_metros_std_12h": FR.rolling_std_full("nivel_metros", 12),
             "nivel_metros_diff": FR.diff("nivel_metros", 1)}
    d = FE.with_calendar(W.with_windows(r, specs))
    d = LB.flood_label(d, B.reports(spark, sf))
    d = d.withColumnRenamed("seq", "id").withColumnRenamed("teve_enchente", "y")
    # materialised once in the shared checkpoint folder: the split, every fit and every score read it
    d = cut(d.select("id", "y", *ML_FEATURES))
    # every fit passes over the rows many times: one task per core, more where a task would get too many rows
    width = max(spark.sparkContext.defaultParallelism, -(-d.count() // MD.ROWS_PER_TASK))
    return cut(SP.stratified_split(d, "y", "id").repartition(width, "id"))


def _model_query(name):
    def q(spark, sf):
        d = ml_table(spark, sf)
        train, test = d.filter(F.col("split") == "train"), d.filter(F.col("split") == "test")
        model = MD.fit(train, ML_FEATURES, MD.estimators("y")[name], "y")
        return MD.score(model, test, ML_FEATURES)
    q.__name__ = f"q_model_{name}"
    return q


for _key, _name in [("model_rf", "random_forest"), ("model_et", "extra_trees"), ("model_gbt", "gradient_boosting"),
                    ("model_lr", "logistic_regression"), ("model_dt", "decision_tree"),
                    ("model_gbt_weighted", "boosted_weighted")]:
    query(_key)(_model_query(_name))


@query("model_small")
def q_model_small(spark, sf):
    d = ml_table(spark, sf)
    train, test = d.filter(F.col("split") == "train"), d.filter(F.col("split") == "test")
    model = MD.fit(train, ML_FEATURES, MD.small_tree("y", 8), "y")
    return MD.score(model, test, ML_FEATURES)


@query("batch_score")
def q_batch_score(spark, sf):
    """Score with a saved model (save / load round trip); a feature missing from the frame is 0.0."""
    d = ml_table(spark, sf)
    train, test = d.filter(F.col("split") == "train"), d.filter(F.col("split") == "test")
    model = MD.fit(train, ML_FEATURES, MD.estimators("y")["decision_tree"], "y")
    path = scratch_path(spark, f"models/{uuid.uuid4().hex[:12]}")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    return MD.score(loaded, test.drop("nivel_metros_diff"), ML_FEATURES)


STRATEGY = "smote_tomek"


def _parts(spark, sf):
    """The labelled rows with their part: fit, valid or test."""
    d = ml_table(spark, sf)
    tv = SP.stratified_split(d.filter(F.col("split") == "train").drop("split"), "y", "id", out="split2")
    part = F.when(F.col("split2") == "train", "fit").otherwise("valid")
    return cut(tv.withColumn("part", part).drop("split2").unionByName(d.filter(F.col("split") == "test").withColumn("part", F.lit("test")).drop("split")))


def _run(d):
    fit_part, valid, test = (d.filter(F.col("part") == p) for p in ("fit", "valid", "test"))
    return MD.train_and_evaluate(fit_part, valid, test, ML_FEATURES, "y", strategy=STRATEGY)


@query("training_report")
def q_training_report(spark, sf):
    """Balance the fit part, fit all models, tune thresholds on a validation split, report test metrics per model."""
    return _run(_parts(spark, sf))


@query("training_report_json")
def q_training_report_json(spark, sf):
    """The record of a training run as one JSON document (best model, threshold, per-model metrics, class distribution,
    sample counts, features, strategy), written as a JSON sink and read back."""
    from ..sources import tables as TB
    from .pipelines import training_counts, training_report_json
    d = _parts(spark, sf)
    report = cut(_run(d))
    folder = scratch_path(spark, f"training/{uuid.uuid4().hex[:12]}")
    TB.write_json(training_report_json(report, training_counts(d), ML_FEATURES, STRATEGY), folder)
    return spark.read.schema("json string").json(folder)


@query("batch_predict")
def q_batch_predict(spark, sf):
    """Predictions by the decision tree at 0.35, rows without usable features given out as failed."""
    d = ml_table(spark, sf)
    model = MD.fit(d.filter(F.col("split") == "train"), ML_FEATURES, MD.estimators("y")["decision_tree"], "y")
    return MD.predict(model, d.filter(F.col("split") == "test"), ML_FEATURES, 0.35)
