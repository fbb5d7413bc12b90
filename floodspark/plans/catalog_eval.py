"""Catalog part 2: evaluation metrics, thresholds, profiles, scaling, split, scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..functions import device as DV
from ..functions import rules as R
from ..operators import clean as CL
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import profile as PR
from ..operators import scale as SC
from ..operators import scenario as SN
from ..operators import split as SP
from ..operators import windows as W
from . import bindings as B
from . import oracle as O
from .registry import query, r6

SC_ = O.with_(O.SCORES)
PRED = ", p AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM scores)"
COUNTS = PRED + """, c AS (SELECT count(*) FILTER (WHERE y <> 1 AND pred <> 1) AS tn, count(*) FILTER (WHERE y <> 1 AND pred = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND pred <> 1) AS fn, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp FROM p)"""


def d0(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END)"


def rates_sql(src: str = "c") -> str:
    prec, rec = d0("tp", "tp + fp"), d0("tp", "tp + fn")
    f1 = d0("2 * tp", "2 * tp + fp + fn")
    return f"""SELECT *, {prec} AS precision, {rec} AS recall, {d0('tn', 'tn + fp')} AS specificity, {f1} AS f1,
  {d0('tp + tn', 'tp + tn + fp + fn')} AS accuracy, ({rec} + {d0('tn', 'tn + fp')}) / 2 AS balanced_accuracy,
  {d0('fn', 'fn + tp')} AS fnr, {d0('fp', 'fp + tn')} AS fpr,
  {prec} * 0.3 + {rec} * 0.5 + {f1} * 0.2 AS selection_score,
  {rec} * 0.6 + {f1} * 0.3 + {prec} * 0.1 AS tuning_score FROM {src}"""


def _pred(spark, sf):
    return B.scores(spark, sf).withColumn("pred", (F.col("score") >= 0.5).cast("int"))


@query("confusion_matrix", SC_ + COUNTS + " SELECT * FROM c")
def q_confusion_matrix(spark, sf):
    return M.confusion_counts(_pred(spark, sf))


@query("binary_metrics", SC_ + COUNTS + ", r AS (" + rates_sql() + """)
SELECT accuracy, balanced_accuracy, precision, recall, f1, specificity, selection_score FROM r""")
def q_binary_metrics(spark, sf):
    return M.binary_metrics(_pred(spark, sf)).select(
        "accuracy", "balanced_accuracy", "precision", "recall", "f1", "specificity", "selection_score")


@query("class_report", SC_ + COUNTS + f""", per AS (
  SELECT '0' AS label, {d0('tn', 'tn + fn')} AS precision, {d0('tn', 'tn + fp')} AS recall,
         {d0('2 * tn', '2 * tn + fn + fp')} AS f1, tn + fp AS support FROM c
  UNION ALL
  SELECT '1', {d0('tp', 'tp + fp')}, {d0('tp', 'tp + fn')}, {d0('2 * tp', '2 * tp + fp + fn')}, tp + fn FROM c)
SELECT * FROM per
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per
UNION ALL SELECT 'weighted avg', {d0('sum(precision * support)', 'sum(support)')}, {d0('sum(recall * support)', 'sum(support)')},
  {d0('sum(f1 * support)', 'sum(support)')}, CAST(sum(support) AS BIGINT) FROM per""")
def q_class_report(spark, sf):
    d = M.class_report(_pred(spark, sf))
    return d.select("label", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"),
                    F.col("support").cast("long").alias("support"))


SCORE_COUNTS = """, sc AS (SELECT score AS s, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg
  FROM scores GROUP BY score),
pb AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_below,
              coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM sc)"""


@query("roc_auc", SC_ + SCORE_COUNTS + """SELECT round(sum(pos * (neg_below + neg * 0.5)) / (sum(pos) * sum(neg)), 10) AS roc_auc FROM pb""")
def q_roc_auc(spark, sf):
    return M.roc_auc(B.scores(spark, sf)).select(F.round("roc_auc", 10).alias("roc_auc"))


@query("average_precision", SC_ + SCORE_COUNTS + """, t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM sc)
SELECT round(sum(pos * (t.P - pos_below) / ((t.P - pos_below) + (t.N - neg_below))) / t.P, 10) AS average_precision
FROM pb, t GROUP BY t.P""")
def q_average_precision(spark, sf):
    return M.average_precision(B.scores(spark, sf)).select(F.round("average_precision", 10).alias("average_precision"))


def sweep_sql(grid, custom: str = "custom_score") -> str:
    vals = ", ".join(f"({p})" for p in grid)
    return f""", g AS (SELECT pct AS threshold_pct FROM (VALUES {vals}) v(pct)),
c AS (SELECT g.threshold_pct, count(*) FILTER (WHERE s.y = 1 AND s.score >= g.threshold_pct / 100.0) AS tp,
        count(*) FILTER (WHERE s.y <> 1 AND s.score >= g.threshold_pct / 100.0) AS fp,
        count(*) FILTER (WHERE s.y = 1 AND NOT s.score >= g.threshold_pct / 100.0) AS fn,
        count(*) FILTER (WHERE s.y <> 1 AND NOT s.score >= g.threshold_pct / 100.0) AS tn
      FROM g, scores s GROUP BY g.threshold_pct),
r AS ({rates_sql()})"""


SWEEP_COLS = "threshold_pct, threshold_pct / 100.0 AS threshold, precision, recall, f1, tp, fp, fn, tn, fnr, fpr, selection_score AS custom_score"


@query("threshold_sweep", SC_ + sweep_sql(P.SWEEP_GRID_PCT) + f" SELECT {SWEEP_COLS} FROM r")
def q_threshold_sweep(spark, sf):
    return M.threshold_sweep(B.scores(spark, sf)).drop("tuning_score")


@query("threshold_row", SC_ + sweep_sql(P.SWEEP_GRID_PCT) + f" SELECT {SWEEP_COLS} FROM r WHERE threshold_pct = 50")
def q_threshold_row(spark, sf):
    return M.threshold_sweep(B.scores(spark, sf)).filter(F.col("threshold_pct") == 50).drop("tuning_score")


@query("best_thresholds", SC_ + sweep_sql(P.SWEEP_GRID_PCT) + """
(SELECT 'best_f1' AS criterion, threshold_pct / 100.0 AS threshold, f1 AS value FROM r ORDER BY f1 DESC, threshold_pct LIMIT 1)
UNION ALL (SELECT 'best_recall', threshold_pct / 100.0, recall FROM r ORDER BY recall DESC, threshold_pct LIMIT 1)
UNION ALL (SELECT 'best_custom', threshold_pct / 100.0, selection_score FROM r ORDER BY selection_score DESC, threshold_pct LIMIT 1)
UNION ALL (SELECT 'min_fn', threshold_pct / 100.0, CAST(fn AS DOUBLE) FROM r ORDER BY fn, precision DESC, threshold_pct LIMIT 1)""")
def q_best_thresholds(spark, sf):
    return M.best_thresholds(M.threshold_sweep(B.scores(spark, sf)))


@query("tuned_threshold", SC_ + sweep_sql(P.TUNE_GRID_PCT) + """
SELECT CASE WHEN tuning_score > 0 THEN threshold_pct / 100.0 ELSE 0.5 END AS threshold,
       CASE WHEN tuning_score > 0 THEN tuning_score ELSE 0.0 END AS score
FROM r ORDER BY tuning_score DESC, threshold_pct LIMIT 1""")
def q_tuned_threshold(spark, sf):
    return M.tuned_threshold(B.scores(spark, sf))


@query("score_histogram", SC_ + """, mm AS (SELECT min(score) AS lo, max(score) AS hi FROM scores),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 15 ELSE least(floor((score - lo) / (hi - lo) * 30), 29) END AS INTEGER) AS bin
      FROM scores, mm WHERE score IS NOT NULL)
SELECT r.bin, coalesce(c.n, 0) AS n FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(30)) r
LEFT JOIN (SELECT bin, count(*) AS n FROM b GROUP BY bin) c USING (bin)""")
def q_score_histogram(spark, sf):
    return M.histogram(B.scores(spark, sf), "score")


@query("class_weights", SC_ + """, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM scores)
SELECT y AS class, count(*) AS n_c, any_value(t.n) / (count(*) * 2.0) AS weight,
  CASE WHEN any_value(t.pos) > 0 THEN any_value(t.neg) / (any_value(t.pos) * 1.0) ELSE 10.0 END AS scale_pos_weight
FROM scores, t GROUP BY y""")
def q_class_weights(spark, sf):
    return M.class_weights(B.scores(spark, sf))


@query("imbalance_ratio", SC_ + """, c AS (SELECT y, count(*) AS n FROM scores GROUP BY y)
SELECT max(n) AS n_majority, min(n) AS n_minority, count(*) AS n_classes, max(n) / CAST(min(n) AS DOUBLE) AS imbalance_ratio,
  min(n) >= 10 AS minority_ok, max(n) / CAST(min(n) AS DOUBLE) > 100 AS warn_extreme FROM c""")
def q_imbalance_ratio(spark, sf):
    return PR.imbalance_ratio(B.scores(spark, sf))


@query("value_counts", SC_ + "SELECT y, count(*) AS n FROM scores GROUP BY y")
def q_value_counts(spark, sf):
    return PR.value_counts(B.scores(spark, sf), "y")


@query("best_model", SC_ + """, m AS (
  SELECT 1 AS ordinal, 'score' AS model, y, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM scores
  UNION ALL SELECT 2, 'inverse', y, CASE WHEN 1 - score >= 0.5 THEN 1 ELSE 0 END FROM scores
  UNION ALL SELECT 3, 'blend', y, CASE WHEN (score + toxic) / 2 >= 0.5 THEN 1 ELSE 0 END FROM scores),
c AS (SELECT ordinal, model, count(*) FILTER (WHERE y <> 1 AND pred <> 1) AS tn, count(*) FILTER (WHERE y <> 1 AND pred = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND pred <> 1) AS fn, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp FROM m GROUP BY ordinal, model),
r AS (""" + rates_sql() + """)
SELECT ordinal, model, selection_score FROM r ORDER BY selection_score DESC, ordinal LIMIT 1""")
def q_best_model(spark, sf):
    s = B.scores(spark, sf)
    models = [(1, "score", F.col("score")), (2, "inverse", 1 - F.col("score")),
              (3, "blend", (F.col("score") + F.col("toxic")) / 2)]
    preds = None
    for o, name, p in models:
        part = s.select(F.lit(o).alias("ordinal"), F.lit(name).alias("model"), "y", (p >= 0.5).cast("int").alias("pred"))
        preds = part if preds is None else preds.unionByName(part)
    res = M.binary_metrics(preds, by=["ordinal", "model"])
    return M.best_model(res).select("ordinal", "model", "selection_score")


# ---------------------------------------------------------------------------------------------
# profiles on readings

RD = O.with_(O.READINGS)
READ_COLS = ["precipitation_mm", "temperature_c", "humidity_pct", "pressure_hpa", "wind_speed_kmh",
             "soil_moisture_pct", "nivel_metros", "taxa_subida_m_h"]


@query("null_profile", RD + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS n_null, "
    f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 4) AS pct_null FROM readings" for c in READ_COLS))
def q_null_profile(spark, sf):
    return PR.null_profile(B.readings(spark, sf), READ_COLS)


@query("dataset_profile", O.with_(O.READINGS, O.REPORTS) + """, m AS (
  SELECT e.event_no, min(n.location) AS location FROM reports e
  JOIN (SELECT DISTINCT location FROM readings) n ON contains(lower(e.location_text), lower(n.location)) GROUP BY e.event_no),
ev AS (SELECT e.event_no, m.location, e.date, e.date - INTERVAL 72 HOUR AS s, e.date + to_days(CAST(coalesce(e.duration_days, 3) AS INTEGER)) AS t
       FROM reports e JOIN m USING (event_no)),
hit AS (SELECT r.location, r.seq, max_by(epoch_us(ev.date) - epoch_us(r.datetime), ev.event_no) AS us
        FROM readings r JOIN ev ON r.location = ev.location AND r.datetime BETWEEN ev.s AND ev.t GROUP BY r.location, r.seq),
lab AS (SELECT r.*, CASE WHEN h.us IS NULL THEN 0 ELSE 1 END AS teve_enchente,
  CASE WHEN h.us IS NULL THEN 0 WHEN h.us / 3.6e9 > 48 THEN 1 WHEN h.us / 3.6e9 > 24 THEN 2 ELSE 3 END AS nivel_alerta
  FROM readings r LEFT JOIN hit h USING (location, seq))
SELECT count(*) AS n_rows, 13 AS n_columns, min(datetime) AS period_start, max(datetime) AS period_end,
  count(DISTINCT location) AS n_locations, CAST(sum(teve_enchente) AS BIGINT) AS n_flood, avg(teve_enchente) AS flood_rate,
  count(*) FILTER (WHERE nivel_alerta = 0) AS n_alert_0, count(*) FILTER (WHERE nivel_alerta = 1) AS n_alert_1,
  count(*) FILTER (WHERE nivel_alerta = 2) AS n_alert_2, count(*) FILTER (WHERE nivel_alerta = 3) AS n_alert_3,
  8 AS n_features, 'precipitation_mm,temperature_c,humidity_pct,pressure_hpa,wind_speed_kmh,soil_moisture_pct,nivel_metros,taxa_subida_m_h' AS features, 'teve_enchente,nivel_alerta' AS targets,
  string_agg(DISTINCT location, ',' ORDER BY location) AS locations FROM lab""")
def q_dataset_profile(spark, sf):
    from ..operators import labels as LB
    d = LB.flood_label(B.readings(spark, sf), B.reports(spark, sf)).drop("tempo_ate_enchente")
    profile = PR.dataset_profile(d, skip=["seq"])
    return profile.select(*[F.array_join(c, ",").alias(c) if c in ("features", "targets", "locations") else c for c in profile.columns])


@query("median_impute", RD + """, m AS (SELECT quantile_cont(precipitation_mm, 0.5) AS mp FROM readings)
SELECT seq, coalesce(precipitation_mm, m.mp) AS precipitation_mm FROM readings, m""")
def q_median_impute(spark, sf):
    r = B.readings(spark, sf).select("seq", "precipitation_mm")
    return SC.median_impute(r, ["precipitation_mm"])


@query("robust_scale", RD + """, q AS (SELECT quantile_cont(nivel_metros, 0.25) AS a1, quantile_cont(nivel_metros, 0.5) AS a2,
  quantile_cont(nivel_metros, 0.75) AS a3, quantile_cont(pressure_hpa, 0.25) AS b1, quantile_cont(pressure_hpa, 0.5) AS b2,
  quantile_cont(pressure_hpa, 0.75) AS b3 FROM readings)
SELECT seq, round((nivel_metros - a2) / CASE WHEN a3 - a1 = 0 THEN 1.0 ELSE a3 - a1 END, 6) AS nivel_metros,
  round((pressure_hpa - b2) / CASE WHEN b3 - b1 = 0 THEN 1.0 ELSE b3 - b1 END, 6) AS pressure_hpa FROM readings, q""")
def q_robust_scale(spark, sf):
    r = B.readings(spark, sf).select("seq", "nivel_metros", "pressure_hpa")
    d = SC.robust_scale(r, ["nivel_metros", "pressure_hpa"])
    return d.select("seq", r6("nivel_metros").alias("nivel_metros"), r6("pressure_hpa").alias("pressure_hpa"))


@query("standard_scale", RD + """, q AS (SELECT avg(nivel_metros) AS m1, stddev_pop(nivel_metros) AS s1,
  avg(humidity_pct) AS m2, stddev_pop(humidity_pct) AS s2 FROM readings)
SELECT seq, round((nivel_metros - m1) / CASE WHEN s1 = 0 THEN 1.0 ELSE s1 END, 6) AS nivel_metros,
  round((humidity_pct - m2) / CASE WHEN s2 = 0 THEN 1.0 ELSE s2 END, 6) AS humidity_pct FROM readings, q""")
def q_standard_scale(spark, sf):
    r = B.readings(spark, sf).select("seq", "nivel_metros", "humidity_pct")
    d = SC.standard_scale(r, ["nivel_metros", "humidity_pct"])
    return d.select("seq", r6("nivel_metros").alias("nivel_metros"), r6("humidity_pct").alias("humidity_pct"))


@query("global_normalise", RD + """SELECT seq, round(nivel_metros / (SELECT max(nivel_metros) FROM readings), 6) AS nivel_norm,
  round((pressure_hpa - (SELECT avg(pressure_hpa) FROM readings)) / (SELECT stddev_samp(pressure_hpa) FROM readings), 6) AS pressure_z
FROM readings""")
def q_global_normalise(spark, sf):
    r = B.readings(spark, sf)
    mx = J.scalar(r, F.max("nivel_metros"))
    mu, sd = J.scalar(r, F.avg("pressure_hpa")), J.scalar(r, F.stddev_samp("pressure_hpa"))
    return r.select("seq", r6(F.col("nivel_metros") / mx).alias("nivel_norm"), r6((F.col("pressure_hpa") - mu) / sd).alias("pressure_z"))


@query("stratified_split", SC_ + """, h AS (SELECT *, CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || ':42'), 1, 13)) AS BIGINT) AS u FROM scores),
c AS (SELECT y, count(*) AS n FROM scores GROUP BY y)
SELECT h.id, h.y, CASE WHEN row_number() OVER (PARTITION BY h.y ORDER BY h.u, h.id) <= ceil(0.2 * c.n) THEN 'test' ELSE 'train' END AS split
FROM h JOIN c USING (y)""")
def q_stratified_split(spark, sf):
    return SP.stratified_split(B.scores(spark, sf).select("id", "y")).select("id", "y", "split")


@query("sparse_column_prune", RD + f""", f AS (SELECT *, avg(precipitation_mm) {O.rows(12)} AS ma12,
  CASE WHEN count(precipitation_mm) {O.rows(24)} = 24 THEN avg(precipitation_mm) {O.rows(24)} END AS ma24_full FROM readings)
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_share, "
    f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) <= 0.3 AS kept FROM f"
    for c in ["precipitation_mm", "nivel_metros", "ma12", "ma24_full"]))
def q_sparse_column_prune(spark, sf):
    from ..operators import frames as FR
    r = B.readings(spark, sf).select("location", "datetime", "seq", "precipitation_mm", "nivel_metros")
    f = W.with_windows(r, {"ma12": FR.rolling_mean_partial("precipitation_mm", 12),
                           "ma24_full": FR.rolling_mean_full("precipitation_mm", 24)})
    cols = ["precipitation_mm", "nivel_metros", "ma12", "ma24_full"]
    kept = CL.sparse_column_prune(f.select(*cols)).columns
    shares = CL.null_shares(f, cols)
    st = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_share")) for c in cols])).alias("s")
    return shares.select(st).select(F.col("s.column").alias("column"), r6("s.null_share").alias("null_share"),
                                    F.col("s.column").isin(kept).alias("kept"))


# ---------------------------------------------------------------------------------------------
# scenarios and modes on readings

def _scen_sql() -> str:
    rows = ["('normal', 1.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0)"] + [
        f"('{n}', {(a[0] + a[1]) / 2}, {(b[0] + b[1]) / 2}, {(c[0] + c[1]) / 2}, {(d[0] + d[1]) / 2}, {(e[0] + e[1]) / 2}, 2.25, 30.0)"
        for n, a, b, c, d, e in P.SCENARIOS]
    return f""", sc AS (SELECT name, CAST(rain AS DOUBLE) AS rain, CAST(lvl AS DOUBLE) AS lvl, CAST(rise AS DOUBLE) AS rise,
  CAST(hum AS DOUBLE) AS hum, CAST(pres AS DOUBLE) AS pres, CAST(wind AS DOUBLE) AS wind, CAST(soil AS DOUBLE) AS soil
  FROM (VALUES {', '.join(rows)}) v(name, rain, lvl, rise, hum, pres, wind, soil)),
x AS (SELECT sc.name AS cenario, r.location, r.datetime, r.seq, r.temperature_c,
  CASE WHEN sc.name = 'normal' THEN r.precipitation_mm ELSE r.precipitation_mm * sc.rain END AS precipitation_mm,
  CASE WHEN sc.name = 'normal' THEN r.nivel_metros ELSE least(greatest(r.nivel_metros + sc.lvl, 0.1), 15.0) END AS nivel_metros,
  CASE WHEN sc.name = 'normal' THEN r.taxa_subida_m_h ELSE least(greatest(r.taxa_subida_m_h * sc.rise, 0.0), 2.0) END AS taxa_subida_m_h,
  CASE WHEN sc.name = 'normal' THEN r.humidity_pct ELSE least(greatest(r.humidity_pct + sc.hum, 0.0), 100.0) END AS humidity_pct,
  CASE WHEN sc.name = 'normal' THEN r.pressure_hpa ELSE r.pressure_hpa - sc.pres END AS pressure_hpa,
  CASE WHEN sc.name = 'normal' THEN r.wind_speed_kmh ELSE r.wind_speed_kmh * sc.wind END AS wind_speed_kmh,
  CASE WHEN sc.name = 'normal' THEN r.soil_moisture_pct ELSE least(greatest(r.soil_moisture_pct + sc.soil, 0.0), 100.0) END AS soil_moisture_pct
  FROM readings r, sc),
pr AS (SELECT *, {O.risk_sql('(precipitation_mm * 24 * 2)')} AS prob_enchente,
              CASE WHEN cenario = 'normal' THEN 0 ELSE 1 END AS truth FROM x)"""


def _scen(spark, sf):
    r = B.readings(spark, sf)
    x = SN.scenario_what_if(r)
    x = x.withColumn("prob_enchente", R.risk_score(F.col("precipitation_mm") * 24 * 2))
    return x.withColumn("truth", F.when(F.col("cenario") == "normal", 0).otherwise(1))


@query("scenario_what_if", RD + _scen_sql() + """SELECT cenario, seq, round(precipitation_mm, 6) AS precipitation_mm,
  round(nivel_metros, 6) AS nivel_metros, round(taxa_subida_m_h, 6) AS taxa_subida_m_h, round(humidity_pct, 6) AS humidity_pct,
  round(pressure_hpa, 6) AS pressure_hpa, round(wind_speed_kmh, 6) AS wind_speed_kmh, round(soil_moisture_pct, 6) AS soil_moisture_pct FROM x""")
def q_scenario_what_if(spark, sf):
    x = SN.scenario_what_if(B.readings(spark, sf))
    cols = ["precipitation_mm", "nivel_metros", "taxa_subida_m_h", "humidity_pct", "pressure_hpa", "wind_speed_kmh",
            "soil_moisture_pct"]
    return x.select("cenario", "seq", *[r6(c).alias(c) for c in cols])


def _mode_sql(t: float, factor: float) -> str:
    return f"CAST({t} AS DOUBLE) * {factor}"


@query("mode_decision", RD + _scen_sql() + "SELECT cenario, seq, " + ", ".join(
    [f"CASE WHEN prob_enchente >= CAST({t} AS DOUBLE) THEN 1 ELSE 0 END AS pred_{n}" for n, t in P.MODES] +
    [f"CASE WHEN prob_enchente >= {_mode_sql(t, 1.5)} THEN 3 WHEN prob_enchente >= {_mode_sql(t, 1.2)} THEN 2 "
     f"WHEN prob_enchente >= {_mode_sql(t, 1.0)} THEN 1 ELSE 0 END AS alert_level_{s}"
     for (n, t), s in zip(P.MODES, ("emerg", "urbano", "conserv"))]) +
    ", round(abs(prob_enchente - 0.5) * 2, 6) AS confidence FROM pr")
def q_mode_decision(spark, sf):
    d = SN.mode_decision(_scen(spark, sf))
    cols = [f"pred_{n}" for n, _ in P.MODES] + [f"alert_level_{s}" for s in ("emerg", "urbano", "conserv")]
    return d.select("cenario", "seq", *cols, r6("confidence").alias("confidence"))


@query("mode_evaluation", RD + _scen_sql() + """, m AS (SELECT pr.*, md.mode, CASE WHEN prob_enchente >= md.t THEN 1 ELSE 0 END AS pred
  FROM pr, (VALUES ('emergencia', 0.05), ('urbano', 0.5), ('conservador', 0.8)) md(mode, t))
SELECT cenario, mode, round(avg(CASE WHEN pred = truth THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(CASE WHEN max(truth) = 1 THEN avg(CASE WHEN pred = 1 THEN 1.0 ELSE 0.0 END) ELSE avg(CASE WHEN pred = 0 THEN 1.0 ELSE 0.0 END) END, 6) AS detection_rate,
  count(*) FILTER (WHERE pred = 1 AND truth = 0) AS false_positives, count(*) FILTER (WHERE pred = 0 AND truth = 1) AS false_negatives,
  count(*) FILTER (WHERE pred = 1) AS total_alerts, round(avg(prob_enchente), 6) AS avg_probability,
  round(max(prob_enchente), 6) AS max_probability, round(min(prob_enchente), 6) AS min_probability
FROM m GROUP BY cenario, mode""")
def q_mode_evaluation(spark, sf):
    d = SN.mode_evaluation(_scen(spark, sf))
    return d.select("cenario", "mode", r6("accuracy").alias("accuracy"), r6("detection_rate").alias("detection_rate"),
                    "false_positives", "false_negatives", "total_alerts", r6("avg_probability").alias("avg_probability"),
                    r6("max_probability").alias("max_probability"), r6("min_probability").alias("min_probability"))


@query("high_risk_summary", RD + _scen_sql() + """SELECT cenario, count(*) AS n_high,
  round((epoch_us(max(datetime)) - epoch_us(min(datetime))) / 3.6e9, 6) AS duration_h, round(max(prob_enchente), 6) AS max_probability
FROM pr WHERE prob_enchente > 0.8 GROUP BY cenario""")
def q_high_risk_summary(spark, sf):
    d = SN.high_risk_summary(_scen(spark, sf), ts="datetime")
    return d.select("cenario", "n_high", r6("duration_h").alias("duration_h"), r6("max_probability").alias("max_probability"))


@query("run_summary", RD + _scen_sql() + """SELECT cenario, count(*) AS n_points,
  round((epoch_us(max(datetime)) - epoch_us(min(datetime))) / 3.6e9, 6) AS duration_h,
  round(avg(temperature_c), 6) AS avg_temperature, round(avg(precipitation_mm), 6) AS avg_precipitation,
  round(avg(nivel_metros), 6) AS avg_level FROM x GROUP BY cenario""")
def q_run_summary(spark, sf):
    d = SN.run_summary(SN.scenario_what_if(B.readings(spark, sf)), ts="datetime")
    return d.select("cenario", "n_points", r6("duration_h").alias("duration_h"), r6("avg_temperature").alias("avg_temperature"),
                    r6("avg_precipitation").alias("avg_precipitation"), r6("avg_level").alias("avg_level"))


@query("run_progress", RD + _scen_sql() + """SELECT cenario, seq, CAST(row_number() OVER (PARTITION BY cenario ORDER BY datetime, seq) - 1 AS BIGINT) AS step,
  CAST(floor(100 * (row_number() OVER (PARTITION BY cenario ORDER BY datetime, seq) - 1) / count(*) OVER (PARTITION BY cenario)) AS INTEGER) AS progress_pct,
  round((epoch_us(datetime) - epoch_us(min(datetime) OVER (PARTITION BY cenario))) / 3.6e9, 6) AS hora_simulacao FROM x""")
def q_run_progress(spark, sf):
    x = SN.scenario_what_if(B.readings(spark, sf)).select("cenario", "datetime", "seq")
    d = W.run_progress(x, key="cenario", order=("datetime", "seq"), ts="datetime")
    return d.select("cenario", "seq", "step", "progress_pct", r6("hora_simulacao").alias("hora_simulacao"))


@query("step_asof", RD + _scen_sql() + """, pg AS (SELECT cenario, seq,
  CAST(floor(100 * (row_number() OVER (PARTITION BY cenario ORDER BY datetime, seq) - 1) / count(*) OVER (PARTITION BY cenario)) AS INTEGER) AS progress_pct FROM x)
SELECT cenario, seq, progress_pct, CASE WHEN progress_pct >= 90 THEN 'extrema' WHEN progress_pct >= 75 THEN 'severa'
  WHEN progress_pct >= 50 THEN 'moderada' ELSE 'leve' END AS intensidade FROM pg""")
def q_step_asof(spark, sf):
    x = SN.scenario_what_if(B.readings(spark, sf)).select("cenario", "datetime", "seq")
    d = W.run_progress(x, key="cenario", order=("datetime", "seq"), ts="datetime")
    return J.step_asof(d, "progress_pct").select("cenario", "seq", "progress_pct", "intensidade")


@query("cold_start_features", RD + "SELECT seq, " + ", ".join(
    [f"round({src} * {f}, 6) AS {n}" for n, src, f in P.COLD_START] +
    ["round((pressure_hpa - 1013.25) / 50.0, 6) AS pressao_normalizada", "round(precipitation_mm * 24, 6) AS precip_24h",
     "round(precipitation_mm * 24 * 2, 6) AS precip_48h"]) + " FROM readings")
def q_cold_start_features(spark, sf):
    r = B.readings(spark, sf)
    return r.select("seq", *[r6(c).alias(n) for n, c in DV.cold_start().items()])


def _full(fn, col, n):
    return f"CASE WHEN count({col}) {O.rows(n)} = {n} THEN {fn}({col}) {O.rows(n)} END"


def _diff(col):
    return f"{col} - lag({col}) {O.w()}"


WARM = {"precipitation_mm_ma_12h": _full("avg", "precipitation_mm", 12), "nivel_metros_ma_12h": _full("avg", "nivel_metros", 12),
        "precipitation_mm_ma_24h": _full("avg", "precipitation_mm", 24), "nivel_metros_ma_24h": _full("avg", "nivel_metros", 24),
        "precipitation_mm_std_12h": _full("stddev_samp", "precipitation_mm", 12), "nivel_metros_std_12h": _full("stddev_samp", "nivel_metros", 12),
        "precipitation_mm_diff": _diff("precipitation_mm"), "nivel_metros_diff": _diff("nivel_metros"), "aceleracao_nivel": _diff("taxa_subida_m_h"),
        "precip_24h": f"sum(precipitation_mm) {O.rows(24)}", "precip_48h": f"sum(precipitation_mm) {O.rows(48)}"}
COLD = {n: f"{src} * {f}" for n, src, f in P.COLD_START} | {"precip_24h": "precipitation_mm * 24", "precip_48h": "precipitation_mm * 24 * 2"}


@query("cold_start_filled", RD + "SELECT seq, " + ", ".join(f"round(coalesce({WARM[n]}, {COLD[n]}), 6) AS {n}" for n in WARM)
       + ", round((pressure_hpa - 1013.25) / 50.0, 6) AS pressao_normalizada FROM readings")
def q_cold_start_filled(spark, sf):
    """Window features, estimated from the reading where there is no history yet."""
    d = W.with_windows(B.readings(spark, sf), {k: v for k, v in W.feature_window_specs(B.readings(spark, sf).columns).items() if k in WARM})
    return DV.with_cold_start(d).select("seq", *[r6(n).alias(n) for n in [*WARM, "pressao_normalizada"]])


@query("asof_table", RD + """, s AS (SELECT location, datetime, seq, nivel_metros / 2 AS threshold FROM readings WHERE precipitation_mm IS NULL),
u AS (SELECT location, datetime, seq, 1 AS kind, CAST(NULL AS DOUBLE) AS threshold FROM readings UNION ALL SELECT location, datetime, seq, 0, threshold FROM s)
SELECT seq, threshold FROM (SELECT seq, kind, round(last_value(threshold IGNORE NULLS) OVER (PARTITION BY location ORDER BY datetime, kind, seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS threshold FROM u) WHERE kind = 1""")
def q_asof_table(spark, sf):
    """As-of lookup in a table of steps: each gap in a station's rain sets its warning threshold until the next."""
    r = B.readings(spark, sf)
    steps = r.filter("precipitation_mm IS NULL").select("location", "datetime", "seq", (F.col("nivel_metros") / 2).alias("threshold"))
    return J.asof_join(r, steps, "datetime", ["threshold"], "location").select("seq", r6("threshold").alias("threshold"))
