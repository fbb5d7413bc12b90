"""Operator 4 - toxicity: a convolutional text classifier over hashed word embeddings, in numpy.

Every word is the sum of two rows of one embedding table: the row of its own hash and the row of its
first letters' hash (word forms share a stem). Filters of widths 1, 2 and 3 run over the whole text,
each is max-pooled, and a logistic layer reads the pooled values. All labelled rows are learnt from: they are
dealt by a hash into shards of about ``shard_rows``, every shard is fitted by numpy in a task of its own, all from the
same start, and the shards' weights are averaged. Every fifth row of a shard is kept out of the fit; thresholds are
calibrated on all of these, together and per language. Scoring runs over all rows in tasks.

The score depends on the text alone. It is shifted so that the threshold calibrated on all languages
together is at 0.7; the per-language thresholds are returned beside it by ``classify`` and are what the
pipeline cuts at. Rows without a language are a language of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, released
from .text import Words, flat, mix, prefix, run_hash, slices

ROWS, DIM, FILTERS, WIDTHS, STEM = 1 << 15, 16, 8, (1, 2, 3), 5
CUT = 0.7
_MARKS = np.zeros(256, bool)
_MARKS[list(b".,;:!?)\"'(")] = True
_COLUMNS = FILTERS * sum(WIDTHS)


def word_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word rows and stem rows as (n, 2) int32, first word of every text), lower-cased (A-Z)."""
    w = Words(column, lower=True)
    end = np.where((w.end - w.start > 1) & _MARKS[w.data[w.end - 1]], w.end - 1, w.end) if len(w) else w.end
    pre = prefix(w.data.astype(np.uint64) + np.uint64(1))
    whole = mix(run_hash(pre, w.start, end), 1)
    stem = mix(run_hash(pre, w.start, np.minimum(end, w.start + STEM)), 2)
    return np.column_stack([whole % np.uint64(ROWS), stem % np.uint64(ROWS)]).astype(np.int32), w.first


def _pooled(T, rows, first):
    """(word values, texts x filters maxima); T holds the embedding rows times every filter's weight at every
    offset, so this is lookups and sums. A text too short for a width has 0."""
    P = T[rows[:, 0]] + T[rows[:, 1]]
    n = len(first) - 1
    value = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
    col = 0
    for k, width in enumerate(WIDTHS):
        m = len(P) - width + 1
        if m <= 0:
            break
        c = P[:m, col:col + FILTERS].copy()
        for o in range(1, width):
            c += P[o:o + m, col + o * FILTERS:col + (o + 1) * FILTERS]
        col += FILTERS * width
        has = np.flatnonzero(np.diff(first) >= width)
        if not len(has):
            continue
        # Segments alternate: a text's windows, then the windows that run over its end (dropped).
        bounds = np.column_stack([first[has], first[has + 1] - width + 1]).ravel()
        bounds = bounds[:-1] if bounds[-1] >= m else bounds
        top = np.maximum.reduceat(c, bounds, axis=0)[::2]
        value[has, k * FILTERS:(k + 1) * FILTERS] = top
    return P, value


def logits(model: dict, rows, first) -> np.ndarray:
    _, value = _pooled(model["T"], rows, first)
    return np.maximum(value, 0) @ model["v"] + model["b"]


def _train(rows: list[np.ndarray], y: np.ndarray, epochs: int, seed: int = 7) -> dict:
    """Adam on log loss; gradients only reach the words that won a filter's maximum."""
    rng = np.random.default_rng(seed)
    E = rng.normal(0, 0.05, (ROWS, DIM)).astype(np.float32)
    # First coordinate: log odds of the row over the sample's texts, drawn to 0 by four texts of the mean mixture.
    n = np.zeros((2, ROWS))
    for r, t in zip(rows, y):
        n[int(t)][np.unique(r)] += 1
    share = (y.sum() + 1) / (len(y) + 2)
    E[:, 0] = np.clip(np.log((n[1] + 4 * share) / (n[0] + 4 * (1 - share)) * (1 - share) / share), -3, 3) / 2
    W = rng.normal(0, 0.15, (DIM, _COLUMNS)).astype(np.float32)
    W[0, :] += 0.3
    v = np.full(FILTERS * len(WIDTHS), 0.2, np.float32)
    p = {"E": E, "W": W, "v": v, "b": np.float32(-1.0) * np.ones(1, np.float32)}
    m, s = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step = 0
    columns = [(k, sum(WIDTHS[:k]) * FILTERS) for k in range(len(WIDTHS))]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), 64):
            part = order[a:a + 64]
            R = np.concatenate([rows[i] for i in part])
            first = np.r_[0, np.cumsum([len(rows[i]) for i in part])]
            T = p["E"] @ p["W"]
            P, value = _pooled(T, R, first)
            h = np.maximum(value, 0)
            z = h @ p["v"] + p["b"]
            d = (1 / (1 + np.exp(-z)) - y[part]) / len(part)
            g = {"v": h.T @ d, "b": d.sum(keepdims=True), "E": np.zeros_like(E), "W": np.zeros_like(W)}
            dh = np.outer(d, p["v"]) * (value > 0)
            for k, col in columns:
                width = WIDTHS[k]
                for j in range(len(part)):
                    x, y_ = first[j], first[j + 1] - width + 1
                    if y_ <= x:
                        continue
                    c = sum(P[x + o:y_ + o, col + o * FILTERS:col + (o + 1) * FILTERS] for o in range(width))
                    at = c.argmax(axis=0) + x
                    for f in np.flatnonzero(dh[j, k * FILTERS:(k + 1) * FILTERS]):
                        u = dh[j, k * FILTERS + f]
                        for o in range(width):
                            q = col + o * FILTERS + f
                            r0, r1 = R[at[f] + o]
                            g["W"][:, q] += u * (p["E"][r0] + p["E"][r1])
                            g["E"][r0] += u * p["W"][:, q]
                            g["E"][r1] += u * p["W"][:, q]
            step += 1
            for name, lr in (("E", 0.01), ("W", 0.01), ("v", 0.01), ("b", 0.01)):
                m[name] = 0.9 * m[name] + 0.1 * g[name]
                s[name] = 0.99 * s[name] + 0.01 * g[name] ** 2
                p[name] = (p[name] - lr * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


def _best_cut(z: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> float:
    """Threshold with the best F1, in the middle of its gap; z holds ``n`` rows each, ``toxic`` of them of class 1."""
    at, place = np.unique(-z, return_inverse=True)
    z = -at
    tp, all_ = np.cumsum(np.bincount(place, weights=toxic)), np.cumsum(np.bincount(place, weights=n))
    k = int(np.argmax(2 * tp / (all_ + tp[-1])))
    return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1)


PIECES, BIN = 64, 256                      # of the embedding table in the averaging; calibration bins to a unit of logit
WORDS = 1 << 18                            # of 64 bits in the filter of labelled ids
_FITTED = "piece int, shard int, n int, weights binary"


def _fit(epochs: int):
    """One shard: its weights in pieces (the last one holds all but the embedding table)."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("order")                                # the order of a shuffle is not fixed
        rows, text = [], flat(t["text"])
        for a, b in slices(text, 500_000):
            r, first = word_rows(text.slice(a, b - a))
            rows += [r[x:y] for x, y in zip(first[:-1], first[1:])]
        y = t["toxic"].to_numpy().astype(np.float32)
        p = _train(rows, y, epochs)
        parts = [*np.split(p["E"], PIECES), np.concatenate([p["W"].ravel(), p["v"], p["b"]])]
        shard = t["shard"][0].as_py()
        return pa.table([pa.array(np.arange(len(parts)), pa.int32()), pa.array([shard] * len(parts), pa.int32()), pa.array([len(y)] * len(parts), pa.int32()),
                         pa.array([np.asarray(x, np.float32).tobytes() for x in parts], pa.binary())], names=["piece", "shard", "n", "weights"])
    return run


def _average(t: pa.Table) -> pa.Table:
    """One piece: the mean of the shards' weights, each by its number of rows."""
    t = t.sort_by("shard")
    n = t["n"].to_numpy().astype(np.float64)
    total = sum(np.frombuffer(w, np.float32).astype(np.float64) * k for w, k in zip(t["weights"].to_pylist(), n))
    return pa.table([t["piece"][:1], pa.array([int(n.sum())], pa.int64()), pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())],
                    names=["piece", "fit_rows", "weights"])


def _binned(shared):
    """The calibration bin of every row's logit."""
    def run(batches):
        model = shared.value
        for batch in batches:
            text = flat(batch.column("text"))
            for a, b in slices(text, 500_000):
                z = logits(model, *word_rows(text.slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, b - a), batch.column("toxic").slice(a, b - a),
                                                  pa.array(np.round(np.clip(z, -64, 64) * BIN).astype(np.int32))], names=["lang", "toxic", "bin"])
    return run


def _places() -> list:
    return [F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(i)), F.lit(WORDS * 64)) for i in (1, 2)]


def _maybe_in(known: DataFrame):
    """A condition on doc_id: false only for ids that ``known`` lacks (a Bloom filter of a fixed size)."""
    bits = (known.select(F.explode(F.array(*_places())).alias("at")).groupBy(F.expr("at >> 6").alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("bits")).toArrow())          # at most WORDS rows
    words = np.zeros(WORDS, np.int64)
    words[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    shared = known.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf("boolean")
    def held(a: pa.Array, b: pa.Array) -> pa.Array:
        a, b = (x.to_numpy(zero_copy_only=False) for x in (a, b))
        return pa.array(((shared.value[a >> 6] >> (a & 63)) & (shared.value[b >> 6] >> (b & 63)) & 1).astype(bool))
    return held(*_places())


def train(docs: DataFrame, labels: DataFrame, usable=None, shard_rows: int = 5000, epochs: int = 4) -> dict:
    """Fit on all labelled rows, in shards of about ``shard_rows``.

    usable: condition on labels.doc_id telling the rows that may be learnt from. NULL labels and ids
    and rows without a document are not used. Without rows of both classes there is nothing to learn:
    the model then scores every text 0.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = (known.filter(usable) if usable is not None else known).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r[0]: r[1] for r in known.groupBy("toxic").agg(F.count(F.lit(1))).collect()}
    if len(n) < 2:
        return {}
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    shards = -(-sum(n.values()) // shard_rows)
    known = known.withColumn("order", order).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).cast("int"))
    # the numbers of a shard's rows in hash order; every fifth is kept out of the fit
    place = F.row_number().over(Window.partitionBy("shard").orderBy("order", "doc_id"))
    known = known.withColumn("aside", place % 5 == 1)
    text = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), (F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns
                       else F.lit("")).alias("lang")).filter("text IS NOT NULL")
    # only texts that may be labelled are shuffled; both sides meet by doc_id at every size
    rows = cut(text.filter(_maybe_in(known)).join(known.hint("merge"), "doc_id").select("shard", "order", "text", "lang", "toxic", "aside"))
    fitted = (rows.filter("NOT aside").select("shard", "order", "text", "toxic").repartition(shards, "shard").groupBy("shard").applyInArrow(_fit(epochs), _FITTED)
              .groupBy("piece").applyInArrow(_average, "piece int, fit_rows long, weights binary").orderBy("piece").collect())       # one model
    if not fitted:
        return {}
    parts = [np.frombuffer(r["weights"], np.float32) for r in fitted]
    E, rest = np.concatenate(parts[:-1]).reshape(ROWS, DIM), parts[-1]
    W, v, b = rest[:DIM * _COLUMNS].reshape(DIM, _COLUMNS), rest[DIM * _COLUMNS:-1], rest[-1]
    model = {"T": (E @ W).astype(np.float32), "v": v, "b": float(b), "fit_rows": fitted[0]["fit_rows"]}
    bins = (rows.filter("aside").select("text", "lang", "toxic").mapInArrow(released(_binned(spark.sparkContext.broadcast(model))), "lang string, toxic int, bin int")
            .groupBy("lang", "bin").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).toArrow())      # bins: a fixed number per language
    lang, at, t, k = (np.array(bins[c].to_pylist()) for c in ("lang", "bin", "t", "n"))
    model["cut"] = _best_cut(at / BIN, t, k) if len(at) else 0.0
    model["lang_cuts"] = {str(x): _best_cut(at[own] / BIN, t[own], k[own]) for x in np.unique(lang) for own in [lang == x] if 0 < t[own].sum() < k[own].sum()}
    return model


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _scores(shared):
    lift = float(np.log(CUT / (1 - CUT)))

    def run(batches):
        model = shared.value
        for batch in batches:
            text = flat(batch.column(batch.schema.get_field_index("__text")))
            for a, b in slices(text, 500_000):
                if model:
                    rows, first = word_rows(text.slice(a, b - a))
                    score = _sigmoid((logits(model, rows, first) - model["cut"] + lift).astype(np.float64))
                else:
                    score = np.zeros(b - a)
                part = batch.slice(a, b - a)
                keep = [i for i, f in enumerate(batch.schema) if f.name != "__text"]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in keep] + [pa.array(score)],
                                                 names=[batch.schema.field(i).name for i in keep] + ["score"])
    return run


def classify(docs: DataFrame, model: dict, *keep: str) -> DataFrame:
    """The columns ``keep`` of docs plus score (0 to 1), predicted (score >= 0.7) and, where ``keep`` has
    ``lang``, lang_threshold (the score at which that language's own calibrated threshold lies; 0.7 for
    languages without labels of both classes to calibrate on).

    NULL and empty texts are scored like a text in which no filter fires. A rerun gives equal scores.
    ``keep`` must not name the new columns; rename such columns before.
    The model has a fixed size (a table of 32768 x 48 numbers) and travels as a broadcast variable.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    d = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name != "__text")
    s = d.mapInArrow(released(_scores(shared)), (types + ", " if types else "") + "score double")
    s = s.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
    if "lang" in keep:
        lift = float(np.log(CUT / (1 - CUT)))
        cuts = {k: float(_sigmoid(v - model["cut"] + lift)) for k, v in model.get("lang_cuts", {}).items()}
        pairs = [x for k, v in cuts.items() for x in (F.lit(k), F.lit(v))]
        own = F.create_map(*pairs)[F.coalesce(F.col("lang").cast("string"), F.lit(""))] if pairs else F.lit(None)
        s = s.withColumn("lang_threshold", F.coalesce(own, F.lit(CUT)))
    return s
