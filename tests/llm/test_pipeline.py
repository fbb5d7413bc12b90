import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from floodspark.llm import catalog
from floodspark.llm.common import table
from floodspark.llm.packing import vocabulary
from floodspark.llm.toxicity import CUT, FILTERS, WIDTHS, classify, train, word_rows
from llm.helpers import DOCS, ODD, WORD, docs, prose
from llm.test_dedup import line_brute, near_brute
from llm.test_others import water

#: Names that operators give to columns of their own.
CLASHES = ["score", "predicted", "n_lines", "n_repeats", "n_near", "emptied", "kept", "component_id", "size", "target", "taken",
           "copies", "rate", "chunk", "bucket", "packed", "piece", "start", "length", "offset", "n_words", "held_out", "in_history"]


def corpus():
    """Clean and toxic documents in two languages, near copies, shared lines and odd texts."""
    rng = random.Random(11)
    rows = []
    for i in range(300):
        w = prose(rng, rng.randrange(60, 200), 900)
        toxic = i % 3 == 0
        if toxic:
            for _ in range(8):
                w.insert(rng.randrange(len(w)), f"insult{rng.randrange(6)}")
        lines = [" ".join(w[k:k + 15]) for k in range(0, len(w), 15)]
        if i % 5 == 1:
            lines.insert(rng.randrange(len(lines)), "all rights of this page are kept by its many owners")
        rows.append((i, "\n".join(lines), "en" if i % 2 else "de", rng.choice(["a", "a", "a", "b", "c", None]), int(toxic)))
    for k in range(20):                                                     # near copies: one word of a clean text, own lines
        i, text, lang, source, _ = rows[3 * k + 1]
        w = WORD.findall(text)
        w[len(w) // 2] = "edited"
        rows.append((1000 + k, " ".join(w), lang, source, 0))
    rows += [(2000 + k, t, None, "c", None) for k, t in enumerate(ODD)]
    rows += [(None, "a row without an id", "en", "a", None), (2100, None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = corpus()
    full = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s, _ in rows]
    spark.createDataFrame(full, DOCS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, y) for i, _, _, _, y in rows if y is not None] + [(None, 1, 1), (5, None, None), (999_999, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def plain_score(model, text):
    """One text's score, filter by filter and window by window."""
    rows, _ = word_rows(pa.array([text or ""]))
    z, col = float(model["b"]), 0
    for k, width in enumerate(WIDTHS):
        for f in range(FILTERS):
            at = [sum(float(model["T"][r, col + o * FILTERS + f]) for o in range(width) for r in rows[p + o]) for p in range(len(rows) - width + 1)]
            z += max(0.0, *at, 0.0) * float(model["v"][k * FILTERS + f])
        col += FILTERS * width
    return 1 / (1 + math.exp(-(z - model["cut"] + math.log(CUT / (1 - CUT)))))


def model_of(spark, folder):
    return train(table(spark, folder, "documents"), table(spark, folder, "labels"), ~catalog.held_out())


def test_scores_match_plain_convolution(spark, tables):
    folder, rows = tables
    model = model_of(spark, folder)
    got = {(r.doc_id, r.score) for r in catalog.QUERIES["op4_toxicity"](spark, folder).collect()}
    assert len(got) == len(rows)
    by = dict(got)
    for i, t, *_ in rows[:60] + [r for r in rows if (r[0] or 0) >= 2000]:
        assert by[i] == pytest.approx(plain_score(model, t), abs=2e-4)


def test_held_out_accuracy_and_columns(spark, tables):
    folder, rows = tables
    out = catalog.QUERIES["op4_toxicity"](spark, folder).collect()
    truth = {r[0]: r[4] for r in rows}
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    aside = [(truth[r.doc_id], r.predicted) for r in out if r.held_out and truth[r.doc_id] is not None]
    assert sum(a == b for a, b in aside) >= 0.95 * len(aside) and len(aside) > 60


def test_toxicity_learns_no_held_out_label_and_no_other_column(spark, tables):
    """Wrong labels on held-out rows, and other lang and source values, leave every score as it is."""
    folder, _ = tables
    d, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    wrong = labels.withColumn("toxic", F.when(catalog.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted(map(repr, classify(x, train(x, y, ~catalog.held_out()), "doc_id").collect()))
              for x, y in ((d, labels), (d.withColumns({"source": F.lit("z"), "lang": F.lit("xx")}), wrong))]
    assert scores[0] == scores[1]


def test_each_language_is_cut_at_its_own_threshold(spark, tables, monkeypatch):
    """Two languages cut away from the pooled 0.7, rows without a language and one that was not calibrated at 0.7."""
    folder, rows = tables
    model = model_of(spark, folder)
    score = {r[0]: plain_score(model, r[1]) for r in rows}
    between = lambda s: (s[len(s) // 2] + s[len(s) // 2 - 1]) / 2
    cut = {"en": between(sorted(score[r[0]] for r in rows if r[2] == "en" and r[4] == 1)),
           "de": between(sorted(score[r[0]] for r in rows if r[2] == "de" and r[4] == 0))}
    assert cut["de"] < CUT < cut["en"]
    own = {k: math.log(v / (1 - v)) - math.log(CUT / (1 - CUT)) + model["cut"] for k, v in cut.items()}
    monkeypatch.setattr("floodspark.llm.toxicity.train", lambda *a, **k: model | {"lang_cuts": own})
    monkeypatch.setattr(corpus_pipeline, "train", lambda *a, **k: model | {"lang_cuts": own})
    lang = {r[0]: r[2] for r in rows}
    out = catalog.QUERIES["op4_toxicity"](spark, folder).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.lang_threshold == pytest.approx(cut.get(lang[r.doc_id], CUT), abs=1e-6) and r.predicted == int(r.score >= CUT)
    left = {r.doc_id for r in corpus_pipeline.toxicity(spark, table(spark, folder, "documents"), folder).collect()}
    assert left == {i for i in score if score[i] < cut.get(lang[i], CUT)}
    assert 50 < len([i for i in score if (score[i] < CUT) != (i in left)])
    monkeypatch.setattr(corpus_pipeline, "train", lambda *a, **k: model | {"lang_cuts": {"": own["de"]}})
    left = {r.doc_id for r in corpus_pipeline.toxicity(spark, table(spark, folder, "documents"), folder).collect()}
    assert left == {i for i in score if score[i] < (cut["de"] if lang[i] is None else CUT)}


def test_toxicity_without_labels_or_rows(spark):
    d = docs(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in classify(d, train(d, none), "doc_id").collect()] == [(0.0, 0)] * 2
    assert classify(docs(spark, []), train(docs(spark, []), none), "doc_id").count() == 0
    only = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")     # nothing to learn from two rows, but no failure
    assert classify(d, train(d, only), "doc_id").count() == 2


def test_run_matches_brute_force(spark, tables):
    folder, rows = tables
    model = model_of(spark, folder)
    clean = [r for r in rows if plain_score(model, r[1]) < CUT]
    assert 60 < len(rows) - len(clean) < 140
    # Lines: rows by their id and text, the source travels with the row.
    source = {r[0]: r[3] for r in rows}
    lined = [(r[0], r[-1]) for r in line_brute([r[:2] for r in clean]) if not r[4]]
    gone = {i for i, _, _, kept in near_brute(lined, 5) if not kept}
    assert len(gone) >= 15
    left = [r for r in lined if r[0] not in gone]
    size = Counter()
    for i, t in left:
        size[source[i]] += len(WORD.findall(t or ""))
    names = sorted([s for s in {source[i] for i, _ in left} if s is not None]) + [None]
    goal = water({s: size[s] for s in names}, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5, 2)
    want = Counter()
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(vocabulary())
    for i, t in left:
        rate = goal[source[i]] / size[source[i]] if size[source[i]] else 0
        draw = int(hashlib.md5(f"mix:{'null' if i is None else i}".encode()).hexdigest()[:12], 16) / 2**48
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for p, a in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[a:a + 4096], "<u4")
            want[i, p, a, len(part), zlib.crc32(part.tobytes())] += math.floor(rate) + (draw < rate - math.floor(rate))
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +want
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for seq in fill.values():
        at = 0
        for o, n in sorted(seq):
            assert o == at
            at += n
        assert at <= 4096
    assert len(fill) <= 1.1 * sum(r.length for r in got) / 4096 + 1


def test_stages_keep_extra_columns_with_clashing_names(spark, tables):
    folder, _ = tables
    d = table(spark, folder, "documents").filter("doc_id IS NULL OR doc_id < 90 OR doc_id >= 1000")
    more = d.select("*", *[F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(f"{c}:"), "doc_id")).alias(c) for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES:
        plain, wide = stage(spark, d, folder), stage(spark, more, folder)
        if name == "packing":
            assert wide.columns == plain.columns and wide.count() == plain.count()
            continue
        assert wide.columns == more.columns
        assert sorted(map(repr, wide.select(*d.columns).collect())) == sorted(map(repr, plain.collect()))
        for r in wide.collect():
            assert all(r[c] == (f"{c}:{r.doc_id}" if r.doc_id is not None and r.doc_id % 2 == 0 else None) for c in CLASHES)


def test_stages_on_an_empty_table(spark, tables):
    folder, _ = tables
    d = table(spark, folder, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d, folder).count() == 0
