"""The toxicity classifier: gradients and pooling against brute force, held-out accuracy, awkward rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuewright.llm import toxicity
from cuewright.llm.toxicity import DIM, FILTERS, WIDTHS, Cnn, Trainer, _pieces, features, fitted

SCHEMA = "doc_id long, text string, lang string, source string"


def slow_scores(model, texts):
    """One text and one window at a time."""
    out = []
    for text in texts:
        places, inverse, _ = features(pa.array([text], pa.string()))
        vectors = [model.weights["vectors"][p].sum(axis=0) for p in places[inverse]] or [np.zeros(DIM)]
        vectors += [np.zeros(DIM)] * (max(WIDTHS) - 1)
        h = []
        for w in WIDTHS:
            f = model.weights[f"filter{w}"]
            h.append(np.max([sum(vectors[i + j] @ f[j] for j in range(w)) for i in range(len(vectors) - max(WIDTHS) + 1)], axis=0))
        z = np.maximum(np.concatenate(h) + model.weights["shift"], 0) @ model.weights["out"] + model.weights["bias"][0]
        out.append(1 / (1 + np.exp(-z)))
    return np.array(out)


def texts_of(rng, n):
    return [" ".join(rng.choice(["Alpha", "beta,", "gamma", "über", "x"]) + str(rng.randrange(30)) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_scores_match_windows_one_by_one():
    texts = [*texts_of(random.Random(1), 40), "", " ... ", "one"]
    model = Cnn(3)
    model.weights["shift"] += 0.3
    assert np.allclose(model.scores(pa.array([*texts, None])), slow_scores(model, [*texts, ""]), atol=1e-5)


@pytest.mark.parametrize("piece", [40, 200, 4000])
def test_pieces_of_long_texts_change_nothing(monkeypatch, piece):
    texts = [" ".join(texts_of(random.Random(2), 30)), "two words " + "- " * 3000 + "end of it all", "w" * 5000, ""]
    model = Cnn(4)
    whole = model.scores(pa.array(texts))
    monkeypatch.setattr(toxicity, "PIECE", piece)
    assert np.allclose(model.scores(pa.array(texts)), whole, atol=1e-6)
    assert len(list(_pieces(texts[0]))) > (piece < len(texts[0]))


def test_gradients_match_differences(monkeypatch):
    monkeypatch.setattr(toxicity, "DROPPED", 0.0)
    texts, y = texts_of(random.Random(5), 6), np.array([1, 0, 1, 0, 0, 1], np.float32)
    model = Cnn(6)
    model.weights["shift"] += 0.2
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    told = {}
    trainer = Trainer(model)
    trainer.step = lambda name, g, rows=slice(None): told.update({name: (g, rows)})
    parts = features(pa.array(texts))
    trainer.learn(*parts, y)

    def loss():
        p = slow_scores(model, texts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    rng = np.random.default_rng(7)
    for name, (g, rows) in told.items():
        full = np.zeros_like(model.weights[name])
        full[rows] = g
        places = np.argwhere(np.abs(full) > 1e-5)
        for at in places[rng.permutation(len(places))[:6]]:
            at = tuple(at)
            old = model.weights[name][at]
            model.weights[name][at] = old + 1e-4
            up = loss()
            model.weights[name][at] = old - 1e-4
            down = loss()
            model.weights[name][at] = old
            assert abs((up - down) / 2e-4 - full[at]) < 2e-3 + 0.05 * abs(full[at]), name


def labelled_rows(n, seed):
    """Texts in two languages; toxic ones hold some of a few words, or new words with their stems."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang, toxic = rng.choice(["en", "fr"]), int(rng.random() < 0.3)
        words = [f"{lang}{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                words[rng.randrange(len(words))] = rng.choice(["nasty", "vilest"]) if lang == "en" else f"infâme{rng.randrange(500)}"
        rows.append((i, " ".join(words), lang, "s"))
        labels.append((i, None if i % 17 == 0 else toxic))
    return rows, labels


def test_held_out_rows_and_thresholds(spark):
    rows, labels = labelled_rows(900, 8)
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    model, limits = toxicity.calibrated(docs, marks)
    out = toxicity.flagged(docs, model, limits).join(marks, "doc_id").where(toxicity.held_out("doc_id") & F.col("toxic_threshold").isNotNull())
    tally = out.select((F.col("toxic_score") >= 0.5).cast("int").alias("p"), marks["toxic"].alias("y")).where("y is not null").collect()
    assert len(tally) > 100 and sum(r["p"] == r["y"] for r in tally) / len(tally) > 0.95
    assert {r["lang"] for r in limits.where("not overall").collect()} <= {"en", "fr"} and limits.where("overall").count() == 1


def test_threshold_is_the_best_of_each_language(spark):
    rng = random.Random(3)
    rows = [(lang, float(y), min(0.999, max(0.0, rng.gauss(mid + 0.3 * y, 0.1)))) for lang, mid in (("en", 0.2), ("de", 0.5), (None, 0.35)) for y in (0, 1) for _ in range(150)]
    rows += [("rare", 1.0, 0.9)] * 3
    got = {(r["lang"], r["overall"]): r["threshold"] for r in toxicity.thresholds(spark.createDataFrame(rows, "lang string, label double, toxic_score double")).collect()}
    assert set(got) == {("en", False), ("de", False), (None, False), (None, True)}

    def f1(part, t):
        hit = sum(y for _, y, s in part if s >= t)
        return 2 * hit / (sum(s >= t for *_, s in part) + sum(y for _, y, _ in part))

    for (lang, overall), t in got.items():
        part = [r for r in rows if overall or r[0] == lang]
        assert abs(f1(part, t) - max(f1(part, k / 200) for k in range(200))) < 1e-9


def test_the_language_never_moves_a_score(spark):
    rows, _ = labelled_rows(60, 4)
    model = fitted([r[1] for r in rows], np.array([i % 2 for i in range(60)], np.float32), epochs=2)
    a = toxicity.scored(spark.createDataFrame(rows, SCHEMA), model).select("doc_id", "toxic_score")
    b = toxicity.scored(spark.createDataFrame([(i, t, "xx", "other") for i, t, *_ in rows], SCHEMA), model).select("doc_id", "toxic_score")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_awkward_rows(spark):
    rows = [(1, None, None, None), (1, None, None, None), (None, "x", "en", "s"), (2, "", "en", "s"), (3, "ä " * 300_000, "en", "s"), (4, "..", "en", "s")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("toxic_score", F.lit("mine")).withColumn("_lang", F.lit("kept"))
    marks = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (9, 1), (3, 0)], "doc_id long, toxic int")
    model, limits = toxicity.calibrated(docs, marks)
    out = toxicity.flagged(docs, model, limits).collect()
    assert len(out) == 6 and all(0 <= r["toxic_score"] <= 1 and r["toxic"] in (0, 1) for r in out)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model, limits = toxicity.calibrated(docs, none)
    assert len({r["toxic_score"] for r in toxicity.flagged(docs, model, limits).collect()}) == 1
    empty = spark.createDataFrame([], SCHEMA)
    assert toxicity.flagged(empty, *toxicity.calibrated(empty, marks)).count() == 0


def test_query_over_the_whole_table(spark, data):
    out = toxicity.op13_toxicity(spark, data)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert FILTERS * len(WIDTHS) == len(Cnn().weights["out"])
