"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A text is lower-cased, ASCII punctuation counts as spaces.  A word's vector is the sum of the
vectors at the hashed places of the word and of its first STEMS bytes, so that words that were
never seen share what their stems have learnt.  Filters of the WIDTHS run over the vectors of a
text's words; of each filter the greatest value over the whole text counts (max pooling), and a
logistic unit over those gives the score.  A text is read in one piece, however long; a window
that runs over its end meets zeros.

Training takes labelled rows with crc32(doc_id as text) mod 5 <> 0: of these the remainder
CALIBRATION is left for the thresholds, of the others at most about MAX_TRAIN rows and TRAIN_BYTES
of text are taken by a hash of doc_id (a documented bound), in one task, by stochastic gradients
with Adagrad.  The model has a fixed size and is all that passes through the driver.

Thresholds by language: scored calibration rows are counted by language and score in BINS bins;
a language's threshold is the one of best F1, and languages with fewer than LEAST_TOXIC toxic rows
take the one over all languages.  The language never enters a score: it only picks the threshold
of ``flagged``.

Null and empty texts get the score of a text without words; labels that are null are left out; a
document may have several labels (each counts); a null doc_id is never held out; null languages are
a language; rows that repeat give a row each.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, slices, written
from .words import byte_hashes, mix, split_words

HASH_BITS, DIM, FILTERS = 15, 16, 12
WIDTHS = (1, 2, 3, 5)
#: Bytes of a word's beginning that have vectors of their own.
STEMS = (4, 5, 6, 7)
MAX_TRAIN, TRAIN_BYTES = 12_000, 32 << 20
#: Longer texts are scored but not learnt from.
LONGEST = 1 << 20
#: Characters that are read at a time.
PIECE = 1 << 19
BATCH, RATE = 32, 0.08
#: Rows that training visits, over 6 to 30 epochs.
VISITS = 40_000
#: Share of the distinct words that a step leaves out of all its texts, so that each word must tell by itself.
DROPPED = 0.5
CALIBRATION, BINS, LEAST_TOXIC = 1, 200, 20
THRESHOLD = 0.5


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of each distinct word, number of the distinct word of each word, index of each text's first word)."""
    w = split_words(texts, plain=True)
    hashes, at, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
    start, end = w.start[at], w.end[at]
    parts = [mix(hashes)] + [mix(byte_hashes(w.buf, start, np.minimum(end, start + k)) + np.uint64(k)) for k in STEMS]
    places = np.stack([(p >> np.uint64(64 - HASH_BITS)).astype(np.int32) for p in parts], axis=1)
    # A word as short as a stem has no stem of that length.
    short = np.stack([np.zeros(len(at), bool)] + [end - start <= k for k in STEMS], axis=1)
    places[short] = 1 << HASH_BITS
    return places, inverse, w.first


class Cnn:
    """Weights of the classifier; place 1 << HASH_BITS of the vectors stays zero."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.weights = {
            "vectors": np.vstack([rng.normal(0, 0.1, (1 << HASH_BITS, DIM)), np.zeros((1, DIM))]).astype(np.float32),
            **{f"filter{w}": rng.normal(0, (w * DIM) ** -0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS},
            "shift": np.zeros(n, np.float32), "out": rng.normal(0, 0.3, n).astype(np.float32), "bias": np.full(1, -1.0, np.float32),
        }

    def stream(self, places, inverse, first) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(vectors of all texts' words with zeros behind each text, row of each word, first row and end of each text)."""
        counts = np.diff(first)
        room = np.maximum(counts, 1) + max(WIDTHS) - 1
        start = np.concatenate([[0], np.cumsum(room)])
        at = np.arange(len(inverse)) + np.repeat(start[:-1] - first[:-1], counts)
        x = np.zeros((start[-1], DIM), np.float32)
        x[at] = self.weights["vectors"][places].sum(axis=1)[inverse]
        return x, at, start[:-1], start[:-1] + np.maximum(counts, 1)

    def convolved(self, x: np.ndarray) -> np.ndarray:
        """Values of all filters at each row that has room for the widest."""
        n = len(x) - max(WIDTHS) + 1
        return np.concatenate([sum(x[j : n + j] @ self.weights[f"filter{w}"][j] for j in range(w)) for w in WIDTHS], axis=1)

    def pooled(self, x, start, end) -> np.ndarray:
        """The greatest value of each filter in each text, rectified."""
        edges = np.stack([start, end], axis=1).ravel()
        values = np.vstack([self.convolved(x), np.zeros((1, FILTERS * len(WIDTHS)), np.float32)])  # so that each end is a row
        return np.maximum(np.maximum.reduceat(values, edges, axis=0)[::2] + self.weights["shift"], 0)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The score of each text.  Texts are read in pieces of about PIECE characters: their greatest values are those of the text."""
        h = np.zeros((len(texts), FILTERS * len(WIDTHS)), np.float32)
        for group in _groups(texts):
            x, _, start, end = self.stream(*features(pa.array([p[1] for p in group], pa.string())))
            end = np.maximum(end - np.array([0 if p[2] else max(WIDTHS) - 1 for p in group]), start + 1)
            np.maximum.at(h, [p[0] for p in group], self.pooled(x, start, end))
        return _logistic(h @ self.weights["out"] + self.weights["bias"][0])


_SPACE = re.compile(r"[\x20\x09-\x0D]")


def _pieces(text: str) -> Iterator[tuple[str, bool]]:
    """(piece, whether it is the last): cut at spaces; each piece begins with the words whose windows the one before it leaves out."""
    a, carried, left_out = 0, "", max(WIDTHS) - 1
    while len(text) - a > PIECE and (cut := _SPACE.search(text, a + PIECE)):
        piece, a = f"{carried} {text[a : cut.start()]}", cut.start()
        w = split_words(pa.array([piece]), plain=True)
        carried = " ".join(bytes(w.buf[i:j]).decode() for i, j in zip(w.start[-left_out:], w.end[-left_out:]))
        if len(w.hashes) > left_out:
            yield piece, False
    yield f"{carried} {text[a:]}", True


def _groups(texts: pa.Array) -> Iterator[list[tuple[int, str, bool]]]:
    """Pieces (text number, piece, last) of all texts in groups of about PIECE characters."""
    group, size = [], 0
    for i, text in enumerate(texts.to_pylist()):
        for piece, last in _pieces(text or ""):
            if group and size + len(piece) > PIECE:
                yield group
                group, size = [], 0
            group.append((i, piece, last))
            size += len(piece)
    if group:
        yield group


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z.astype(float), -30, 30)))


class Trainer:
    """Adagrad on the logistic loss; only the windows that the pooling chose carry gradients."""

    def __init__(self, model: Cnn, seed: int = 0):
        self.rng = np.random.default_rng(seed)
        self.model, self.seen = model, {k: np.full_like(v, 1e-2) for k, v in model.weights.items()}

    def step(self, name: str, g: np.ndarray, rows=slice(None)) -> None:
        seen = self.seen[name]
        seen[rows] += g * g
        self.model.weights[name][rows] -= RATE * g / np.sqrt(seen[rows])

    def learn(self, places, inverse, first, y: np.ndarray) -> None:
        m, wt = self.model, self.model.weights
        x, at, start, end = m.stream(places, inverse, first)
        kept = (self.rng.random(len(places)) >= DROPPED)[inverse]
        x[at[~kept]] = 0
        values = m.convolved(x)
        chosen = np.stack([a + values[a:b].argmax(axis=0) for a, b in zip(start, end)])  # texts x filters: rows
        h = np.take_along_axis(values, chosen, axis=0) + wt["shift"]
        live = h > 0
        h = np.where(live, h, 0)
        d = ((_logistic(h @ wt["out"] + wt["bias"][0]) - y) / len(y)).astype(np.float32)
        dh = np.where(live, d[:, None] * wt["out"], 0)
        dx = np.zeros_like(x)
        steps = {"out": d @ h, "bias": d.sum(keepdims=True), "shift": dh.sum(axis=0)}
        for k, w in enumerate(WIDTHS):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            rows, grads = chosen[:, own], dh[:, own]
            g = np.zeros_like(wt[f"filter{w}"])
            for j in range(w):
                g[j] = np.einsum("tfd,tf->df", x[rows + j], grads)
                np.add.at(dx, (rows + j).ravel(), (wt[f"filter{w}"][j].T[None] * grads[:, :, None]).reshape(-1, DIM))
            steps[f"filter{w}"] = g
        for name, g in steps.items():
            self.step(name, g)
        by_word = np.zeros((len(places), DIM), np.float32)
        np.add.at(by_word, inverse[kept], dx[at[kept]])
        moved = np.flatnonzero(np.abs(by_word).sum(axis=1))
        if len(moved):
            rows, back = np.unique(places[moved].ravel(), return_inverse=True)
            g = np.zeros((len(rows), DIM), np.float32)
            np.add.at(g, back, np.repeat(by_word[moved], places.shape[1], axis=0))
            real = rows < 1 << HASH_BITS
            self.step("vectors", g[real], rows[real])


def fitted(texts: list, labels: np.ndarray, epochs: int | None = None, seed: int = 0) -> Cnn:
    """A model fitted to texts and labels (0 or 1), visited in an order that the seed draws."""
    epochs = epochs or max(6, min(30, VISITS // max(1, len(texts))))
    model = Cnn(seed)
    if not len(texts):
        model.weights["out"][:] = 0
    trainer, rng = Trainer(model, seed + 2), np.random.default_rng(seed + 1)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            at = order[a : a + BATCH]
            trainer.learn(*features(pa.array([texts[i] for i in at], pa.string())), labels[at])
    return model


def _fifth(doc_id: str) -> F.Column:
    """crc32 of the doc_id as text, modulo 5; 2 where it is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5, F.lit(2))


def held_out(doc_id: str) -> F.Column:
    return _fifth(doc_id) == 0


def labelled(docs: DataFrame, labels: DataFrame, which: F.Column) -> DataFrame:
    """(doc_id, lang, text, label) of the rows with a label for which ``which`` holds; ids meet as text."""
    chosen = labels.where("toxic is not null and doc_id is not null").where(which).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("toxic").cast("double").alias("label"))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), lang.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(chosen, "doc_id")


def _million(*parts) -> F.Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1_000_000))


def train_on(docs: DataFrame, labels: DataFrame) -> Cnn:
    """A model fitted to the sample that the module's text describes."""
    able = ~_fifth("doc_id").isin(0, CALIBRATION)
    share = min(1.0, MAX_TRAIN / max(labels.where("toxic is not null and doc_id is not null").where(able).count(), 1))
    drawn = able & (_million(F.col("doc_id").cast("string"), F.lit(29)) < int(1_000_000 * share))
    sample = written(labelled(docs, labels, drawn).where(F.octet_length("text") <= LONGEST).select("doc_id", "text", "label"), "toxicity-sample")
    size = sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sample = sample.where(_million("doc_id", F.lit(31)) < int(1_000_000 * min(1.0, TRAIN_BYTES / max(size, 1))))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "text", "label"])
        out = io.BytesIO()
        np.savez_compressed(out, **fitted(part["text"].tolist(), part["label"].to_numpy(np.float32)).weights)
        return pd.DataFrame({"weights": [out.getvalue()]})

    model = fitted([], np.empty(0, np.float32))
    for row in sample.groupBy().applyInPandas(fit, "weights binary").collect():  # one row of fixed size
        with np.load(io.BytesIO(row[0])) as weights:
            model.weights = {k: weights[k] for k in weights.files}
    return model


def scored(docs: DataFrame, model: Cnn) -> DataFrame:
    """The documents' own columns and ``toxic_score``; a column of that name is replaced."""
    docs = docs.drop("toxic_score")
    held = docs.sparkSession.sparkContext.broadcast(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Cnn.__new__(Cnn)
        own.weights = held.value
        for b in slices(batches, "text", PIECE):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.scores(b["text"].cast(pa.string())))], names=[*b.schema.names, "toxic_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType())]))


def thresholds(rows: DataFrame) -> DataFrame:
    """(lang, threshold) from rows (lang, label, toxic_score); the row over all languages has ``overall`` true.

    Rows are counted by bin of the score first, so a language's curve has BINS points whatever its size.
    """
    bins = rows.groupBy("lang", F.least(F.floor(F.col("toxic_score") * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.sum((F.col("label") > 0).cast("long")).alias("hits"), F.count("*").alias("n"))
    every = bins.groupBy("bin").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    both = bins.withColumn("overall", F.lit(False)).unionByName(every.select(F.lit(None).cast("string").alias("lang"), "bin", "hits", "n", F.lit(True).alias("overall")))
    above = Window.partitionBy("overall", "lang").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("overall", "lang")
    curve = both.select("overall", "lang", "bin", F.sum("hits").over(whole).alias("toxic"), (2 * F.sum("hits").over(above) / (F.sum("n").over(above) + F.sum("hits").over(whole))).alias("f1"))
    middle = -F.abs(F.col("bin") / BINS - THRESHOLD)
    best = curve.groupBy("overall", "lang").agg(F.max("toxic").alias("toxic"), F.max_by("bin", F.struct("f1", middle.alias("m"), "bin")).alias("bin"))
    return best.where(F.col("toxic") >= F.when(F.col("overall"), 1).otherwise(LEAST_TOXIC)).select("lang", "overall", (F.col("bin") / BINS).alias("threshold"))


def flagged(docs: DataFrame, model: Cnn, limits: DataFrame) -> DataFrame:
    """``scored`` with ``toxic_threshold``, the language's or else the one over all, and ``toxic`` (0 or 1) by it."""
    limits = written(limits, "toxicity-thresholds")
    overall = limits.where("overall").select("threshold").collect()  # one row
    rows = scored(docs.drop("toxic_threshold", "toxic"), model)
    lang = F.col("d.lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    joined = rows.alias("d").join(limits.where("not overall").alias("l"), lang.eqNullSafe(F.col("l.lang")), "left")
    out = joined.select("d.*", F.coalesce("l.threshold", F.lit(overall[0][0] if overall else THRESHOLD)).alias("toxic_threshold"))
    return out.withColumn("toxic", (F.col("toxic_score") >= F.col("toxic_threshold")).cast("int"))


def calibrated(docs: DataFrame, labels: DataFrame) -> tuple[Cnn, DataFrame]:
    """A model and its thresholds by language."""
    model = train_on(docs, labels)
    return model, thresholds(scored(labelled(docs, labels, _fifth("doc_id") == CALIBRATION), model))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = flagged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang"), *calibrated(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"), F.col("toxic_threshold").alias("lang_threshold"), F.col("toxic").alias("flagged"))
