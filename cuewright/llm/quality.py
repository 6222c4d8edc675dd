"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL-proximal.

Features are n-grams of words and of word shapes, hashed into 2**HASH_BITS places.  A shape
keeps punctuation, maps letters and digits to classes and collapses runs; a word equal to
the one before it has the shape "again".  A feature's value is its count over the number of
words, so a text's score is the sum of its n-grams' weights over its length: a sparse dot
product that one pass over the Arrow buffer gives.

Training takes labelled rows with crc32(doc_id as text) mod 5 <> 0, MAX_TRAIN of them about
(chosen by a hash of doc_id; a documented bound), in up to SHARDS groups of 1,000 or more.  Each group runs FTRL on
its own; the weights are averaged.  The weights, 2**HASH_BITS at most, are the only thing
that passes through the driver.

Null and empty texts get the score of the bias; labels that are null are left out; a
document may have several labels (each counts); a null doc_id is never held out; ids of labels and
documents meet as text, whatever their types.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, slices
from .words import _IS_SPACE, mix, run_hashes, split_words

HASH_BITS = 18
MAX_TRAIN = 20_000
SHARDS = 8
#: Rows that each group visits, over 4 to 30 epochs.
VISITS = 10_000
THRESHOLD = 0.3

#: Byte classes of word shapes: letters (with all bytes beyond ASCII) and digits are one class each.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58] = ord("0")
_SHAPE[65:91] = ord("a")
_SHAPE[97:123] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[_IS_SPACE] = 0x20


def ngram_places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each n-gram, text number of each n-gram, words of each text)."""
    w = split_words(texts)
    counts = w.counts()
    total = len(w.hashes)
    if not total:
        return np.empty(0, np.int64), np.empty(0, np.int64), counts
    text = np.repeat(np.arange(len(counts)), counts)
    # Collapse runs of equal classes inside each word; word borders stay as they are.
    kinds = _SHAPE[w.buf]
    inside = np.zeros(len(w.buf) + 1, np.int8)
    inside[w.start] += 1
    np.add.at(inside, w.end, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    first = np.zeros(len(w.buf), bool)
    first[w.start] = True
    keep = inside & (first | np.append(True, kinds[1:] != kinds[:-1]))
    code = mix(kinds[keep].astype(np.uint64) + np.uint64(7))
    at = np.concatenate([[0], np.cumsum(keep)])
    lo, hi = at[w.start], at[w.end]
    rank = np.arange(len(code)) - np.repeat(lo, hi - lo)
    shapes = mix(np.add.reduceat(mix(code + rank.astype(np.uint64)), lo))
    again = np.append(False, (w.hashes[1:] == w.hashes[:-1]) & (text[1:] == text[:-1]))
    shapes[again] = np.uint64(1)
    places, owners = [], []
    for salt, (hashes, sizes) in enumerate(((w.hashes, (1, 2)), (shapes, (1, 2, 3)))):
        for n in sizes:
            if total >= n:
                whole = np.flatnonzero(text[n - 1 :] == text[: total - n + 1])
                places.append((mix(run_hashes(hashes, n)[whole] + np.uint64(101 * salt + n)) >> np.uint64(64 - HASH_BITS)).astype(np.int64))
                owners.append(text[whole])
    return np.concatenate(places), np.concatenate(owners), counts


class Ftrl:
    """FTRL-proximal with L1 and L2 terms; one weight for each place and a bias at the end."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30)))
        g = (p - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(labelled: DataFrame) -> np.ndarray:
    """Weights from rows (doc_id, text, label); see the module's text for the bound and the averaging."""
    size = 1 << HASH_BITS
    count = labelled.count()
    share = min(1.0, MAX_TRAIN / max(count, 1))
    million = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    shards = max(1, min(SHARDS, int(count * share) // 1000))
    sample = labelled.where(million < int(1_000_000 * share)).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(shards)).cast("int"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "text", "label"]).reset_index(drop=True)
        order = np.random.default_rng(len(part)).permutation(len(part))
        rows = []
        for text in part["text"]:
            places, _, counts = ngram_places(pa.array([text], pa.string()))
            at, n = np.unique(places, return_counts=True)
            rows.append((np.append(at, size).astype(np.int32), np.append(n / max(1, int(counts[0])), 1.0).astype(np.float32)))
        model = Ftrl(size)
        y = part["label"].to_numpy(float)
        for _ in range(max(4, min(30, VISITS // max(1, len(rows))))):
            for i in order.tolist():
                model.learn(*rows[i], y[i])
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        return pd.DataFrame({"place": at, "weight": w[at]})

    fitted = sample.groupBy("shard").applyInPandas(fit, "place long, weight double")
    out = np.zeros(size + 1)
    for row in fitted.groupBy("place").agg((F.sum("weight") / shards).alias("weight")).toLocalIterator():
        out[row[0]] = row[1]
    return out


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The documents' own columns and ``quality_score``; a column of that name is replaced."""
    docs = docs.drop("quality_score")
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for b in slices(batches, "text", 1 << 20):
            places, owner, counts = ngram_places(b["text"].cast(pa.string()))
            sums = np.bincount(owner, weights=w[places], minlength=b.num_rows) if len(places) else np.zeros(b.num_rows)
            score = 1.0 / (1.0 + np.exp(-np.clip(w[-1] + sums / np.maximum(counts, 1), -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, "quality_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())]))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_on(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights from the labelled rows that are not held out; the join moves ids and the texts of labelled rows only."""
    chosen = labels.where("quality is not null and doc_id is not null").where(~held_out("doc_id")).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("quality").cast("double").alias("label"))
    share = MAX_TRAIN / max(chosen.count(), 1)
    if share < 1:
        chosen = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * share))
    # MAX_TRAIN bounds the number of ids, so that the documents need no shuffle.
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return train(texts.join(F.broadcast(chosen), "doc_id"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    weights = train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), weights)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
