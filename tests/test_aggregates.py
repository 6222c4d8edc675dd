"""Aggregates of evaluation in groups and over windows, against counts one by one."""

import random
import tracemalloc
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cuewright.functions import grams
from cuewright.operators import evaluation


def plain(x, y, order):
    out = []
    for n in range(1, order + 1):
        a, b = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (x, y))
        out += [sum((a & b).values()), sum(b.values()), sum(a.values())]
    return out


@pytest.mark.parametrize("order", [1, 2, 6])
def test_gram_counts(order):
    rng = random.Random(order)
    texts = ["".join(rng.choice("abé😀\ud800") for _ in range(rng.choice([0, 1, 3, 40]))) for _ in range(80)]
    refs, hyps = texts[:40], texts[40:]
    assert grams.gram_counts(refs, hyps, order).tolist() == [plain(x, y, order) for x, y in zip(refs, hyps)]
    assert grams.gram_counts(["", ""], ["", ""], order).tolist() == [[0] * 3 * order] * 2


def test_passes_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab c") for _ in range(30)) if i % 5 else None, "".join(rng.choice("ab c") for _ in range(30)) if i % 7 else "") for i in range(40)]
    squeezed = [(k, "".join((x or "").split()), "".join(y.split())) for k, x, y in rows]
    assert sum((list(range(40))[c] for c in grams._passes([grams.PASS // 3] * 40)), []) == list(range(40))
    df = spark.createDataFrame(rows, "k long, ref string, hyp string")
    got = {r["k"]: r["c"] for r in df.select("k", grams.chrf_counts(F.col("ref"), F.col("hyp"), 3).alias("c")).collect()}
    assert got == {k: plain(x, y, 3) for k, x, y in squeezed}


def score(parts, beta=2.0):
    used = [(m / h, m / r) for m, h, r in zip(parts[::3], parts[1::3], parts[2::3]) if h and r]
    if not used:
        return 0.0
    p, r = (sum(x) / len(used) for x in zip(*used))
    return 100 * (1 + beta**2) * p * r / (beta**2 * p + r) if p + r else 0.0


def test_groups_and_windows(spark):
    rng = random.Random(6)
    rows = [(i % 3, i, "".join(rng.choice("abcd") for _ in range(12)), "".join(rng.choice("abcd") for _ in range(12)), rng.random() < 0.4) for i in range(30)]
    df = spark.createDataFrame(rows, "g long, i long, ref string, hyp string, hit boolean").withColumn("c", grams.chrf_counts(F.col("ref"), F.col("hyp")))
    total = lambda part: score([sum(x) for x in zip(*(plain(r[2], r[3], 6) for r in part))])
    for r in df.groupBy("g").agg(evaluation.chrf_agg(F.col("c")).alias("chrf"), evaluation.wilson_agg(F.col("hit")).alias("w")).collect():
        part = [x for x in rows if x[0] == r["g"]]
        assert abs(r["chrf"] - total(part)) < 0.0051 and r["w"]["rate"] == round(sum(x[4] for x in part) / len(part), 4)
    w = Window.partitionBy("g").orderBy("i").rowsBetween(-2, 0)
    for r in df.select("g", "i", evaluation.chrf_agg(F.col("c"), over=w).alias("chrf"), evaluation.wilson_agg(F.col("hit"), over=w).alias("w")).collect():
        part = [x for x in rows if x[0] == r["g"] and x[1] <= r["i"]][-3:]
        assert abs(r["chrf"] - total(part)) < 0.0051 and r["w"]["rate"] == round(sum(x[4] for x in part) / len(part), 4)


def test_memory_of_a_batch_is_bounded():
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefghij", k=500)) for _ in range(4000)]
    tracemalloc.start()
    for cut in grams._passes([1000] * 4000):
        grams.gram_counts(texts[cut], texts[cut], 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
