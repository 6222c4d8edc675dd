"""Spelling variants against brute force on random vocabularies and texts."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuewright.llm import spelling

from ..compare import connect, same

SCHEMA = "doc_id long, text string, lang string"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    out = {}
    for w, n in counts.items():
        around = [x for x in counts if near(w, x)]
        best = min(around, key=lambda x: (-counts[x], x), default=None)
        keeps = best is not None and counts[best] >= 2 * n
        out[w] = (best if keeps else None, n, len(around), counts[best] if keeps else None)
    rows = []
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, k, m))
    return sorted(rows)


def words_of(rows):
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


@pytest.mark.parametrize("width", [1, 2, 3, 5])
@pytest.mark.parametrize("last", [True, False])
def test_near_sets(width, last):
    rng = random.Random(width)
    rests = list({"".join(rng.choice("abc") for _ in range(width + rng.randrange(2))) for _ in range(200)})
    for rest, found in zip(rests, spelling.near_sets(rests, width, last)):
        want = set()
        for x in rests:
            a, b = sorted((rest, x), key=len)
            if near(rest, x) and len(a) == width and (last or len(a) == len(b) or b[:-1] != a):
                want.add(x)
        assert {x for i, x in enumerate(rests) if found >> i & 1} == want


@pytest.mark.parametrize("bucket", [2048, 8, 1])
def test_near_words_meet_once_at_any_bucket_size(spark, monkeypatch, bucket):
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    rng = random.Random(bucket)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randrange(5, 10))): rng.randrange(3, 60) for _ in range(400)}
    counts |= {"a" * n: 7 for n in range(5, 14)} | {"b" * 300: 5, "b" * 299: 50}
    got = spelling.near_words(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {r["word"]: (r["n_near"], r["near"], r["near_n"]) for r in got} == {
        w: (len(a), b := min(a, key=lambda x: (-counts[x], x)), counts[b]) for w in counts if (a := [x for x in counts if near(w, x)])
    }


def test_forms_and_roots_of_texts(spark):
    rng = random.Random(9)
    bases = ["there", "WHERE", "thread", "straße", "×÷×÷×", "naïve", "Ünder", "kitten", "sitting"]

    def typo(w):
        i = rng.randrange(len(w))
        return rng.choice([w, w, w, w, w[:i] + w[i + 1 :], w[:i] + rng.choice("xyé") + w[i:], w[:i] + rng.choice("xyé") + w[i + 1 :]])

    rows = [(rng.choice([None, i, 7]), rng.choice(["", " ", "-", "\n"]).join(typo(rng.choice(bases)) + " " for _ in range(60)), "en") for i in range(60)]
    rows += [(500, None, "en"), (501, "", None), (502, "ab1cd 5", "en"), (503, "z" * 20000 + " " + "z" * 20000 + " " + "z" * 20000 + " z" + "z" * 20000, "de")] + rows[:9]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("word", F.lit("mine")).withColumn("n", F.lit("mine"))
    got = [tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert sorted(got) == brute(words_of(rows))


def test_long_chains_of_forms(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w0"), ("y", "z")]
    got = dict(spelling.roots(spark.createDataFrame(links, "word string, form string")).collect())
    assert got == {**{f"w{i}": "w37" for i in range(37)}, "x": "w37", "y": "z"}


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_matches_sql(spark, data):
    same(spelling.op12_spelling(spark, data), connect(data), spelling.ORACLE_SQL)
