"""Queries on texts and episodes that are longer than those of the smallest tables."""

import random

import pytest

from cuewright import registry


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.fixture
def said(spark, tmp_path):
    def write(turns):
        spark.createDataFrame([(1, k, "user", x) for k, x in enumerate(turns)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
        return str(tmp_path)

    return write


def test_edit_distance_of_whole_texts(spark, said):
    rng = random.Random(1)
    long = "".join(rng.choice("abc é") for _ in range(400))
    turns = ["naïve café", "naive cafe", "مرحبا بكم", "مرحبا بهم", "x" + long + "y", "x" + long + "end", ""]
    got = {r.unit_id: r.distance for r in registry.queries()["edit_distance_chars"](spark, said(turns)).collect()}
    assert got == {k: distance(a, b) for k, (a, b) in enumerate(zip(turns, [*turns[1:], ""]))}


def test_windows_to_the_end_of_an_episode(spark, said):
    path = said(["x" * 200] * 400)  # 7.2 s a line
    rows = registry.queries()["eval_windows"](spark, path).collect()
    assert max(r.window_ms for r in rows) > 2_500_000


def test_speaker_split_of_every_unit(spark, said):
    got = registry.queries()["speaker_split"](spark, said(["one two three four five six"] * 4)).collect()
    assert sorted(r.unit_id for r in got) == [0, 1, 2, 3]


def test_fingerprint_of_the_middle(spark, tmp_path):
    texts = ["a" * 5000 + x + "b" * 5000 for x in ("one", "two", "one")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.copies for r in registry.queries()["input_fingerprint"](spark, str(tmp_path)).collect()}
    assert got == {0: 2, 1: 1, 2: 2}


def test_eight_samples_a_voice(spark, said):
    rows = registry.queries()["speaker_samples"](spark, said([f"line {k}" for k in range(10)])).collect()
    assert [len(r.samples.split("|")) for r in rows] == [8]
