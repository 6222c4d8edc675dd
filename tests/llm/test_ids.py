"""Ids of any type, ids that repeat and ids that are null, in the operators that drop or link rows."""

import random

import pytest
from pyspark.sql import functions as F

from cuewright.llm import decontaminate, jaccard, quality, simple8b, substring

from .test_llm import prose

SCHEMA = "doc_id {}, text string, lang string, source string, n_chars long"


def table(spark, kind, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA.format(kind))


@pytest.fixture(scope="module")
def leaked(spark):
    rng = random.Random(3)
    passage = prose(rng, 40)
    return passage, f"{prose(rng, 30)} {passage} {prose(rng, 20)}", spark.createDataFrame([(1, passage)], "item_id long, text string")


def test_leaks_go_by_row_and_not_by_id(spark, leaked):
    _, text, benchmark = leaked
    rows = [(5, text), (5, "clean words here"), (6, "other clean words"), (None, text), (None, "clean without a number"), (7, None)]
    docs = table(spark, "long", rows).withColumn("text_key", F.lit("mine"))
    out = decontaminate.without_leaks(docs, benchmark)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["text_key"]) for r in out.collect()) == sorted((i or 0, t or "", "mine") for i, t in rows if t != text)


@pytest.mark.parametrize("kind,name", [("string", lambda i: f"doc-{i}"), ("int", lambda i: i)])
def test_ids_keep_their_type(spark, leaked, kind, name):
    _, text, benchmark = leaked
    rng = random.Random(4)
    base = prose(rng, 60)
    docs = table(spark, kind, [(name(1), text), (name(2), base), (name(3), base), (name(4), prose(rng, 60))])
    assert [r["doc_id"] for r in decontaminate.leaks(docs, benchmark).collect()] == [name(1)]
    assert {r["doc_id"] for r in decontaminate.without_leaks(docs, benchmark).collect()} == {name(2), name(3), name(4)}
    groups = {r["doc_id"]: r["component_id"] for r in jaccard.near_groups(docs).collect()}
    assert groups == {name(1): name(1), name(2): name(2), name(3): name(2), name(4): name(4)}
    assert {r["doc_id"] for r in jaccard.keep_one(docs).collect()} == {name(1), name(2), name(4)}
    removed = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(docs).collect()}
    assert removed == {name(1): 0, name(2): 60, name(3): 60, name(4): 0}
    marks = spark.createDataFrame([(name(i), i % 2) for i in range(1, 5)], f"doc_id {kind}, quality int")
    scored = quality.scored(docs, quality.train_on(docs, marks))
    assert {r["doc_id"] for r in scored.collect()} == {name(i) for i in range(1, 5)}


def test_a_column_named_like_the_key_stays(spark):
    docs = table(spark, "long", [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (3, "f g h i j")]).withColumn("_key_of_text", F.lit("mine"))
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["_key_of_text"]) for r in out.collect()) == [(1, "mine"), (3, "mine")]


def test_the_token_file_refuses_other_ids(spark, tmp_path):
    with pytest.raises(TypeError, match="number the rows first"):
        simple8b.write_tokens(table(spark, "string", [("a", "x")]), str(tmp_path / "t"), "unused.json")
