"""Reply cache and report history over repeated, failing and interrupted runs."""

import pytest
from pyspark.sql import functions as F

from cuewright.operators import published


def asking(fail=()):
    def ask(payloads):
        return [None if p in fail else p.upper() for p in payloads]

    return ask


def never(payloads):
    raise AssertionError(f"asked again: {payloads}")


def test_a_second_run_asks_nothing(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    rows = spark.createDataFrame([(i, f"p{i % 5}" if i % 7 else None) for i in range(30)], "id long, payload string").withColumn("key", F.lit("mine"))
    asked = spark.sparkContext.accumulator(0)

    def ask(payloads):
        asked.add(len(payloads))
        return [(p or "nothing").upper() for p in payloads]

    first = {r["id"]: r["reply"] for r in published.with_replies(rows, cache, ask, batch=2).collect()}
    assert first == {i: f"P{i % 5}" if i % 7 else "NOTHING" for i in range(30)}
    assert asked.value == 6
    again = published.with_replies(rows, cache, never)
    assert again.columns == ["id", "payload", "key", "reply"] and {r["id"]: r["reply"] for r in again.collect()} == first
    more = rows.unionByName(spark.createDataFrame([(99, "new", "x")], "id long, payload string, key string"))
    assert {r["id"]: r["reply"] for r in published.with_replies(more, cache, ask).collect()}[99] == "NEW"
    assert asked.value == 7


def test_failures_are_asked_again(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("b",)], "payload string")
    got = {r["payload"]: r["reply"] for r in published.with_replies(rows, str(tmp_path / "c"), asking(fail=["b"])).collect()}
    assert got == {"a": "A", "b": None}

    def only_b(payloads):
        assert payloads == ["b"]
        return ["B"]

    assert {r["reply"] for r in published.with_replies(rows, str(tmp_path / "c"), only_b).collect()} == {"A", "B"}


def test_a_batch_of_wrong_length_is_asked_one_by_one(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{i}",) for i in range(9)], "payload string").coalesce(1)
    got = published.with_replies(rows, str(tmp_path / "c"), lambda ps: [ps[0].upper()], tasks=1)
    assert {r["payload"]: r["reply"] for r in got.collect()} == {f"p{i}": f"P{i}" for i in range(9)}


def test_keys_tell_parts_apart(spark):
    row = spark.createDataFrame([("a", "b", "ab", None)], "x string, y string, z string, n string")
    keys = row.select(published.request_key("x", "y"), published.request_key("z", F.lit("")), published.request_key("x", "n"), published.request_key("n", "x"), published.request_key("x", F.lit(""))).first()
    assert len(set(keys)) == 5


def test_a_report_counts_once(spark, tmp_path):
    history = f"file://{tmp_path}/history"
    assert published.report_history(spark, history).count() == 0
    summary = spark.createDataFrame([("lines", 3), ("chars", None)], "metric string, value int")
    assert published.append_report(summary, history, "2024-05-01")
    assert not published.append_report(summary.withColumn("value", F.lit(9)), history, "2024-05-01")
    assert published.append_report(summary, history, "2024-05-02")
    assert sorted(map(tuple, published.report_history(spark, history).collect()), key=str) == sorted([(d, m, v) for d in ("2024-05-01", "2024-05-02") for m, v in (("lines", 3.0), ("chars", None))], key=str)
    with pytest.raises(ValueError):
        published.append_report(summary, history, "a/b")


def test_a_run_that_breaks_off_shows_nothing(spark, tmp_path):
    history = f"file://{tmp_path}/history"

    @F.udf("double")
    def bad(x):
        raise ValueError("dies")

    summary = spark.createDataFrame([("lines", 3.0)], "metric string, value double")
    with pytest.raises(Exception, match="dies"):
        published.append_report(summary.withColumn("value", bad("value")), history, "r1")
    assert published.report_history(spark, history).count() == 0
    assert published.append_report(summary, history, "r1")
