"""Entropy spans in a column of their own, covered ones included, and the number of suppressed candidates."""

from cuewright.llm import secrets

KEY = "q7Zk2LmX9pR4vT1wB8nS"


def test_covered_spans_and_suppressed_candidates(spark):
    texts = [f"token = {KEY}Yd3 and then {KEY}", "example-0123456789abcdef01 2024-01-01/2024-01-01-00", "nothing here", None]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    first = got[0]
    assert [tuple(x) for x in first.assign] == [(0, 0, 31)]
    assert [tuple(x) for x in first.windows] == [(8, 3, 31), (41, 3, 61)] and [tuple(x) for x in first.entropy] == [(41, 3, 61)]
    assert got[1].suppressed >= 1 and not got[1].windows
    assert not got[2].windows and got[2].suppressed == got[3].suppressed == 0
