"""Replies and confidences on long and awkward values."""

import json

from pyspark.sql import functions as F

from cuewright.functions.replies import reply_items
from cuewright.operators.selection import segment_confidence


def test_a_broken_reply_of_a_megabyte(spark):
    long = 'a\\"é ' * 250_000
    items = [{"id": 1, "text": long}, {"id": 2, "text": ""}]
    torn = '{"items": [' + ",".join(json.dumps(i, ensure_ascii=False) for i in items) + ', {"id": 3, "text": "cut'
    df = spark.createDataFrame([(torn,), (None,), ("",)], "reply string").select(reply_items(F.col("reply")).alias("items"))
    got = [r["items"] for r in df.collect()]
    assert [(i["id"], i["text"]) for i in got[0]] == [(1, long), (2, "")]
    assert not got[1] and not got[2]


def test_confidence_does_not_depend_on_the_order_of_words(spark):
    values = [0.1, 0.2, 0.3, 0.7, 0.9, 1.0, 0.6, 0.5, 0.4, 0.8, 0.1, 0.3, 0.2, 0.4, 0.2, 0.2]  # mean 0.43125
    rows = [(values,), (values[::-1],), (sorted(values),), ([None, None],), ([],)]
    df = spark.createDataFrame(rows, "p array<double>").select(segment_confidence(F.col("p"), F.lit(-0.5)).alias("c"))
    assert [r["c"] for r in df.collect()] == [0.4313, 0.4313, 0.4313, 0.6065, 0.6065]
