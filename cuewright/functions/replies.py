"""Model replies and requests as JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import max_chars, squeeze


def reply_body(reply: Column) -> Column:
    """The object of a reply: think blocks dropped, from the first brace to the last."""
    return F.regexp_extract(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""), r"(?s)(\{.*\})", 1)


def reply_items(reply: Column) -> Column:
    """Array of (id, text): the parsed list, or every complete item that a broken reply still holds.

    The pattern's quantifiers are possessive: Java's others recurse for every repetition, which ends the JVM on long texts.
    """
    body = reply_body(reply)
    whole = F.from_json(body, "items array<struct<id:bigint,text:string>>")["items"]
    found = F.regexp_extract_all(reply, F.lit(r'(\{"id":\s*+\d++,\s*+"text":\s*+"(?:[^"\\]++|\\.)*+"\})'), F.lit(1))
    salvaged = F.transform(found, lambda x: F.from_json(x, "id bigint, text string"))
    return F.coalesce(whole, salvaged)


def block_requests(lines: DataFrame, block_lines: int = 25, before: int = 6, after: int = 8, cps: int = 17, max_line: int = 42) -> DataFrame:
    """(episode_id, block, payload): one JSON request per block with its lines and the context on both sides."""
    w = Window.partitionBy("episode_id").orderBy("unit_id")
    rows = lines.withColumn("block", F.floor((F.row_number().over(w) - 1) / block_lines))
    rows = rows.withColumn("_before", F.collect_list("text").over(w.rowsBetween(-before, -1))).withColumn("_after", F.collect_list("text").over(w.rowsBetween(1, after)))
    line = F.struct(F.col("unit_id").alias("id"), squeeze(F.col("text")).alias("source"), max_chars(F.col("end_ms") - F.col("start_ms"), F.lit(cps), F.lit(max_line)).alias("max_chars"))
    g = rows.groupBy("episode_id", "block").agg(F.min_by("_before", "unit_id").alias("previous"), F.sort_array(F.collect_list(line)).alias("lines"), F.max_by("_after", "unit_id").alias("next"))
    return g.select("episode_id", "block", F.to_json(F.struct("previous", "lines", "next")).alias("payload"))
