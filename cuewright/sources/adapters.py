"""Domain tables (lines, segments, turns, jobs, votes) made from the driver's tables.

Times are BIGINT milliseconds.  Each adapter has a twin CTE in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(episode_id, unit_id, start_ms, end_ms, speaker, text): one conversation is one episode."""
    timed = table(spark, d, "conversations").select(
        F.col("conv_id").alias("episode_id"), F.col("turn").alias("unit_id"), F.col("role").alias("speaker"), "text",
        F.expr("cast(600 + 55 * least(length(text), 120) as bigint)").alias("dur"),
        F.expr("cast(element_at(array(-150, 0, 300, 900), cast((turn * 7 + conv_id) % 4 + 1 as int)) as bigint)").alias("gap"),
    )
    before = Window.partitionBy("episode_id").orderBy("unit_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(before), F.lit(0))
    return timed.withColumn("start_ms", start).select("episode_id", "unit_id", "start_ms", (F.col("start_ms") + F.col("dur")).alias("end_ms"), "speaker", "text")


def lines_b(spark: SparkSession, d: str) -> DataFrame:
    """A second run over the same episodes: some lines missing, shifted or shortened."""
    shift = F.expr("((unit_id * 13 + episode_id) % 5 - 2) * 120")
    text = F.when(F.expr("(unit_id + episode_id) % 3 = 0"), F.regexp_replace("text", r"\s+\S+$", "")).otherwise(F.col("text"))
    return lines(spark, d).where("(unit_id + episode_id) % 11 <> 0").select("episode_id", "unit_id", (F.col("start_ms") + shift).alias("start_ms"), (F.col("end_ms") + shift).alias("end_ms"), "speaker", text.alias("text"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a target text: the next line's text (empty for the last line)."""
    w = Window.partitionBy("episode_id").orderBy("unit_id")
    return lines(spark, d).withColumnRenamed("text", "source").withColumn("target", F.coalesce(F.lead("source").over(w), F.lit("")))


def _intervals(spark: SparkSession, d: str, keep: str) -> DataFrame:
    start = F.expr("unix_millis(cast(ts as timestamp))")
    return table(spark, d, "events").where(keep).select(F.col("user_id").alias("episode_id"), "event_id", start.alias("start_ms"), (start + F.expr("cast(floor(value * 60000) as bigint)")).alias("end_ms"), F.col("event_type").alias("speaker"), F.col("value"), "props")


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Speech intervals of a user: events with an even id, value in minutes."""
    return _intervals(spark, d, "event_id % 2 = 0").withColumnRenamed("event_id", "seg_id")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Speaker turns of a user: events with an odd id."""
    return _intervals(spark, d, "event_id % 2 = 1").withColumnRenamed("event_id", "turn_id")


def worded_lines(spark: SparkSession, d: str) -> DataFrame:
    """(episode_id, unit_id, speaker, words): the words of each line, evenly spread over it, as one array."""
    at = lambda i, n: F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * i / n)
    timed = lambda w: let(F.size(w), lambda n: F.transform(w, lambda x, i: F.struct(x.alias("word"), at(i, n).alias("start_ms"), at(i + 1, n).alias("end_ms"))))
    split = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    return lines(spark, d).select("episode_id", "unit_id", "speaker", let(split, timed).alias("words"))


def words(spark: SparkSession, d: str) -> DataFrame:
    """One row per word of a line, with a probability from its length."""
    rows = worded_lines(spark, d).select("episode_id", "unit_id", "speaker", F.posexplode("words").alias("pos", "w"))
    return rows.select("episode_id", "unit_id", "pos", "w.word", "w.start_ms", "w.end_ms", "speaker", F.expr("((length(w.word) * 7 + pos * 3 + unit_id) % 11) / 10.0D").alias("probability"))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """Processing jobs: orders, one machine a customer."""
    status = F.expr("case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'running' end")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.expr("o_custkey % 50").alias("machine"), status.alias("status"), F.expr("cast(round(o_totalprice) as bigint)").alias("media_s"), F.expr("cast(o_orderdate as date)").alias("created"))


def job_stages(spark: SparkSession, d: str) -> DataFrame:
    """Stages of jobs; (job, stage) repeats in the source and is folded to its greatest values."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("stage")).agg(F.expr("cast(max(l_quantity) as bigint)").alias("elapsed_s"), F.expr("max(l_returnflag) = 'R'").alias("cached"), F.max("l_suppkey").alias("supplier"))


def votes(spark: SparkSession, d: str) -> DataFrame:
    """(item, line, judge, winner): two judges from the labels, a third from the id."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    each = F.explode(F.expr("""array(
        named_struct('judge', 1, 'winner', if(quality = 1, 'new', 'old')),
        named_struct('judge', 2, 'winner', if(toxic = 1, 'old', 'tie')),
        named_struct('judge', 3, 'winner', element_at(array('new', 'tie', 'old'), cast(doc_id % 3 + 1 as int))))"""))
    return rows.select(F.col("source").alias("item"), F.col("doc_id").alias("line"), each.alias("v")).select("item", "line", "v.judge", "v.winner")


def voices(spark: SparkSession, d: str) -> DataFrame:
    """Window-local voices: ten windows of five voices an episode."""
    return table(spark, d, "embeddings").select(F.expr("vec_id div 50").alias("episode_id"), F.expr("cast((vec_id % 50) div 5 as int)").alias("window"), F.expr("cast(vec_id % 5 as int)").alias("local"), F.col("embedding").alias("vector"))
