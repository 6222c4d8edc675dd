"""Run-against-run evaluation: votes, error rates, word and character errors, chrF, totals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.grams import chrf_counts
from ..functions.matching import edit_distance
from ..functions.text import squeeze, wilson
from .joins import align_runs


def judge_votes(votes: DataFrame) -> DataFrame:
    """(item, line, n, outcome, agreement): the majority per line; more than half decides, else a tie."""
    per = votes.groupBy("item", "line").agg(F.count("*").alias("n"), F.count_if(F.col("winner") == "new").alias("new"), F.count_if(F.col("winner") == "old").alias("old"), F.count_if(F.col("winner") == "tie").alias("tie"))
    outcome = F.when(2 * F.col("new") > F.col("n"), "win").when(2 * F.col("old") > F.col("n"), "loss").otherwise("tie")
    return per.select("item", "line", "n", outcome.alias("outcome"), (F.greatest("new", "old", "tie") / F.col("n")).alias("agreement"))


def vote_totals(votes: DataFrame) -> DataFrame:
    """(item, wins, losses, ties, agreement, rate, low, high) per item and, with a null item, for all."""
    g = judge_votes(votes).rollup("item").agg(F.count_if(F.col("outcome") == "win").alias("wins"), F.count_if(F.col("outcome") == "loss").alias("losses"), F.count_if(F.col("outcome") == "tie").alias("ties"), F.round(F.avg("agreement"), 6).alias("agreement"))
    return g.withColumn("w", wilson(F.col("wins"), F.col("wins") + F.col("losses"))).select("item", "wins", "losses", "ties", "agreement", "w.rate", "w.low", "w.high")


def absolute_errors(reports: DataFrame) -> DataFrame:
    """(item, lines, major_rate, minor_mean) from (item, line, judge, severity or null): a line is major when over half of its judges say so."""
    per_judge = reports.groupBy("item", "line", "judge").agg(F.max((F.coalesce(F.col("severity"), F.lit("")) == "major").cast("int")).alias("major"), F.count_if(F.col("severity") == "minor").alias("minor"))
    per_line = per_judge.groupBy("item", "line").agg((2 * F.sum("major") > F.count("*")).alias("major"), F.avg("minor").alias("minor"))
    return per_line.groupBy("item").agg(F.count("*").alias("lines"), F.round(F.count_if("major") / F.count("*"), 6).alias("major_rate"), F.round(F.avg("minor"), 6).alias("minor_mean"))


@F.pandas_udf(LongType())
def _word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(x.split(), y.split()) for x, y in zip(a, b)], index=a.index, dtype="int64")


@F.pandas_udf(LongType())
def _char_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(x, y) for x, y in zip(a, b)], index=a.index, dtype="int64")


def word_distance(a: Column | str, b: Column | str) -> Column:
    """Levenshtein distance over words, of any number; null texts have none."""
    a, b = (F.coalesce(squeeze(F.col(x) if isinstance(x, str) else x), F.lit("")) for x in (a, b))
    return F.when(a == b, F.lit(0).cast("long")).otherwise(_word_distance(a, b))


def wer_cer(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """(episode_id, word_errors, words, char_errors, chars, omissions, insertions) over aligned lines."""
    pairs = align_runs(reference, hypothesis)
    r = reference.select("episode_id", F.col("unit_id").alias("a_id"), F.col("text").alias("ref"))
    h = hypothesis.select("episode_id", F.col("unit_id").alias("b_id"), F.col("text").alias("hyp"))
    both = pairs.join(r, ["episode_id", "a_id"], "left").join(h, ["episode_id", "b_id"], "left")
    ref, hyp = F.coalesce("ref", F.lit("")), F.coalesce("hyp", F.lit(""))
    paired = F.col("a_id").isNotNull() & F.col("b_id").isNotNull()
    both = both.withColumn("we", word_distance(ref, hyp)).withColumn("ce", F.when(ref == hyp, F.lit(0).cast("long")).otherwise(_char_distance(ref, hyp)))
    return both.groupBy("episode_id").agg(
        F.sum(F.when(paired, F.col("we"))).alias("word_errors"), F.sum(F.when(paired, F.size(F.split(F.trim("ref"), r"\s+")))).cast("long").alias("words"),
        F.sum(F.when(paired, F.col("ce"))).cast("long").alias("char_errors"), F.sum(F.when(paired, F.length("ref"))).cast("long").alias("chars"),
        F.count_if(F.col("b_id").isNull()).alias("omissions"), F.count_if(F.col("a_id").isNull()).alias("insertions"),
    )


def chrf_score(sums: list[Column], beta: float = 2.0) -> Column:
    """chrF of the sums of ``chrf_counts``: mean precision and recall over the gram lengths that both sides have; two places, 0 if there are none."""
    total_p, total_r, used = F.lit(0.0), F.lit(0.0), F.lit(0)
    for common, hyp, ref in zip(sums[::3], sums[1::3], sums[2::3]):
        has = (hyp > 0) & (ref > 0)
        total_p = total_p + F.when(has, common / hyp).otherwise(0.0)
        total_r = total_r + F.when(has, common / ref).otherwise(0.0)
        used = used + has.cast("int")
    p, r = F.try_divide(total_p, used), F.try_divide(total_r, used)
    score = F.try_divide((1 + beta * beta) * p * r, beta * beta * p + r) * 100
    return F.round(F.coalesce(score, F.lit(0.0)), 2)


def chrf_agg(counts: Column, order: int = 6, over: Window | None = None) -> Column:
    """Corpus chrF of a group or, with ``over``, of a window, from a column of ``chrf_counts``: an expression over sums, so Spark adds up before it shuffles."""
    sums = [F.sum(counts[i]) for i in range(3 * order)]
    return chrf_score([x.over(over) for x in sums] if over is not None else sums)


def wilson_agg(hit: Column, over: Window | None = None) -> Column:
    """Share and interval of the rows with ``hit`` in a group or, with ``over``, in a window."""
    wins, n = F.count_if(hit), F.count("*")
    return wilson(wins.over(over), n.over(over)) if over is not None else wilson(wins, n)


def chrf(rows: DataFrame, key: str, reference: str, hypothesis: str, order: int = 6) -> DataFrame:
    """(key, chrf): corpus chrF per key.  Grams are counted per line in Arrow batches; only sums per gram length are shuffled."""
    lines = rows.select(key, chrf_counts(F.col(reference), F.col(hypothesis), order).alias("counts"))
    return lines.groupBy(key).agg(chrf_agg(F.col("counts"), order).alias("chrf"))


def run_metrics(units: DataFrame) -> DataFrame:
    """(run, item, lines, flagged_share, low_share, minutes) from (run, item, flags, confidence, end_ms)."""
    return units.groupBy("run", "item").agg(F.count("*").alias("lines"), F.round(F.count_if(F.size("flags") > 0) / F.count("*"), 6).alias("flagged_share"), F.round(F.count_if(F.col("confidence") == "LOW") / F.count("*"), 6).alias("low_share"), F.round(F.max("end_ms") / 60000, 6).alias("minutes"))


def asr_run_stats(words: DataFrame, elapsed_s: Column) -> DataFrame:
    """(episode_id, segments, removed, words, weak_words, speech_s, s_per_audio_minute) of words with a flag ``removed`` of their segment."""
    kept = ~F.col("removed")
    return words.groupBy("episode_id").agg(
        F.countDistinct(F.when(kept, F.col("unit_id"))).alias("segments"), F.countDistinct(F.when(~kept, F.col("unit_id"))).alias("removed"),
        F.count_if(kept).alias("words"), F.count_if(kept & (F.col("probability") < 0.3)).alias("weak_words"),
        F.round(F.coalesce(F.sum(F.when(kept, F.col("end_ms") - F.col("start_ms"))), F.lit(0)) / 1000, 3).alias("speech_s"),
        F.round(F.try_divide(elapsed_s * 60000, F.max("end_ms")), 6).alias("s_per_audio_minute"),
    )


def sample_per_item(rows: DataFrame, item: str, line: str, n: int, seed: str = "sample-1") -> DataFrame:
    """At most n lines an item by a hash of seed, item and line: the same lines for every run; ``swap`` is a fair bit of the hash."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col(item).cast("string"), F.col(line).cast("string")).cast("binary"))
    rn = F.row_number().over(Window.partitionBy(item).orderBy("_key"))
    return rows.withColumn("_key", key).withColumn("_rn", rn).where(F.col("_rn") <= n).withColumn("swap", F.conv(F.substring("_key", 32, 1), 16, 10).cast("int") % 2 == 1).drop("_rn", "_key")


def stage_share(numerator: Column, denominator: Column) -> Column:
    return F.round(F.try_divide(numerator, denominator), 6)
