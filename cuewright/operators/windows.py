"""Windows and folds over an episode's segments: evaluation windows and picks, votes, gains, decode budgets."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import ordered_fold

def sliding_windows(segments: DataFrame, width_ms: int = 900_000, step_ms: int = 60_000) -> DataFrame:
    """(episode_id, window_ms, lines, confidence, words_per_s) of segments (episode_id, start_ms, end_ms, confidence, words).

    Windows start every ``step_ms`` as long as they end inside the episode; one that is no
    longer than a window has one.  A segment counts where it lies inside; empty windows give
    no row; an unknown confidence counts as 1.  Each segment names its own windows, so no
    list of windows is joined.
    """
    length = segments.groupBy("episode_id").agg(F.max("end_ms").alias("_length"))
    last_start = F.floor(F.greatest(F.col("_length") - width_ms, F.lit(0)) / step_ms)
    first = F.greatest(F.lit(0), F.ceil((F.col("end_ms") - width_ms) / step_ms))
    last = F.least(F.floor(F.col("start_ms") / step_ms), last_start)
    rows = segments.join(length, "episode_id").where("start_ms >= 0").where(first <= last).withColumn("_w", F.explode(F.sequence(first, last)))
    speech = F.sum(F.col("end_ms") - F.col("start_ms"))
    return rows.groupBy("episode_id", (F.col("_w") * step_ms).alias("window_ms")).agg(
        F.count("*").alias("lines"), F.round(F.avg(F.coalesce("confidence", F.lit(1.0))), 6).alias("confidence"), F.round(F.try_divide(F.sum("words") * 1000, speech), 6).alias("words_per_s")
    )


#: Picks of an evaluation set: name and order, the best first.
PICKS = (("dialogue", "-lines"), ("noise", "confidence"), ("fast_speech", "-words_per_s"))


def eval_picks(windows: DataFrame) -> DataFrame:
    """(pick, episode_id, window_ms): the window with most lines, with least confidence and with fastest speech, each from an episode not yet taken if there is one."""
    per = windows.groupBy("episode_id").agg(*[F.min(F.struct(F.expr(order).cast("double").alias("o"), "window_ms")).alias(name) for name, order in PICKS])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("pick"), F.col(name)["o"].alias("o"), F.col(name)["window_ms"].alias("window_ms")) for name, _ in PICKS]))
    place = F.row_number().over(Window.partitionBy("pick").orderBy("o", "episode_id"))
    # As many episodes of each pick as there are picks, so that one is left whatever the others take: nine rows from one pass.
    best = per.select("episode_id", each.alias("p")).select("episode_id", "p.*").withColumn("place", place).where(F.col("place") <= len(PICKS)).orderBy("place").collect()
    taken, rows = set(), []
    for name, _ in PICKS:
        own = [r for r in best if r["pick"] == name]
        if own:
            r = next((r for r in own if r["episode_id"] not in taken), own[0])
            taken.add(r["episode_id"])
            rows.append((name, r["episode_id"], r["window_ms"]))
    return windows.sparkSession.createDataFrame(rows, "pick string, episode_id long, window_ms long")


def language_vote(windows: DataFrame, least_ms: int = 5000) -> DataFrame:
    """(file, language, share) of windows (file, language, probability, length_ms).

    Probabilities are summed by language; the greatest sum, over the number of all windows,
    is the share.  Short windows and those without a language give no vote but count.
    """
    voted = F.when((F.col("length_ms") >= least_ms) & F.col("language").isNotNull(), F.col("probability"))
    per = windows.groupBy("file", "language").agg(F.sum(voted).alias("v"), F.count("*").alias("n"))
    best = per.groupBy("file").agg(F.min_by("language", F.when(F.col("v").isNotNull(), F.struct(-F.col("v"), "language"))).alias("language"), F.max("v").alias("v"), F.sum("n").alias("n"))
    return best.select("file", F.coalesce("language", F.lit("en")).alias("language"), F.round(F.coalesce(F.col("v") / F.col("n"), F.lit(0.0)), 6).alias("share"))


def frame_gain(frames: DataFrame, key: str, order: list[str], level: str, target: float, silence: float, short: int = 50, long: int = 100) -> DataFrame:
    """``gain`` of every frame: towards a target level by the mean of the frames around it, within 1 to 12 dB, silence as it is, then smoothed over a longer stretch."""
    w = Window.partitionBy(key).orderBy(*order)
    around = lambda n: w.rowsBetween(-n // 2, n // 2 - 1)
    raw = F.when(F.col(level) < silence, 1.0).otherwise(F.least(F.greatest(target / F.avg(level).over(around(short)), F.lit(1.12)), F.lit(3.98)))
    return frames.withColumn("_raw", raw).withColumn("gain", F.avg("_raw").over(around(long))).drop("_raw")


def context_window(lines: DataFrame, before: int = 3, after: int = 3, text: str = "text") -> DataFrame:
    """Arrays ``before`` and ``after`` of the texts around each line of its episode."""
    w = Window.partitionBy("episode_id").orderBy("unit_id")
    return lines.withColumn("before", F.collect_list(text).over(w.rowsBetween(-before, -1))).withColumn("after", F.collect_list(text).over(w.rowsBetween(1, after)))


def make_blocks(lines: DataFrame, size: int = 25) -> DataFrame:
    """``block``: lines of an episode in runs of ``size``."""
    return lines.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("episode_id").orderBy("unit_id")) - 1) / size))


def redecode_select(segments: DataFrame, share: float = 0.2, low: float = 0.5, extra_ms: int = 2000) -> DataFrame:
    """(episode_id, ids): segments of low mean confidence, worst first, as long as a share of the episode lasts.

    A segment costs its length and ``extra_ms``; one that costs too much is passed over and
    a later one may fit.  ``segments``: (episode_id, unit_id, mean, start_ms, end_ms).
    """
    budget = segments.groupBy("episode_id").agg((F.max("end_ms") * share).alias("budget"))
    low_ones = segments.where(F.col("mean") < low).select("episode_id", "mean", "unit_id", (F.col("end_ms") - F.col("start_ms") + extra_ms).alias("cost")).join(budget, "episode_id")

    def pick(rows: Iterator[tuple]) -> Iterator[tuple]:
        left = None
        for n, (unit, cost, budget) in enumerate(rows):
            left = budget if left is None else left
            if cost <= left:
                left -= cost
                yield n, unit

    picked = ordered_fold(low_ones, ["episode_id"], [F.col("mean"), F.col("unit_id")], ["unit_id", "cost", "budget"], pick, "place bigint, unit_id bigint")
    # A pick costs ``extra_ms`` at least, so that the budget bounds the array.
    ids = picked.groupBy("episode_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "unit_id"))), lambda x: x["unit_id"]).alias("ids"))
    return budget.join(ids, "episode_id", "left").select("episode_id", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))
