"""Joins on time: interval overlap, point in interval, nearest, and greedy alignment."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import ordered_fold

#: Bucket widths: about the length of the intervals joined, so that a bucket holds few of an episode's, and an
#: interval lies in few buckets.  Lines, cues and words last seconds; sessions and turns of events last hours.
LINES = 10_000
SESSIONS = 7_200_000


def overlap_join(left: DataFrame, right: DataFrame, bucket_ms: int = LINES, key: str = "episode_id") -> DataFrame:
    """Pairs of intervals of one episode that overlap; columns of ``right`` get the prefix r_.

    Both sides are exploded over fixed time buckets and joined on (episode, bucket); a pair is
    emitted only in the bucket where its overlap begins, so no pair appears twice and no
    cross product of an episode is made.  ``bucket_ms`` moves no row, only work.
    """
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    over = lambda df, p: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(f"{p}start_ms") / bucket_ms), F.floor(F.greatest(F.col(f"{p}end_ms") - 1, F.col(f"{p}start_ms")) / bucket_ms))))
    a, b = over(left, ""), over(r, "r_").withColumnRenamed("_b", "_rb")
    hit = (F.col(key) == F.col(f"r_{key}")) & (F.col("_b") == F.col("_rb")) & (F.col("r_start_ms") < F.col("end_ms")) & (F.col("r_end_ms") > F.col("start_ms"))
    first = F.floor(F.greatest("start_ms", "r_start_ms") / bucket_ms)
    return a.join(b, hit).where(F.col("_b") == first).drop("_b", "_rb", f"r_{key}").withColumn("overlap_ms", F.least("end_ms", "r_end_ms") - F.greatest("start_ms", "r_start_ms"))


def assign_speakers(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """(episode_id, seg_id, assigned, overlap_ms): the speaker with the largest summed overlap, the first met on ties."""
    o = overlap_join(segments.select("episode_id", "seg_id", "start_ms", "end_ms"), turns.select("episode_id", "turn_id", "start_ms", "end_ms", "speaker"), SESSIONS)
    sums = o.groupBy("episode_id", "seg_id", "r_speaker").agg(F.sum("overlap_ms").alias("s"), F.min(F.struct("r_start_ms", "r_turn_id")).alias("met"))
    # The greatest sum; on ties the speaker met first.
    best = sums.groupBy("episode_id", "seg_id").agg(F.min_by("r_speaker", F.struct(-F.col("s"), "met")).alias("assigned"), F.max("s").alias("overlap_ms"))
    return segments.select("episode_id", "seg_id").join(best, ["episode_id", "seg_id"], "left")


def best_overlap_assign(cues: DataFrame, segments: DataFrame) -> DataFrame:
    """(cue key, seg_id): each cue's segment of largest overlap (the first on ties) where that is half of the cue at least."""
    o = overlap_join(cues, segments, SESSIONS)
    best = o.groupBy("episode_id", "turn_id", "start_ms", "end_ms").agg(F.min_by("r_seg_id", F.struct(-F.col("overlap_ms"), "r_start_ms", "r_seg_id")).alias("seg_id"), F.max("overlap_ms").alias("overlap_ms"))
    return best.where("2 * overlap_ms >= end_ms - start_ms")


def point_join(points: DataFrame, intervals: DataFrame, bucket_ms: int = LINES) -> DataFrame:
    """Points (episode_id, at_ms) with every interval that holds them, both ends included; intervals get the prefix r_."""
    r = intervals.select(*[F.col(c).alias(f"r_{c}") for c in intervals.columns])
    r = r.withColumn("_rb", F.explode(F.sequence(F.floor(F.col("r_start_ms") / bucket_ms), F.floor(F.col("r_end_ms") / bucket_ms))))
    p = points.withColumn("_b", F.floor(F.col("at_ms") / bucket_ms))
    return p.join(r, (F.col("episode_id") == F.col("r_episode_id")) & (F.col("_b") == F.col("_rb")) & F.col("at_ms").between(F.col("r_start_ms"), F.col("r_end_ms"))).drop("_b", "_rb", "r_episode_id")


def nearest_within(points: DataFrame, marks: DataFrame, window_ms: int = 250) -> DataFrame:
    """Each point (episode_id, point_id, at_ms) with its nearest mark (episode_id, mark_ms) in +-window; the earlier on ties."""
    size = 2 * window_ms
    m = marks.select(F.col("episode_id").alias("m_episode"), "mark_ms", F.floor(F.col("mark_ms") / size).alias("_mb"))
    p = points.withColumn("_b", F.explode(F.sequence(F.floor((F.col("at_ms") - window_ms) / size), F.floor((F.col("at_ms") + window_ms) / size))))
    hits = p.join(m, (F.col("episode_id") == F.col("m_episode")) & (F.col("_b") == F.col("_mb")) & (F.abs(F.col("mark_ms") - F.col("at_ms")) <= window_ms))
    best = hits.groupBy("episode_id", "point_id").agg(F.min_by("mark_ms", F.struct(F.abs(F.col("mark_ms") - F.col("at_ms")), "mark_ms")).alias("mark_ms"))
    return points.join(best, ["episode_id", "point_id"], "left")


def align_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(episode_id, a_id, b_id): greedy one-to-one pairing by largest overlap in time order; partners may be null.

    The pairing depends on what was used before, so it is one ordered pass over each episode's lines of both runs.  A line
    of A is paired once a line begins at its end or later, and lines of B are given out once no later line of A can meet
    them; only lines between these two places are held.  Lines without times have no partner.
    """

    def greedy(rows: Iterator[tuple]) -> Iterator[tuple]:
        waiting: deque = deque()  # lines of A: start, end, unit
        open_: deque = deque()  # lines of B that a line of A may still meet: start, end, unit, used

        def passed(time: float) -> Iterator[tuple]:
            while open_ and open_[0][1] <= time:
                _, _, unit, used = open_.popleft()
                if not used:
                    yield None, unit

        def paired() -> Iterator[tuple]:
            start, end, unit = waiting.popleft()
            yield from passed(start)
            best, partner = 0, None
            for other in open_:
                if other[0] >= end:
                    break
                overlap = min(end, other[1]) - max(start, other[0])
                if overlap > best and not other[3]:
                    best, partner = overlap, other
            if partner:
                partner[3] = True
            yield unit, partner and partner[2]

        for second, start, end, unit in rows:
            if start is None or end is None:
                yield (None, unit) if second else (unit, None)
                continue
            while waiting and waiting[0][1] <= start:
                yield from paired()
            if not waiting:
                yield from passed(start)
            if second:
                open_.append([start, end, unit, False])
            else:
                waiting.append((start, end, unit))
        while waiting:
            yield from paired()
        yield from passed(math.inf)

    cut = lambda df, second: df.select("episode_id", F.lit(second).alias("_second"), "start_ms", "end_ms", "unit_id")
    order = [F.asc_nulls_last("start_ms"), F.asc_nulls_last("unit_id"), F.col("_second")]
    return ordered_fold(cut(a, False).unionByName(cut(b, True)), ["episode_id"], order, ["_second", "start_ms", "end_ms", "unit_id"], greedy, "a_id long, b_id long")


def mutual_best(a: DataFrame, b: DataFrame) -> DataFrame:
    """(episode_id, a_id, b_id): pairs that are each other's largest overlap; plain SQL, without order effects."""
    o = overlap_join(a.select("episode_id", "unit_id", "start_ms", "end_ms"), b.select("episode_id", "unit_id", "start_ms", "end_ms"))
    wa = Window.partitionBy("episode_id", "unit_id").orderBy(F.desc("overlap_ms"), "r_unit_id")
    wb = Window.partitionBy("episode_id", "r_unit_id").orderBy(F.desc("overlap_ms"), "unit_id")
    return o.withColumn("_a", F.row_number().over(wa)).withColumn("_b", F.row_number().over(wb)).where("_a = 1 and _b = 1").select("episode_id", F.col("unit_id").alias("a_id"), F.col("r_unit_id").alias("b_id"))


def side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each line of run A with the texts of run B at the same time, joined in time order."""
    o = overlap_join(a.select("episode_id", "unit_id", "start_ms", "end_ms"), b.select("episode_id", "unit_id", "start_ms", "end_ms", "text"))
    texts = o.groupBy("episode_id", "unit_id").agg(F.array_sort(F.collect_list(F.struct("r_start_ms", "r_unit_id", "r_text"))).alias("t"))
    return a.join(texts, ["episode_id", "unit_id"], "left").select("episode_id", "unit_id", "text", F.coalesce(F.array_join(F.col("t.r_text"), " "), F.lit("")).alias("other"))
