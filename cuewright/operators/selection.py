"""Choices among tracks, files, decode candidates and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins


def base_code(language: Column) -> Column:
    """The language of a code such as ``tr-TR``."""
    return F.lower(F.split(language, "[-_]")[0])


def best_track(tracks: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(media, track_id): the manual track in the media's own language that agrees best with the audio, at ``threshold`` at least; the least id on ties."""
    own = tracks.where((F.col("kind") == "manual") & (base_code(F.col("language")) == base_code(F.col("audio_language"))) & (F.col("agreement") >= threshold))
    return own.groupBy("media").agg(F.min_by("track_id", F.struct(-F.col("agreement"), "track_id")).alias("track_id"))


def best_community_file(files: DataFrame) -> DataFrame:
    """(language, file_id): the file with most downloads of each language; entries without files or translated by machine are left out."""
    usable = files.where((F.col("n_files") > 0) & ~F.col("machine_translated"))
    return usable.groupBy("language").agg(F.min_by("file_id", F.struct(-F.col("downloads"), "file_id")).alias("file_id"))


def select_tracks(tracks: DataFrame, source: str, target: str, most: int = 5) -> DataFrame:
    """(media, track_id, slot): a manual track in the source language, one in the target language, one in English, then one automatic track.

    Of a slot's tracks an exact code comes before regional variants and ``-orig`` before
    other automatic ones, then the least code and id.
    """
    code, base = F.lower("language"), base_code(F.col("language"))
    manual = F.col("kind") == "manual"
    slot = F.when(manual & (base == source), 0).when(manual & (base == target), 1).when(manual & (base == "en"), 2).when(~manual, 3)
    order = F.struct(F.when(manual, (code != base).cast("int")).otherwise((~code.endswith("-orig")).cast("int")).alias("p"), code.alias("code"), F.col("track_id").alias("track_id"))
    one = tracks.withColumn("_slot", slot).where("_slot is not null").groupBy("media", "_slot").agg(F.min_by("track_id", order).alias("track_id"))
    n = F.row_number().over(Window.partitionBy("media").orderBy("_slot"))
    return one.withColumn("slot", n).where(F.col("slot") <= most).select("media", "track_id", "slot")


def merge_decode(originals: DataFrame, pieces: DataFrame, bucket_ms: int = joins.LINES) -> DataFrame:
    """(episode_id, seg_id, start_ms, end_ms, text, logprob, no_speech, compression): pieces joined under the original that holds their middle.

    The log probability is the pieces' mean weighted by length; of the other figures the greatest counts.
    """
    middle = pieces.withColumn("at_ms", F.floor((F.col("start_ms") + F.col("end_ms")) / 2))
    hit = joins.point_join(middle, originals.select("episode_id", "seg_id", "start_ms", "end_ms"), bucket_ms)
    length = F.col("end_ms") - F.col("start_ms")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("start_ms", "piece_id", "text"))), lambda x: x["text"])
    return hit.groupBy("episode_id", F.col("r_seg_id").alias("seg_id")).agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_join(texts, " ").alias("text"),
        F.round(F.try_divide(F.sum(F.col("logprob") * length), F.sum(length)), 6).alias("logprob"), F.max("no_speech").alias("no_speech"), F.max("compression").alias("compression"),
    )


def pick_decode(originals: DataFrame, candidates: DataFrame, most_compression: float = 2.4) -> DataFrame:
    """(seg_id, candidate_id): the valid candidate of best log probability; null where the original stays.

    Valid: better than the original, not compressed too well (a loop), and no invented text.
    """
    both = candidates.join(originals.select("seg_id", F.col("logprob").alias("_own")), "seg_id")
    valid = both.where((F.col("logprob") > F.col("_own")) & (F.col("compression") <= most_compression) & ~F.col("hallucinated"))
    best = valid.groupBy("seg_id").agg(F.min_by("candidate_id", F.struct(-F.col("logprob"), "candidate_id")).alias("candidate_id"))
    return originals.select("seg_id").join(best, "seg_id", "left")


#: Fields of a series' metadata.
FIELDS = ("series", "season", "episode")


def detect_series(*sources: Column) -> Column:
    """Struct of FIELDS: for each field the first non-empty value of the sources (structs), the strongest first."""
    return F.struct(*[F.coalesce(*[F.nullif(s[f].cast("string"), F.lit("")) for s in sources]).alias(f) for f in FIELDS])


def segment_confidence(probabilities: Column, avg_logprob: Column) -> Column:
    """The mean of the words' known probabilities, else the exponential of the segment's mean log probability, else null; four places.

    Probabilities count in whole millionths, so that the words' order can't move a mean that lies between two results.
    """
    known = F.filter(probabilities, lambda p: p.isNotNull())
    total = F.aggregate(known, F.lit(0).cast("long"), lambda s, p: s + F.round(p * 1_000_000).cast("long"))
    return F.round(F.coalesce(F.try_divide(total, F.size(known) * F.lit(1_000_000).cast("long")), F.exp(avg_logprob)), 4)


def benchmark_score(answers: DataFrame, baseline: float, floor: float = 78.0) -> DataFrame:
    """(model, score, exclude) of answers (model, acceptable, tokens, seconds): 4 a good line, less up to 4 for long answers and 4 for a slow run; below the baseline a model is left out."""
    g = answers.groupBy("model").agg((4 * F.count_if("acceptable")).alias("good"), F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"))
    score = F.col("good") - F.least(F.lit(4.0), F.col("tokens") / 1000) - F.when(F.col("seconds") > 60, 4).otherwise(0)
    return g.select("model", F.round(score, 6).alias("score"), (score < baseline).alias("exclude"), (score >= floor).alias("above_floor"))
