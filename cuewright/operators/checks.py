"""Filters and per-line checks over cues, segments and translated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import flags, let, negation_lost, norm_words, numbers_in, question_lost, visible, visible_lines

#: Flags that make a line LOW, and flags that never lower it.
SEVERE = ["empty_translation", "untranslated_or_wrong_script", "numbers_differ", "repetition_loop", "not_refined_by_ai", "invalid_timing", "overlap", "empty_cue", "name_mismatch"]
NEUTRAL = ["extra_whitespace", "three_dots", "tatweel", "arabic_indic_digits", "latin_punctuation", "space_before_punctuation"]
#: Every flag that some check can give.
VOCABULARY = [
    "empty_translation", "untranslated_or_wrong_script", "numbers_differ", "suspicious_length", "repetition_loop", "same_as_previous_line",
    "latin_punctuation", "arabic_indic_digits", "space_before_punctuation", "three_dots", "combined_question_exclamation", "tatweel", "latin_words", "extra_whitespace",
    "invalid_timing", "overlap", "too_short", "too_long", "reading_speed", "line_too_long", "too_many_lines", "empty_cue", "duplicate_cue",
    "not_refined_by_ai", "weak_ai_model", "ai_disagreement", "reviewer_suggestion", "name_mismatch", "low_audio_confidence",
]
#: Own small list of phrases that recognisers invent over silence.
PHRASES = ["thanks for watching", "thank you for watching", "please subscribe", "like and subscribe", "subtitles by", "transcription by", "vielen dank fürs zuschauen", "merci d avoir regardé", "gracias por ver el video"]
CREDITS = ["subtitles by", "transcription by"]
#: Limits of cue checks: language -> (characters a second, characters a line, least milliseconds).
GUIDES = {"en": (17, 42, 833), "fr": (17, 42, 833), "de": (17, 42, 833), "es": (17, 42, 833)}
GENERIC = (17, 42, 833)


def check_cues(cues: DataFrame, order: str = "unit_id", max_cps: int = 17, max_line: int = 42, max_lines: int = 2, min_ms: int = 833, max_ms: int = 7000, duplicate_gap_ms: int = 500) -> DataFrame:
    """The cues and ``qa_flags``: nine technical checks in input order within each episode."""
    w = Window.partitionBy("episode_id").orderBy(order)
    shown = F.trim(visible(F.col("text")))
    rows = cues.withColumn("_shown", shown).withColumn("_lines", visible_lines(F.col("text"))).withColumn("_pe", F.lag("end_ms").over(w)).withColumn("_pt", F.lag(shown).over(w))
    dur = F.col("end_ms") - F.col("start_ms")
    filled = F.col("_shown") != ""
    found = flags(
        ("invalid_timing", dur <= 0),
        ("overlap", F.col("start_ms") < F.col("_pe")),
        ("too_short", (dur > 0) & (dur < min_ms)),
        ("too_long", dur > max_ms),
        ("empty_cue", ~filled),
        ("reading_speed", filled & (dur > 0) & (F.length(F.array_join("_lines", " ")) * 1000 > dur * max_cps)),
        ("line_too_long", filled & F.exists("_lines", lambda x: F.length(x) > max_line)),
        ("too_many_lines", filled & (F.size("_lines") > max_lines)),
        ("duplicate_cue", filled & (F.col("_pt") == F.col("_shown")) & (F.col("start_ms") - F.col("_pe") <= duplicate_gap_ms)),
    )
    return rows.withColumn("qa_flags", found).drop("_shown", "_lines", "_pe", "_pt")


def confidence_category(flag_array: Column, audio: Column) -> Column:
    """LOW for a severe flag or audio under 0.5, MEDIUM for any other flag that counts or audio under 0.75, else HIGH."""
    relevant = F.array_except(flag_array, F.array(*[F.lit(x) for x in NEUTRAL]))
    severe = F.arrays_overlap(relevant, F.array(*[F.lit(x) for x in SEVERE]))
    return F.when(severe | F.coalesce(audio < 0.5, F.lit(False)), "LOW").when((F.size(relevant) > 0) | F.coalesce(audio < 0.75, F.lit(False)), "MEDIUM").otherwise("HIGH")


def review_reasons(line_flags: Column, qa_flags: Column, audio: Column, edited: Column) -> Column:
    """Issue codes of a line in order, each once; an edited line drops its automatic flags."""
    low = F.when(audio < 0.75, F.array(F.lit("low_audio_confidence"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.when(edited, F.array().cast("array<string>")).otherwise(line_flags), qa_flags, low))


def is_loop(text: Column) -> Column:
    """A group of 2-4 words four times in a row, or one word eight times, over 80 % of the words."""
    return let(norm_words(text), _loops)


def _loops(norm: Column) -> Column:
    """``is_loop`` of normal words.

    A run over 80 % of the words holds the middle three fifths at least, where each word then is the one ``size`` before
    it; runs are searched only in texts of which that is true.
    """

    def found(words: Column) -> Column:
        n = F.size(words)
        edge = F.floor(n / 5).cast("int")
        out = F.lit(False)
        for size, need in ((1, 8), (2, 4), (3, 4), (4, 4)):
            group = r"(?:\S+)" + r" \S+" * (size - 1)
            run = F.regexp_extract(norm, rf"(?:^| )({group})(?: \1(?= |$)){{{need - 1},}}", 0)
            kept = n - 2 * edge - size
            again = F.slice(words, edge + 1, kept) == F.slice(words, edge + 1 + size, kept)
            out = out | F.when((n >= size * need) & again, (run != "") & (F.size(F.split(F.trim(run), " ")) * 10 >= n * 8)).otherwise(False)
        return out

    return F.when(norm.isNotNull(), let(F.split(norm, " "), found))


def hallucination_reason(text: Column, no_speech: Column, logprob: Column, compression: Column) -> Column:
    """Why a recognised segment is taken for invented, in fixed precedence; null to keep it."""

    def reason(norm: Column) -> Column:
        credit = F.lit(False)
        for phrase in CREDITS:
            extra = F.size(F.split(norm, " ")) - len(phrase.split())
            tail = F.forall(F.slice(F.reverse(F.split(F.trim(text), r"\s+")), F.lit(1), F.greatest(extra, F.lit(1))), lambda w: w.rlike(r"^[\p{Lu}\p{N}]"))
            credit = credit | (norm.startswith(phrase + " ") & (extra <= 3) & ~F.trim(text).endswith("?") & tail)
        return (
            F.when(~text.rlike(r"[\p{L}\p{N}]"), "no words")
            .when(norm.isin(PHRASES) | credit, "known non-speech phrase")
            .when((no_speech >= 0.6) & (logprob <= -1.0), "probably not speech")
            .when(((compression > 2.4) & (F.length(text) > 40)) | _loops(norm), "repetition")
        )

    return let(norm_words(text), reason)


def low_confidence_words(probabilities: Column) -> Column:
    """Mean under 0.5, or three words in a row under 0.3; nulls do not count and no words are not low."""
    known = F.filter(probabilities, lambda p: p.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, p: a + p)
    run = F.aggregate(
        known,
        F.struct(F.lit(0).alias("run"), F.lit(False).alias("hit")),
        lambda s, p: F.struct(F.when(p < 0.3, s["run"] + 1).otherwise(0).alias("run"), (s["hit"] | ((p < 0.3) & (s["run"] >= 2))).alias("hit")),
        lambda s: s["hit"],
    )
    return (F.size(known) > 0) & ((F.round(total / F.size(known), 9) < 0.5) | run)


def check_line(source: Column, target: Column, prev_source: Column, prev_target: Column, script: str | None = None) -> Column:
    """Flags of a translated line; a blank target gives ``empty_translation`` alone.  ``script``: a Java script class for non-Latin targets."""
    from ..functions.text import script_ratio

    src, tgt = numbers_in(source), numbers_in(target)
    spelled = (F.size(tgt) == 0) & F.forall(src, lambda n: (F.length(n) <= 3) & (n.cast("int") <= 20))
    ratio = F.length(target) / F.length(source)
    wrong = script_ratio(target, script) < 0.6 if script else F.lit(False)
    rest = flags(
        ("untranslated_or_wrong_script", wrong),
        ("numbers_differ", (src != tgt) & ~spelled),
        ("suspicious_length", (F.length(source) >= 12) & ((ratio < 0.3) | (ratio > 3.0))),
        ("repetition_loop", target.rlike(r"(?iU)(\b\w+\b)(?:\W+\1\b){3,}")),
        ("same_as_previous_line", (F.trim(prev_target) == F.trim(target)) & (F.trim(prev_source) != F.trim(source))),
    )
    return F.when(F.trim(target) == "", F.array(F.lit("empty_translation"))).otherwise(rest)


def with_previous(rows: DataFrame) -> DataFrame:
    """Adds the previous line's source and target."""
    w = Window.partitionBy("episode_id").orderBy("unit_id")
    return rows.withColumn("prev_source", F.lag("source").over(w)).withColumn("prev_target", F.lag("target").over(w))


def risk_reasons(line_flags: Column, source: Column, target: Column, source_language: str, target_language: str, audio: Column, weak: Column, name_issue: Column, low: float = 0.5, high: float = 2.0) -> Column:
    """Cheap reasons why a translated line may be wrong, in fixed order."""
    ratio = F.length(target) / F.greatest(F.length(source), F.lit(1))
    return flags(
        ("check_line", F.size(line_flags) > 0),
        ("name_mismatch", name_issue),
        ("weak_model", weak),
        ("length_ratio", (F.length(source) >= 8) & ~ratio.between(low, high)),
        ("negation_lost", negation_lost(source, target, source_language, target_language)),
        ("question_lost", question_lost(source, target)),
        ("low_audio", audio < 0.5),
    )


def evidence_status(same_language: Column, kind: Column, agreement: Column) -> Column:
    """Status of a subtitle track against the audio's transcript."""
    return (
        F.when(~same_language & kind.isin("auto", "auto_translated"), "rejected")
        .when(~same_language, "reference")
        .when(agreement.isNull(), "unverified")
        .when(agreement < 0.3, "rejected")
        .when(agreement >= 0.6, "matches_audio")
        .otherwise("partial")
    )


def validate_transcript(segments: DataFrame) -> DataFrame:
    """One row a segment with its structural problems: id sequence, times in order, confidence in [0, 1]."""
    w = Window.partitionBy("episode_id").orderBy("pos")
    rows = segments.withColumn("_prev", F.lag("start_ms").over(w))
    return rows.withColumn(
        "problems",
        flags(
            ("id_sequence", F.col("id") != F.col("pos")),
            ("bad_times", (F.col("start_ms") < 0) | (F.col("end_ms") < F.col("start_ms"))),
            ("unordered", F.col("start_ms") < F.col("_prev")),
            ("confidence_range", ~F.coalesce(F.col("confidence").between(0, 1), F.lit(True))),
        ),
    ).drop("_prev")


def change_acceptance(rate: Column, high: Column, major_rise: Column) -> Column:
    """Decision on a change from its win rate, the interval's upper end and the rise of major errors (all shares)."""
    return F.when((high < 0.5) | (major_rise > 0.02), "reject").when((rate >= 0.5) & (high >= 0.55), "accept").otherwise("measure_again")
