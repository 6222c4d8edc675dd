"""Secret scans with DataFrame expressions only.

Base patterns (leftmost, non-overlapping, per kind) give the kinds assign, access and hex.
Beyond them, candidate strings (long runs of key characters with letters and digits) are
scanned by Shannon entropy over a sliding window.  The entropy is kept by incremental
counts: the state holds the window's count of every key character as one letter of a
string; a step reads and overwrites the letters of the character that enters and of the
one that leaves, and updates sum(c log2 c); the window's entropy is log2(W) - sum / W.
Each character class (hex, alphanumeric, base64) has its own threshold.  A candidate that
the allow list knows is suppressed.  A candidate's span runs from its first window above
the threshold to the last.  Spans that a base span covers are not repeated beside the base
ones, but stand in a column of their own, with the number of suppressed candidates.

All steps are linear in the text, but for ``running``, which copies n * sqrt(n) places of n
matches; no pattern recurses, so a text of any length is scanned in bounded stack.

Places are code points, ends exclusive.  Null texts are empty; null doc_ids are kept; rows
that repeat give a row each; other columns of the documents are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: The base patterns.  Minimum lengths stand in the pattern where that cannot move a match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

WINDOW = 20
#: Key characters stand between these two codes: a place of the counts for each.
FIRST_KEY, LAST_KEY = ord("+"), ord("z")
#: A run of key characters of WINDOW or more that has a digit and a letter.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
#: Least entropy in bits of a window, by character class.
THRESHOLDS = {"hex": 2.9, "alnum": 3.5, "base64": 3.7}
#: Strings that look random but are known: marked examples, runs of the alphabet or of digits at an end, identifiers of
#: rows, dates, slugs of words.  A word of the list counts only where it stands between separators.  Quantifiers of
#: groups are possessive: others recurse for each repetition.
ALLOW = r"(?i)(?:^|[+/_=-])(?:example|sample|test|dummy|placeholder)(?:$|[+/_=-])|^(?:abcdefgh|12345678|01234567)|(?:abcdefgh|stuvwxyz|12345678|23456789)$|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[0-9_/-]*+(?<=(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2})$|^(?:/?[a-z]++[/_-])++[0-9]*+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda's variable is bound, while an expression is copied to each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, value: Callable[[Column], Column], merge: Callable[[Column, Column], Column], zero: Column) -> Column:
    """The merged values of all items before each item, as an array.

    Appending to an array copies it; so blocks of sqrt(n) items are merged first, then the
    blocks' totals run, and each block runs on from its total.
    """

    def append(start: Column, values: Column) -> Column:
        first = F.struct(start.alias("total"), F.slice(F.array(start), 1, 0).alias("out"))
        return F.aggregate(values, first, lambda s, x: F.struct(merge(s["total"], x).alias("total"), F.concat(s["out"], F.array(s["total"])).alias("out")))["out"]

    def blocked(xs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(xs))).cast("int")
        count = F.ceil(F.size(xs) / width).cast("int")
        cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(xs, k * width + 1, width))
        return let(cut, lambda blocks: F.flatten(F.zip_with(blocks, append(zero, F.transform(blocks, lambda b: F.aggregate(b, zero, merge))), lambda b, start: append(start, b))))

    return let(F.transform(items, value), lambda xs: F.when(F.size(xs) > 0, blocked(xs)).otherwise(F.slice(F.array(zero), 1, 0)))


def located(text: Column, pattern: str) -> Column:
    """Array of (start, match) of all matches: the lengths of what stands between matches give the places."""

    def places(found: Column) -> Column:
        pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("match"), F.length(m).alias("n")))
        return let(pairs, lambda p: F.zip_with(p, running(p, lambda x: x["gap"] + x["n"], lambda a, b: a + b, F.lit(0)), lambda x, before: F.struct((before + x["gap"]).alias("start"), x["match"].alias("match"), x["n"].alias("n"))))

    none = F.expr("cast(array() as array<struct<start:int,match:string,n:int>>)")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, places(found)).otherwise(none))


def spans_of(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + m["n"]).alias("end")))


def _log_term(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def entropy_span(word: Column) -> Column:
    """(lo, hi) of the windows of ``word`` at or above the threshold of its class, both -1 if none."""
    none = ord("A")  # a count of 0; W at most keeps the letters within ASCII
    zero = F.struct(F.lit(chr(none) * (LAST_KEY - FIRST_KEY + 1)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))

    def held(counts: Column, place: Column) -> Column:
        return (F.ascii(F.substring(counts, place, F.lit(1))) - none).cast("double")

    def put(counts: Column, place: Column, count: Column) -> Column:
        return F.overlay(counts, F.char((count + none).cast("long")), place)

    def came(s: Column, place: Column) -> Column:
        return let(held(s["counts"], place), lambda c: F.struct(put(s["counts"], place, c + 1).alias("counts"), (s["sum"] + _log_term(c + 1) - _log_term(c)).alias("sum")))

    def went(s: Column, place: Column) -> Column:
        return let(held(s["counts"], place), lambda c: F.struct(put(s["counts"], place, c - 1).alias("counts"), (s["sum"] + _log_term(c - 1) - _log_term(c)).alias("sum")))

    def step(s: Column, x: Column, threshold: Column) -> Column:
        def judged(window: Column) -> Column:
            n = s["n"] + 1
            hit = (n >= WINDOW) & (F.lit(math.log2(WINDOW)) - window["sum"] / WINDOW >= threshold - 1e-9)
            return let(hit, lambda h: F.struct(window["counts"].alias("counts"), window["sum"].alias("sum"), n.alias("n"), F.when(h & (s["lo"] < 0), n - WINDOW).otherwise(s["lo"]).alias("lo"), F.when(h, n).otherwise(s["hi"]).alias("hi")))

        return let(came(s, x["came"]), lambda w: let(F.when(x["went"] > 0, went(w, x["went"])).otherwise(w), judged))

    # Place of each character in the counts; the one that leaves stands WINDOW places before, 0 while the window fills.
    places = F.transform(F.split(word, ""), lambda c: F.ascii(c) - (FIRST_KEY - 1))
    steps = let(places, lambda p: F.transform(p, lambda c, i: F.struct(c.alias("came"), F.coalesce(F.get(p, i - WINDOW), F.lit(0)).alias("went"))))
    return let(threshold_of(word), lambda t: F.aggregate(steps, zero, lambda s, x: step(s, x, t), lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"))))


def threshold_of(word: Column) -> Column:
    """The threshold of the word's character class."""
    return F.when(word.rlike("^[0-9a-fA-F]+$"), F.lit(THRESHOLDS["hex"])).when(word.rlike("^[A-Za-z0-9]+$"), F.lit(THRESHOLDS["alnum"])).otherwise(F.lit(THRESHOLDS["base64"]))


def uncovered(spans: Column) -> Column:
    """The entropy spans of a sorted array that no base span covers: those that end behind every base span begun before."""
    reached = running(spans, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(F.lit(-1)), lambda a, b: F.greatest(a, b), F.lit(-1))
    pairs = F.zip_with(spans, reached, lambda s, r: F.struct(s.alias("span"), r.alias("reached")))
    return F.transform(F.filter(pairs, lambda p: (p["span"]["kind"] == 3) & (p["span"]["end"] > p["reached"])), lambda p: p["span"])


def scan(docs: DataFrame, allow: str = ALLOW) -> DataFrame:
    """(doc_id, assign, access, hex, entropy, base, windows, suppressed): arrays of (start, kind, end) for each document.

    base: the first three, sorted; windows: the entropy spans of all candidates; entropy: those of them that no base span
    covers; suppressed: number of candidates that the allow list knows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    assign = F.filter(located(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 1)) >= 12)
    def judged(found: Column) -> Column:
        asked = F.filter(found, lambda m: ~m["match"].rlike(allow))
        windows = F.transform(asked, lambda m: F.struct(m["start"].alias("start"), entropy_span(m["match"]).alias("at")))
        added = F.transform(F.filter(windows, lambda w: w["at"]["lo"] >= 0), lambda w: F.struct((w["start"] + w["at"]["lo"]).alias("start"), F.lit(3).alias("kind"), (w["start"] + w["at"]["hi"]).alias("end")))
        return F.struct(added.alias("spans"), F.filter(found, lambda m: m["match"].rlike(allow)).alias("known"))

    parts = F.struct(spans_of(assign, 0).alias("assign"), spans_of(located(text, ACCESS), 1).alias("access"), spans_of(located(text, HEX), 2).alias("hex"), let(located(text, CANDIDATE), judged).alias("added"))
    sorted_ = let(parts, lambda p: F.struct(p["assign"].alias("assign"), p["access"].alias("access"), p["hex"].alias("hex"), p["added"].alias("added"), F.sort_array(F.concat(p["assign"], p["access"], p["hex"], p["added"]["spans"])).alias("all")))
    out = let(sorted_, lambda p: F.struct(p["assign"].alias("assign"), p["access"].alias("access"), p["hex"].alias("hex"), uncovered(p["all"]).alias("entropy"), F.filter(p["all"], lambda s: s["kind"] < 3).alias("base"), p["added"]["spans"].alias("windows"), F.size(p["added"]["known"]).cast("long").alias("suppressed")))
    return rows.select("doc_id", out.alias("found")).select("doc_id", "found.assign", "found.access", "found.hex", "found.entropy", "found.base", "found.windows", "found.suppressed")


def _joined(spans: Column) -> Column:
    kind = F.array(F.lit("assign"), F.lit("access"), F.lit("hex"), F.lit("entropy"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat("base", "entropy"))).alias("spans"),
        _joined(F.col("windows")).alias("entropy_spans"),
        F.col("suppressed").alias("n_suppressed"),
    )
