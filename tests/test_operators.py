"""Operators on literal rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cuewright.functions import text as t
from cuewright.functions.layout import dialogue, wrapped
from cuewright.functions.titles import parse_title
from cuewright.functions.unicode import comparison_form, similarity
from cuewright.operators import checks, evaluation, joins, timing, voices
from cuewright.sources import subtitles as sub


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()[0]


def test_timestamps(spark):
    assert one(spark, 3723004, t.format_timestamp, "long") == "01:02:03,004"
    assert one(spark, -5, t.format_timestamp, "long") == "00:00:00,000"
    assert one(spark, 360000000, t.format_timestamp, "long") == "100:00:00,000"
    assert one(spark, "01:02:03.004", t.parse_timestamp) == 3723004
    assert one(spark, "1:02", t.parse_timestamp) is None


def test_arabic_rules(spark):
    assert one(spark, "مرحبا, كيف?", t.arabic_fix) == "مرحبا، كيف؟"
    assert one(spark, "١٢٣ ...", t.arabic_fix) == "123…"
    assert one(spark, "السعر 1,000", t.arabic_fix) == "السعر 1,000"
    flags = one(spark, "مرحبا  Hello?", lambda c: t.language_check(c, True))
    assert flags == ["extra_whitespace", "latin_punctuation", "latin_words"]
    assert one(spark, "NATO", lambda c: t.language_check(c, True)) == []


def test_mark_rtl_is_idempotent(spark):
    once = one(spark, "أ\nب", t.mark_rtl)
    assert once == "‏أ‏\n‏ب‏"
    assert one(spark, once, t.mark_rtl) == once


def wrap(spark, texts, width=42, lines=2, language="en"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    return [r.y for r in df.select("i", wrapped("x", F.lit(language), width, lines).alias("y")).orderBy("i").collect()]


def test_wrap_keeps_words(spark):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abc,.") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    for text, out in zip(texts, wrap(spark, texts, 20)):
        assert out.split() == text.split() and out.count("\n") <= 1
        # No other place leaves less beyond the limit.
        over = lambda x: sum(max(0, len(part) - 20) for part in x.split("\n"))
        words = text.split()
        assert over(out) == min([over(" ".join(words[:i]) + "\n" + " ".join(words[i:])) for i in range(1, len(words))] + [over(text)] * (len(words) == 1 or len(text) <= 20))


def test_wrap_places(spark):
    assert wrap(spark, ["I went to the market, and then I came home again"], 30)[0].split("\n")[0].endswith(",")
    assert wrap(spark, ["own\nbreaks", "a\nb\nc", "", "word", "x" * 60]) == ["own\nbreaks", "a b c", "", "word", "x" * 60]
    assert wrap(spark, ["They sat in the house of the old man there"], 30)[0].split("\n")[0].split()[-1] not in ("the", "of", "in")
    assert wrap(spark, ["one two three four five six seven eight nine ten"], 20, 1) == ["one two three four five six seven eight nine ten"]
    assert wrap(spark, [None]) == [None]


def test_dialogue_lines(spark):
    df = spark.createDataFrame([("Hello there. I am fine",), ("word",), ("a\nb c",)], "x string")
    assert [r[0] for r in df.select(dialogue("x", F.lit(0.5))).collect()] == ["- Hello there.\n- I am fine", "word", "a\nb c"]


def test_word_distance(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    rng = random.Random(2)
    pairs = [tuple(" ".join(rng.choice("the a café b 日本 x1").strip() or "z" for _ in range(rng.randrange(15))) for _ in range(2)) for _ in range(200)] + [("", ""), ("", "a b"), (" ".join(map(str, range(3000))), " ".join(map(str, range(5, 3000))))]
    got = spark.createDataFrame(pairs, "a string, b string").select(evaluation.word_distance("a", "b")).collect()
    assert [r[0] for r in got] == [distance(a.split(), b.split()) for a, b in pairs]


def test_build_units(spark):
    rows = [(0, 1500, "Seni orada"), (1700, 3000, "gordum."), (3200, 4000, "Evet"), (5000, 6000, "ama"), (6100, 9000, " "), (6200, 7000, "x" * 80), (7100, 12500, "late")]
    out = timing.build_units(cues(spark, rows)).orderBy("unit_id").collect()
    assert [(r.unit_id, r.start_ms, r.end_ms, r.segment_ids) for r in out] == [(0, 0, 3000, [0, 1]), (1, 3200, 4000, [2]), (2, 5000, 7000, [3, 5]), (3, 7100, 12500, [6])]
    assert out[0].text == "Seni orada gordum."


def test_collapse_rolling(spark):
    rows = [(0, 1000, "hello there"), (1000, 2000, "hello there\ngeneral kenobi"), (2000, 2030, "hello there\ngeneral kenobi\nshort"), (2030, 3000, "general kenobi"), (3000, 4000, "general kenobi\n>> [music]"), (4000, 4500, "")]
    out = timing.collapse_rolling(cues(spark, rows)).orderBy("start_ms").collect()
    assert [(r.unit_id, r.start_ms, r.end_ms, r.text) for r in out] == [(0, 0, 1000, "hello there"), (1, 1000, 3000, "general kenobi"), (4, 3000, 4000, ">> [music]")]


def test_segments_are_cut_at_the_best_places():
    """Against a plain search for the greatest weight and balance, span by span."""
    rng = random.Random(9)
    for _ in range(200):
        words = [rng.choice(["one", "two,", "three.", "eleven", "x"]) for _ in range(rng.randrange(1, 70))]
        starts, t = [], 0
        ends = []
        for w in words:
            starts.append(t)
            t += 60 * len(w)
            ends.append(t)
            t += rng.choice([0, 0, 0, 400, 1600])
        fits = lambda lo, hi: len(" ".join(words[lo:hi])) <= 84 and ends[hi - 1] - starts[lo] <= 6500

        def pieces(lo, hi):
            if hi - lo < 2 or fits(lo, hi):
                return [lo]
            total = sum(map(len, words[lo:hi]))
            score = lambda i: (3 if words[i - 1][-1] in ".!?" else 2 if words[i - 1][-1] in ",;:" else int(starts[i] - ends[i - 1] >= 350)) + 1 - abs(sum(map(len, words[lo:i])) / total - 0.5) * 2  # noqa: B023, E731
            at = max(range(lo + 1, hi), key=score)
            return pieces(lo, at) + pieces(at, hi)

        got = timing.cut_places(words, starts, ends, 84, 6500, -1)
        assert got == pieces(0, len(words)) or sum(fits(a, b) for a, b in zip(got, [*got[1:], len(words)])) == len(got)
        joined = timing.cut_places(words, starts, ends, 84, 6500, 1500)
        assert set(joined) <= set(got) and all(fits(a, b) or b - a == 1 for a, b in zip(joined, [*joined[1:], len(words)]))
        # What stays apart is either too far off or would not fit.
        assert all(starts[b] - ends[b - 1] > 1500 or not fits(a, next(x for x in [*got, len(words)] if x > b)) for a, b in zip(joined, joined[1:]))


def test_similarity():
    assert comparison_form("Éà ß!") == "ea ss"
    assert similarity("", "") == 1.0 and similarity("a", "") == 0.0
    assert similarity("hello world", "Hello, world!") == 1.0


def test_titles(spark):
    df = spark.createDataFrame([("Show S01E02 - The end",), ("Show 3x04",), ("Show 12. Bölüm",), ("Plain",)], "x string")
    got = [tuple(r.p) for r in df.select(parse_title(F.col("x")).alias("p")).collect()]
    assert got == [("Show", 1, 2, "The end"), ("Show", 3, 4, None), ("Show", None, 12, None), ("Plain", None, None, None)]


def cues(spark, rows):
    return spark.createDataFrame([(1, i, *r, None) for i, r in enumerate(rows)], "episode_id long, unit_id long, start_ms long, end_ms long, text string, speaker string")


def test_fix_overlaps(spark):
    out = timing.fix_overlaps(cues(spark, [(2000, 5000, "a"), (0, 3000, "b"), (4000, 4500, "c")])).orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms) for r in out] == [(0, 2000), (2000, 4000), (4000, 4500)]


def test_polish_extends_and_caps():
    out = timing.polish([[0, 0, 300, "a", None, []], [1, 500, 1000, "b", None, []], [2, 3000, 20000, "c", None, []]], fix_speed=False)
    assert [(r[1], r[2]) for r in out] == [(0, 417), (500, 1333), (3000, 10000)]


def test_polish_merges_fast_cue():
    out = timing.polish([[0, 0, 1000, "hello there", "S1", []], [1, 1100, 3100, "x" * 36, "S1", []], [2, 3200, 5000, "next", "S2", []]])
    assert len(out) == 2 and out[0][0] == 0 and out[0][5] == [1]
    # Another voice, or a long neighbour, is not merged.
    assert len(timing.polish([[0, 0, 1000, "hello", "S2", []], [1, 1100, 3100, "x" * 36, "S1", []], [2, 3200, 5000, "y", "S2", []]])) == 3
    assert len(timing.polish([[0, 0, 1000, "w" * 60, "S1", []], [1, 1100, 3100, "x" * 36, "S1", []]])) == 2


def test_polish_starts_earlier_into_free_time():
    out = timing.polish([[0, 5000, 6000, "x" * 20, None, []], [1, 6090, 8000, "y" * 10, None, []]])
    assert 4500 <= out[0][1] < 5000


def test_snap_frames(spark):
    out = timing.snap_frames(cues(spark, [(13, 1007, "a"), (1010, 2000, "b")])).orderBy("start_ms").collect()
    assert all(r.start_ms % 40 == 0 and r.end_ms % 40 == 0 for r in out)
    assert out[1].start_ms - out[0].end_ms >= 80


def test_check_cues(spark):
    rows = [(0, 0, "a"), (100, 300, "b"), (200, 9000, "x" * 50), (9100, 9950, ""), (10000, 11000, "a\nb\nc"), (11100, 12000, "a\nb\nc")]
    got = {r.unit_id: r.qa_flags for r in checks.check_cues(cues(spark, rows)).collect()}
    assert got[0] == ["invalid_timing"]
    assert got[1] == ["too_short"]
    assert got[2] == ["overlap", "too_long", "line_too_long"]
    assert got[3] == ["empty_cue"]
    assert got[4] == ["too_many_lines"]
    assert got[5] == ["too_many_lines", "duplicate_cue"]


@pytest.mark.parametrize("flags,audio,want", [([], None, "HIGH"), (["tatweel"], None, "HIGH"), (["too_long"], None, "MEDIUM"), (["overlap"], 0.9, "LOW"), ([], 0.6, "MEDIUM"), ([], 0.4, "LOW")])
def test_confidence(spark, flags, audio, want):
    df = spark.createDataFrame([(flags, audio)], "f array<string>, a double")
    assert df.select(checks.confidence_category(F.col("f"), F.col("a"))).first()[0] == want


def test_hallucinations(spark):
    def reason(text, ns=None, lp=None, cr=None):
        return spark.createDataFrame([(text, ns, lp, cr)], "t string, n double, l double, c double").select(checks.hallucination_reason(*map(F.col, "tnlc"))).first()[0]

    assert reason("♪♪") == "no words"
    assert reason("Thanks for watching!") == "known non-speech phrase"
    assert reason("Subtitles by Ann Smith") == "known non-speech phrase"
    assert reason("Subtitles by tomorrow, okay?") is None
    assert reason("evet " * 9) == "repetition"
    assert reason("I mean I mean I mean I mean") == "repetition"
    assert reason("no, no, no, no, no!") is None
    assert reason("hello", 0.7, -1.2) == "probably not speech"


def test_low_confidence(spark):
    low = lambda p: one(spark, p, checks.low_confidence_words, "array<double>")
    assert low([0.9, 0.2, 0.2, 0.2, 0.9]) is True
    assert low([0.9, 0.2, 0.2, 0.9]) is False
    assert low([]) is False and low([None, 0.9]) is False


def test_align_is_one_to_one(spark):
    a = cues(spark, [(0, 1000, "x"), (1000, 2000, "y"), (5000, 6000, "z")])
    b = cues(spark, [(100, 1100, "x"), (1200, 1900, "y"), (9000, 9500, "w")])
    got = {(r.a_id, r.b_id) for r in joins.align_runs(a, b).collect()}
    assert got == {(0, 0), (1, 1), (2, None), (None, 2)}


def test_overlap_join_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = [(i % 3, i, s, s + rng.randint(1, 5000)) for i in range(60) for s in [rng.randint(0, 20000)]]
    df = spark.createDataFrame(rows, "episode_id long, unit_id long, start_ms long, end_ms long")
    want = {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and y[2] < x[3] and y[3] > x[2]}
    for n in (1, 4, 16):
        got = [(r.unit_id, r.r_unit_id) for r in joins.overlap_join(df.repartition(n), df, bucket_ms=700).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_link_speakers(spark):
    rows = [(1, 0, 0, [1.0, 0.0]), (1, 0, 1, [0.0, 1.0]), (1, 1, 0, [0.1, 1.0]), (1, 1, 1, [1.0, 0.1]), (1, 1, 2, None)]
    out = voices.link_speakers(spark.createDataFrame(rows, "episode_id long, window int, local int, vector array<double>")).orderBy("window", "local").collect()
    assert [r.speaker for r in out] == [0, 1, 1, 0, 2]


def test_srt_is_lenient():
    text = "﻿1\r\n00:00:01,000 --> 00:00:02,500 X1\r\nA\r\n2\r\n00:00:03.000 --> 00:00:04,000\r\nB\r\nb\r\n\r\n\r\n00:00:05,000 --> 00:00:06,000\r\nC"
    assert sub.parse_srt(text) == [(1000, 2500, "A"), (3000, 4000, "B\nb"), (5000, 6000, "C")]


def test_vtt():
    text = "WEBVTT\n\n00:01.000 --> 00:02.000\n<c>hello</c> &amp; you\n \nmore\n\n01:00:00.000 --> 01:00:01.000\nlast"
    assert sub.parse_any(text) == [(1000, 2000, "hello & you\nmore"), (3600000, 3601000, "last")]


def test_decoding():
    assert sub.decode("şğı".encode("cp1254"), "tr") == "şğı"
    assert sub.decode("a".encode("utf-16")) == "a"
    assert sub.decode(b"\xef\xbb\xbfa") == "a"
    assert sub.decode("é".encode("latin-1")) == "é"


def test_bad_archives_give_no_row(spark):
    df = spark.createDataFrame([("x", bytearray(b"no zip")), ("y", None)], "path string, content binary")
    assert sub.read_archives(df).count() == 0


def test_jsonl_stops_at_damage(spark):
    df = spark.createDataFrame([("a", '{"x":1}\n{"x":2}\n{"x"\n{"x":3}\n'), ("b", '{"x":1}\n{"x":2}'), ("c", "")], "path string, content string")
    assert sorted((r.path, r.pos) for r in sub.jsonl_prefix(df).collect()) == [("a", 0), ("a", 1), ("b", 0)]


def test_loops_are_those_of_the_patterns(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 4)) + rng.choices("ab", k=rng.randint(1, 5)) * rng.randint(1, 9) + rng.choices("abc", k=rng.randint(0, 4))) for _ in range(1500)]

    def loop(text):
        for size, need in ((1, 8), (2, 4), (3, 4), (4, 4)):
            m = re.search(rf"(?:^| )(\S+{r' \S+' * (size - 1)})(?: \1(?= |$)){{{need - 1},}}", text)
            if m and 10 * len(m[0].split()) >= 8 * len(text.split()):
                return True
        return False

    df = spark.createDataFrame([*((t,) for t in texts), (None,), ("",)], "t string")
    got = df.select("t", checks.is_loop(F.col("t")).alias("x")).collect()
    assert {(r.t, r.x) for r in got} == {(t, loop(t)) for t in texts} | {(None, None), ("", False)}
    assert 100 < sum(map(loop, texts)) < 1400


def test_words_of_a_text_are_made_once(spark):
    df = spark.createDataFrame([("x", 0.1, 0.1, 0.1)], "t string, n double, l double, c double").select("t", checks.hallucination_reason(*map(F.col, "tnlc")))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") < 3


def paired_by_hand(left, right):
    """The greedy pairing of one episode, each line of the first run against all of the second."""
    used, out = set(), []
    right = sorted(right)
    for s, u, e in sorted(left):
        best, partner = 0, None
        for i, (rs, _, re_) in enumerate(right):
            if i not in used and min(e, re_) - max(s, rs) > best:
                best, partner = min(e, re_) - max(s, rs), i
        used.add(partner)
        out.append((u, None if partner is None else right[partner][1]))
    return out + [(None, r[1]) for i, r in enumerate(right) if i not in used]


def test_alignment_is_one_pass_over_all_episodes(spark):
    rng = random.Random(11)
    # Lines of any length, empty and backward ones too, in an order that is not that of their numbers.
    make = lambda: [(ep, u, s, s + rng.choice([0, -5, 1, 10, 40, 200])) for ep in range(60) for u in rng.sample(range(40), rng.randint(0, 25)) for s in [rng.randrange(150)]]
    one, two = make(), make()
    a, b = (spark.createDataFrame(x, "episode_id long, unit_id long, start_ms long, end_ms long") for x in (one, two))
    df = joins.align_runs(a, b)
    got = sorted(((r.episode_id, r.a_id, r.b_id) for r in df.collect()), key=str)
    want = [(ep, *p) for ep in range(60) for p in paired_by_hand(*([(s, u, e) for k, u, s, e in x if k == ep] for x in (one, two)))]
    assert got == sorted(want, key=str) and sum(None not in x for x in want) > 100
    assert "CoGroup" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_errors_of_words_and_characters_leave_out_what_is_equal(spark, monkeypatch):
    line = [(1, 0, 0, 5000, "x" * 3000 + " left"), (1, 1, 6000, 9000, "same"), (2, 0, 0, 900, "a\U0001f600 b")]
    other = [(1, 0, 0, 5000, "x" * 3000 + " rift"), (1, 1, 6000, 9000, "same"), (2, 0, 0, 900, "a b")]
    schema = "episode_id long, unit_id long, start_ms long, end_ms long, text string"
    df = evaluation.wer_cer(spark.createDataFrame(line, schema), spark.createDataFrame(other, schema))
    assert {r.episode_id: (r.word_errors, r.words, r.char_errors, r.chars) for r in df.collect()} == {1: (1, 3, 2, 3009), 2: (1, 2, 1, 4)}
    assert "levenshtein" not in df._jdf.queryExecution().optimizedPlan().toString()
