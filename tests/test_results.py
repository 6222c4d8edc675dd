"""Results of queries that SQL can't express, on the given tables against plain loops."""

from collections import defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cuewright import registry
from cuewright.functions.unicode import comparison_form
from cuewright.operators import voices
from cuewright.sources import adapters as a


@pytest.fixture(scope="module")
def runs(spark, data):
    """episode -> (lines of the first run, lines of the second) in order."""
    out = defaultdict(lambda: ([], []))
    for k, df in enumerate((a.lines(spark, data), a.lines_b(spark, data))):
        for r in df.orderBy("start_ms", "unit_id").collect():
            out[r.episode_id][k].append(r)
    return out


def ratio(x, y):
    return SequenceMatcher(None, x, y, autojunk=False).ratio()


def similar(x, y):
    x, y = comparison_form(x), comparison_form(y)
    if not x or not y:
        return float(x == y)
    return (ratio(x, y) + ratio(x.split(), y.split())) / 2


def beside(line, others):
    return " ".join(o.text for o in others if o.start_ms < line.end_ms and line.start_ms < o.end_ms)


def test_track_agreement(spark, data, runs):
    got = {r.episode_id: r.agreement for r in registry.queries()["track_agreement"](spark, data).collect()}
    assert set(got) == set(runs)
    for ep, (one, two) in runs.items():
        total = sum(max(x.end_ms - x.start_ms, 10) for x in one)
        share = sum(similar(x.text, beside(x, two)) * max(x.end_ms - x.start_ms, 10) for x in one if beside(x, two))
        assert got[ep] == pytest.approx(share / total, abs=6e-5)


def test_complete_text_from_track(spark, data, runs):
    got = {(r.episode_id, r.unit_id): (r.text, r.replaced) for r in registry.queries()["complete_text_from_track"](spark, data).collect()}
    replaced = 0
    for ep, (one, two) in runs.items():
        for x in two:
            other = beside(x, one)
            text, done = got[ep, x.unit_id]
            replaced += done
            assert text == (other if done else x.text)
            assert not done or similar(x.text, other) >= 0.6 - 1e-9
    assert 0 < replaced < len(got)


def test_word_and_character_errors(spark, data, runs):
    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, d in enumerate(y, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    pairs = defaultdict(list)
    for r in registry.queries()["align_runs"](spark, data).collect():
        pairs[r.episode_id].append((r.a_id, r.b_id))
    got = {r.episode_id: r for r in registry.queries()["wer_cer"](spark, data).collect()}
    for ep in sorted(runs)[:40]:
        one, two = ({x.unit_id: x.text for x in part} for part in runs[ep])
        both = [(one[x], two[y]) for x, y in pairs[ep] if x is not None and y is not None]
        assert (got[ep].word_errors or 0) == sum(distance(x.split(), y.split()) for x, y in both)
        assert got[ep].omissions == sum(y is None for _, y in pairs[ep]) and got[ep].insertions == sum(x is None for x, _ in pairs[ep])
        if sum(len(x) for x, _ in both) < 3000:
            assert (got[ep].char_errors or 0) == sum(distance(x, y) for x, y in both)


def test_differences_rebuild_the_second_run(spark, data, runs):
    ops = defaultdict(list)
    for r in registry.queries()["diff_runs"](spark, data).collect():
        ops[r.episode_id].append(r)
    for ep, (one, two) in runs.items():
        left, right = ([x.text for x in sorted(part, key=lambda x: x.unit_id)] for part in (one, two))
        out, i = [], 0
        for r in sorted(ops[ep], key=lambda r: (r.a_from, r.b_from)):
            out += left[i : r.a_from] + right[r.b_from : r.b_to]
            i = r.a_to
        assert out + left[i:] == right


def test_segments_are_taken_once_and_forward(spark, data):
    rows = defaultdict(list)
    for r in a.table(spark, data, "events").select("user_id", "event_id", F.expr("unix_millis(cast(ts as timestamp))").alias("s"), F.expr("unix_millis(cast(ts as timestamp)) + cast(floor(value * 60000) as bigint)").alias("e")).collect():
        rows[r.user_id].append((r.s, r.event_id, r.e))
    want = set()
    for user, own in rows.items():
        reached = -1
        for s, seg, e in sorted(own):
            if e > reached:
                reached = e
                want.add((user, seg))
    got = {(r.episode_id, r.seg_id) for r in registry.queries()["stream_segments"](spark, data).collect()}
    assert got == want


def test_planned_windows_are_cut_in_pauses(spark):
    speech, t = [], 0
    for i in range(900):  # 45 minutes: 2.5 s of speech, half a second of rest, and a long rest now and then
        speech.append((1, t, t + 2500))
        t += 3000 if i % 97 else 9000
    got = voices.plan_windows(spark.createDataFrame(speech, "episode_id long, start_ms long, end_ms long")).orderBy("window").collect()
    assert got[0].start_ms == 0 and got[-1].end_ms == speech[-1][2] and len(got) > 3
    for x, y in zip(got, got[1:]):
        assert x.end_ms == y.start_ms and abs(x.end_ms - x.start_ms - 600_000) <= 45_000
        inside = [(s, e) for _, s, e in speech if s < x.end_ms < e]
        assert not inside
    assert got[-1].end_ms - got[-1].start_ms <= 660_000


def test_voices_take_speech_until_they_have_enough(spark, data):
    voices_of = defaultdict(list)
    for r in a.turns(spark, data).select("episode_id", "speaker", "turn_id", F.expr("end_ms - start_ms").alias("ms")).collect():
        voices_of[r.episode_id, r.speaker].append((-r.ms, r.turn_id))
    want, some = set(), 0
    for (ep, _), own in voices_of.items():
        total = 0
        for n, (ms, turn) in enumerate(sorted(own)):
            if total < 20_000_000:
                want.add((ep, turn))
                some += n > 0
            total -= ms
    assert some and {(r.episode_id, r.turn_id) for r in registry.queries()["embedding_speech_pick"](spark, data).collect()} == want
