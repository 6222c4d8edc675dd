"""Streams with state against their batch forms, over several batches of random events."""

import datetime
import pathlib
import random
import re

from pyspark.sql import functions as F

from cuewright.operators import history
from cuewright.streaming import jobs, state

HOUR = 3_600_000
START = datetime.datetime(2024, 5, 1)


def at(ms):
    return START + datetime.timedelta(milliseconds=ms)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_silent_jobs_are_paused_and_taken_up_again(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *"abcdefgh"]), i, rng.choice(["running", "running", "completed"]), at(i * 40 * 60_000 + rng.randrange(60_000))) for i in range(120)]
    rows += [("back", 500, "running", at(0)), ("back", 501, "completed", at(70 * HOUR)), ("gone", 502, "running", at(1))]
    events = spark.createDataFrame(rows, "job_id string, seq long, status string, at timestamp")
    got = state.run_updating(state.silent_jobs(state.replayed(events, "at", 4), 6 * HOUR, "10 minutes"), "t-silent", ["job_id"])
    want = history.silent_jobs(events, 6 * HOUR, HOUR // 6)
    assert rows_of(got.select("job_id", "status", "at_ms")) == rows_of(want.select("job_id", "status", "at_ms"))
    named = {r["job_id"]: r["status"] for r in want.collect()}
    assert named["gone"] == "paused" and named["back"] == "completed"


def test_strikes_are_forgotten(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 3]), i, at(t)) for i, t in enumerate(sorted(rng.randrange(200 * HOUR) for _ in range(60)))]
    failures = spark.createDataFrame(rows, "key long, call_id long, at timestamp")
    got = jobs.run_appending(state.strikes(state.replayed(failures, "at", 5), 5 * HOUR, "1 hour"), "t-strikes")
    want = history.strikes(failures.where("key is not null"), 5 * HOUR).select("key", "call_id", F.col("strike").cast("long"), "action")
    assert rows_of(got) == rows_of(want)
    assert {r["strike"] for r in want.collect()} >= {1, 2, 3}


def test_latencies_of_rows_that_come_late(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["m", "n", None]), i, at(rng.randrange(HOUR)), at(i), rng.choice([None, 0.5, 1.25, 3.0])) for i in range(150)]
    calls = spark.createDataFrame(rows, "model string, call_id long, at timestamp, came timestamp, seconds double")
    got = {r["model"]: (r["n"], r["mean"]) for r in state.run_updating(state.last_latencies(state.replayed(calls, "came", 5), 20), "t-latency", ["model"]).collect()}
    for model in ("m", "n"):
        last = sorted((a, c, s) for k, c, a, _, s in rows if k == model and s is not None)[-20:]
        assert got[model] == (len(last), sum(x[2] for x in last) / len(last))
    assert set(got) == {"m", "n"}


def test_windows_and_sessions_in_append_mode(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2]), at(rng.randrange(40 * HOUR)), rng.choice([None, 50.0, 150.0])) for _ in range(120)]
    events = spark.createDataFrame(rows, "user_id long, at timestamp, value double")
    sliding = jobs.run_appending(state.sliding_quality(state.replayed(events, "at", 3, "1 day")), "t-sliding")
    batch = events.where("value is not null").groupBy(F.window("at", "1 hour", "15 minutes")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 100).alias("high"))
    assert rows_of(sliding) == rows_of(batch.select(F.unix_millis("window.start"), "n", "high"))
    sessions = jobs.run_appending(state.speech_sessions(state.replayed(events, "at", 3, "1 day")), "t-sessions")
    batch = events.groupBy("user_id", F.session_window("at", "1 hour")).agg(F.count("*").alias("events"), F.min("at").alias("first"))
    assert rows_of(sessions) == rows_of(batch.select("user_id", "events", F.unix_millis("first")))


def test_keys_share_calls_and_slices_share_files(spark, monkeypatch):
    monkeypatch.setattr(state, "BUCKETS", 4)
    monkeypatch.setattr(state, "FILE_ROWS", 300)
    rng = random.Random(5)
    times = sorted(rng.randrange(400 * HOUR) for _ in range(3000))
    rows = [(rng.randrange(200), i, rng.choice(["running", "completed"]), at(t), rng.choice([0.5, 1.25])) for i, t in enumerate(times)]
    events = spark.createDataFrame(rows, "job_id long, seq long, status string, at timestamp, seconds double")
    stream = state.replayed(events.drop("seconds"), "at", 3)
    files = [[f.name for f in pathlib.Path(d).glob("*.parquet")] for d in sorted({str(pathlib.Path(x).parent).removeprefix("file:") for x in spark.read.parquet(replay_of(stream)).inputFiles()})]
    assert {len(f) for f in files} == {3}
    got = state.run_updating(state.silent_jobs(stream, 6 * HOUR, "10 minutes"), "t-silent", ["job_id"])
    assert rows_of(got.select("job_id", "status", "at_ms")) == rows_of(history.silent_jobs(events, 6 * HOUR, HOUR // 6).select("job_id", "status", "at_ms"))
    failures = events.select(F.col("job_id").alias("key"), F.col("seq").alias("call_id"), "at")
    grouped = state.strikes(state.replayed(failures, "at", 3), 30 * HOUR, "1 hour")
    assert rows_of(jobs.run_appending(grouped, "t-strikes")) == rows_of(history.strikes(failures, 30 * HOUR).select("key", "call_id", F.col("strike").cast("long"), "action"))
    assert "[_bucket" in grouped._jdf.queryExecution().analyzed().toString()
    calls = events.select(F.col("job_id").alias("model"), F.col("seq").alias("call_id"), "at", "seconds")
    got = {r["model"]: (r["n"], r["mean"]) for r in state.run_updating(state.last_latencies(state.replayed(calls, "at", 3), 7), "t-latency", ["model"]).collect()}
    own = {k: [r[4] for r in rows if r[0] == k][-7:] for k in {r[0] for r in rows}}
    assert got == {k: (len(x), sum(x) / len(x)) for k, x in own.items()}


def replay_of(stream):
    """The folder that a replayed stream reads."""
    text = stream._jdf.queryExecution().analyzed().toString() + stream._jdf.queryExecution().logical().toString()
    return re.search(r"(/\S*?/replay-[0-9a-f]+)", text)[1]
