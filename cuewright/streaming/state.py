"""Streams whose state is kept per key: silent jobs, strikes that are forgotten, last latencies, and windows in append mode.

Every stream has a batch form beside it that must give the same rows (``operators.history`` or a query of the
catalog).  Time is event time under a watermark, so that a replay gives what the live stream gave.

Keys are dealt to BUCKETS by their hash, and a bucket's keys share a call and a state (an array a column), since a call
for each key costs more than its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappush, heappushpop

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .jobs import place

#: Groups that the keys of a stream are dealt to; a live stream of very many keys takes more.
BUCKETS = 1024
#: Rows of a replayed file.
FILE_ROWS = 500_000


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_bucket")


def replayed(rows: DataFrame, at: str, slices: int = 3, closing: str | None = None) -> DataFrame:
    """``rows`` as a stream of files in order of the timestamp ``at``, one slice a batch.

    Each slice has as many files as the others, so that so many files are a batch; a small slice keeps them from being
    more than one.  With ``closing`` (an interval such as "1 day") a last row, null but for its time, comes that much after
    the others: it moves the watermark on, so that append mode gives out what is still open.
    """
    spark = rows.sparkSession
    folder = place(spark, "replay")
    ms = F.unix_millis(F.col(at))
    cuts = rows.select(ms.alias("ms")).approxQuantile("ms", [i / slices for i in range(1, slices)], 0.01) or [0.0]
    edges = [None, *cuts, None]
    inside = [F.lit(True) if lo is None and hi is None else ms <= hi if lo is None else ms > lo if hi is None else (ms > lo) & (ms <= hi) for lo, hi in zip(edges, edges[1:])]
    least = min(rows.agg(*[F.count_if(x).alias(f"n{i}") for i, x in enumerate(inside)]).first())  # one number a slice
    files = max(1, least // FILE_ROWS)
    for i, x in enumerate(inside):
        part = rows.where(x)
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.parquet(f"{folder}/slice={i}")
    if closing:
        last = rows.agg(F.max(at).alias("_last")).select((F.col("_last") + F.expr(f"interval {closing}")).alias("_last"))
        last.select(*[F.col("_last").alias(at) if f.name == at else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]).coalesce(1).write.parquet(f"{folder}/slice={len(edges)}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/slice=*")


def run_updating(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run an update-mode stream to its end and return the last row of each key.

    A batch is written under its number, so that one that runs again replaces what it wrote.
    """
    spark: SparkSession = stream.sparkSession
    at = place(spark, name)

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{at}/out/part={n}")

    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, _batch int").parquet(f"{at}/out/part=*")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "_batch").alias("_r")).select(*keys, "_r.*")


def silent_jobs(events: DataFrame, silent_ms: int, late: str) -> DataFrame:
    """Updates (job_id, status, at_ms): a job's newest status; ``paused`` once a running job has been silent for ``silent_ms``.

    ``events``: (job_id, seq, status, at timestamp).  State: time, number and status of each job's newest event, and a timer
    on event time for the running job that is due first.  Older events that come later change nothing; an event after a
    pause takes the job up again.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = {job: x for job, *x in zip(*state.get)} if state.exists else {}
        changed = {}
        for pdf in () if state.hasTimedOut else batches:
            for job, at, seq, status in zip(pdf["job_id"], pdf["at_ms"], pdf["seq"], pdf["status"]):
                at, seq = int(at), int(seq)
                if job not in newest or (at, seq) > tuple(newest[job][:2]):
                    newest[job] = [at, seq, status]
                changed[job] = True
        due = None
        for job, x in newest.items():
            if x[2] == "running":
                if x[0] + silent_ms < state.getCurrentWatermarkMs():
                    x[2] = "paused"
                    changed[job] = True
                else:
                    due = x[0] + silent_ms if due is None else min(due, x[0] + silent_ms)
        state.update((list(newest), *map(list, zip(*newest.values()))))
        if due is not None:
            state.setTimeoutTimestamp(due)
        if changed:
            yield pd.DataFrame([(job, newest[job][2], newest[job][0]) for job in changed], columns=["job_id", "status", "at_ms"])

    rows = events.where("job_id is not null").withWatermark("at", late).select(_bucket("job_id"), "job_id", "seq", "status", "at", F.unix_millis("at").alias("at_ms"))
    kind = events.schema["job_id"].dataType.simpleString()
    return rows.groupBy("_bucket").applyInPandasWithState(step, f"job_id {kind}, status string, at_ms long", f"job array<{kind}>, at array<long>, seq array<long>, status array<string>", "update", GroupStateTimeout.EventTimeTimeout)


def strikes(failures: DataFrame, forget_ms: int, late: str) -> DataFrame:
    """Rows (key, call_id, strike, action) of each failure as it comes; a key's count is forgotten ``forget_ms`` after its last failure.

    ``failures``: (key, call_id, at timestamp).  State: each key's count and the time of its last failure; a timer on event
    time drops those that are due, so that keys that behave take no room.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: x for k, *x in zip(*state.get)} if state.exists else {}
        out = []
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["at_ms", "call_id"])
            for k, call, at in zip(rows["key"], rows["call_id"], rows["at_ms"]):
                count, last = held.get(k, (0, 0))
                count = 1 if count and at - last > forget_ms else count + 1
                held[k] = (count, max(last, int(at)))
                out.append((k, call, count, "remove" if count >= 3 else f"cooldown_{60 * count}"))
        held = {k: x for k, x in held.items() if x[1] + forget_ms >= state.getCurrentWatermarkMs()}
        if held:
            state.update((list(held), *map(list, zip(*held.values()))))
            state.setTimeoutTimestamp(min(last for _, last in held.values()) + forget_ms)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "call_id", "strike", "action"])

    rows = failures.where("key is not null").withWatermark("at", late).select(_bucket("key"), "key", "call_id", "at", F.unix_millis("at").alias("at_ms"))
    key, call = (failures.schema[c].dataType.simpleString() for c in ("key", "call_id"))
    return rows.groupBy("_bucket").applyInPandasWithState(step, f"key {key}, call_id {call}, strike long, action string", f"key array<{key}>, count array<long>, last array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def last_latencies(calls: DataFrame, n: int = 20) -> DataFrame:
    """Updates (model, n, mean): number and mean of a model's last ``n`` reply times.

    ``calls``: (model, call_id, at timestamp, seconds).  State: each model's ``n`` newest calls by time; rows that come late
    are merged in, and fall out if they are older than all of them.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Heaps with the oldest call first, of which a state is the calls one after the other.
        newest: dict = {}
        for model, *call in zip(*state.get) if state.exists else ():
            heappush(newest.setdefault(model, []), tuple(call))
        changed = {}
        for pdf in batches:
            for model, at, call, seconds in zip(pdf["model"], pdf["at_ms"], pdf["call_id"], pdf["seconds"]):
                heap = newest.setdefault(model, [])
                (heappush if len(heap) < n else heappushpop)(heap, (int(at), int(call), float(seconds)))
                changed[model] = True
        state.update(tuple(map(list, zip(*((model, *call) for model, heap in newest.items() for call in heap)))))
        if changed:
            yield pd.DataFrame([(model, len(newest[model]), sum(x[2] for x in sorted(newest[model])) / len(newest[model])) for model in changed], columns=["model", "n", "mean"])

    rows = calls.where("model is not null and seconds is not null").select(_bucket("model"), "model", "call_id", F.unix_millis("at").alias("at_ms"), "seconds")
    kind = calls.schema["model"].dataType.simpleString()
    return rows.groupBy("_bucket").applyInPandasWithState(step, f"model {kind}, n long, mean double", f"model array<{kind}>, at array<long>, call array<long>, seconds array<double>", "update", GroupStateTimeout.NoTimeout)


def sliding_quality(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """(window_ms, n, high) of sliding windows with known values, each given out once the watermark has passed it.

    Rows without a value move the watermark all the same, so they are left out of the counts and not before.
    """
    rows = events.withWatermark("at", late)
    return rows.groupBy(F.window("at", width, step)).agg(F.count("value").alias("n"), F.count_if(F.col("value") > 100).alias("high")).where("n > 0").select(F.unix_millis(F.col("window.start")).alias("window_ms"), "n", "high")


def speech_sessions(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(user_id, events, start_ms) of each user's sessions, given out once the watermark has passed their gap."""
    rows = events.withWatermark("at", late)
    g = rows.groupBy("user_id", F.session_window("at", gap)).agg(F.count("*").alias("events"), F.min("at").alias("first"))
    return g.select("user_id", "events", F.unix_millis("first").alias("start_ms"))
