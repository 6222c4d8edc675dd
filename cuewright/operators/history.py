"""Operations history: jobs, stages, timings, usage, failures and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_finished(jobs: DataFrame, n: int = 20) -> DataFrame:
    """The last n completed jobs of each machine."""
    rn = F.row_number().over(Window.partitionBy("machine").orderBy(F.desc("job_id")))
    return jobs.where("status = 'completed'").withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")


def eta_timings(jobs: DataFrame, stages: DataFrame, n: int = 20) -> DataFrame:
    """(machine, stage, jobs, median_s, median_ratio) of the last n jobs; cached stages do not count."""
    rows = last_finished(jobs, n).join(stages.where("not cached"), "job_id")
    return rows.groupBy("machine", "stage").agg(F.count("*").alias("jobs"), F.median("elapsed_s").alias("median_s"), F.round(F.median(F.col("elapsed_s") / F.greatest("media_s", F.lit(1))), 9).alias("median_ratio"))


def job_remaining(jobs: DataFrame, stages: DataFrame, n_stages: int = 7) -> DataFrame:
    """(job_id, machine, remaining_s) of jobs that are not completed: medians of the stages not yet recorded."""
    medians = eta_timings(jobs, stages)
    open_jobs = jobs.where("status <> 'completed'")
    todo = open_jobs.withColumn("stage", F.explode(F.sequence(F.lit(1), F.lit(n_stages)))).join(stages.select("job_id", "stage"), ["job_id", "stage"], "left_anti")
    joined = todo.join(medians.select("machine", "stage", "median_s"), ["machine", "stage"], "left")
    sums = joined.groupBy("job_id").agg(F.sum(F.coalesce("median_s", F.lit(0.0))).alias("remaining_s"))
    return open_jobs.select("job_id", "machine").join(sums, "job_id", "left").withColumn("remaining_s", F.coalesce("remaining_s", F.lit(0.0)))


def queue_remaining(remaining: DataFrame, parallel: int = 3) -> DataFrame:
    """(machine, jobs, total_s, queue_s): the longest job, or the total over the parallel slots, whichever is more."""
    g = remaining.groupBy("machine").agg(F.count("*").alias("jobs"), F.sum("remaining_s").alias("total_s"), F.max("remaining_s").alias("longest_s"))
    return g.select("machine", "jobs", "total_s", F.round(F.greatest("longest_s", F.col("total_s") / F.least(F.lit(parallel), F.col("jobs"))), 6).alias("queue_s"))


#: What each stage (1 to 7) waits for, and how many of it run at once.
RESOURCES = {1: "net", 3: "gpu", 4: "cpu", 6: "gpu", 7: "ai"}
CAPACITY = {"net": 2, "gpu": 1, "cpu": 1, "ai": 2}


def job_lengths(jobs: DataFrame, stages: DataFrame, n: int = 20) -> DataFrame:
    """(machine, job_ratio, job_s): medians over the last n completed jobs of a job's seconds by seconds of media, and of its seconds."""
    per = last_finished(jobs, n).join(stages, "job_id").groupBy("machine", "job_id", "media_s").agg(F.sum("elapsed_s").alias("s"))
    return per.groupBy("machine").agg(F.median(F.when(F.col("media_s") > 0, F.col("s") / F.col("media_s"))).alias("job_ratio"), F.median("s").alias("job_s"))


def remaining_split(open_jobs: DataFrame, timings: DataFrame, lengths: DataFrame) -> DataFrame:
    """(job_id, machine, stage, seconds): what is left of each job, stage by stage.

    ``open_jobs``: (job_id, machine, status, media_s, stage, fraction).  A stage takes its ratio times the media's length,
    or else its median.  Of a running job the current stage counts by the share that is left, and those after it in
    full; without a current stage nothing is known of it.  A pending job takes as long as jobs of its length do, dealt
    over the stages as they usually share it; on a machine without history of stages it is one block (null stage).
    """
    typical = F.coalesce(F.when(F.col("media_s") > 0, F.col("median_ratio") * F.col("media_s")), F.col("median_s"))
    # A machine has as many timings as there are stages.
    each = open_jobs.join(timings.select("machine", F.col("stage").alias("of"), "median_s", "median_ratio"), "machine", "left").withColumn("typical", typical)
    left = 1 - F.least(F.greatest(F.coalesce("fraction", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    running = each.where("status = 'running' and of >= stage").select("job_id", "machine", F.col("of").alias("stage"), (F.col("typical") * F.when(F.col("of") == F.col("stage"), left).otherwise(1.0)).alias("seconds"))
    known = F.sum("typical").over(Window.partitionBy("job_id"))
    total = F.coalesce(F.when(F.col("media_s") > 0, F.col("media_s") * F.col("job_ratio")), F.col("job_s"))
    waiting = each.where("status = 'pending'").join(lengths, "machine", "left").withColumn("known", known).withColumn("total", total).where("total is not null")
    share = F.when(F.coalesce("known", F.lit(0.0)) > 0, F.col("total") * F.col("typical") / F.col("known")).otherwise(F.col("total"))
    return running.unionByName(waiting.select("job_id", "machine", F.col("of").alias("stage"), share.alias("seconds"))).where("seconds is not null")


def queue_bound(split: DataFrame, parallel: int = 3, resources: dict[int, str] | None = None, capacity: dict[str, int] | None = None) -> DataFrame:
    """(machine, jobs, queue_s): the longest job, all work over the jobs that run at once, or the busiest resource by its capacity, whichever is most."""
    resources, capacity = resources or RESOURCES, capacity or CAPACITY
    per = split.groupBy("machine", "job_id").agg(F.sum("seconds").alias("s"))
    g = per.groupBy("machine").agg(F.count("*").alias("jobs"), F.sum("s").alias("total"), F.max("s").alias("longest"))
    if parallel <= 1:
        return g.select("machine", "jobs", F.round("total", 6).alias("queue_s"))
    name = F.create_map(*[F.lit(x) for kv in resources.items() for x in kv])
    slots = F.create_map(*[F.lit(x) for kv in capacity.items() for x in kv])
    busy = split.withColumn("resource", name[F.col("stage").cast("int")]).where("resource is not null").groupBy("machine", "resource").agg(F.sum("seconds").alias("s"))
    busiest = busy.groupBy("machine").agg(F.max(F.col("s") / F.greatest(F.lit(1), F.coalesce(slots[F.col("resource")], F.lit(1)))).alias("busiest"))
    bound = F.greatest("longest", F.col("total") / F.least(F.lit(parallel), F.col("jobs")), F.coalesce("busiest", F.lit(0.0)))
    return g.join(busiest, "machine", "left").select("machine", "jobs", F.round(bound, 6).alias("queue_s"))


def token_usage(calls: DataFrame) -> DataFrame:
    """(provider, model, requests, tokens) with subtotals; calls without usage count the request only."""
    return calls.rollup("provider", "model").agg(F.count("*").alias("requests"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"))


def adaptive_timeout(calls: DataFrame, base_s: float = 30.0, cap_s: float = 150.0, n: int = 20) -> DataFrame:
    """(model, timeout_s): three times the upper median of the last n reply times within [base, cap]; base under two samples."""
    rn = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("at"), F.desc("call_id")))
    last = calls.withColumn("_rn", rn).where(F.col("_rn") <= n)
    per = last.groupBy("model").agg(F.array_sort(F.collect_list("seconds")).alias("s"))  # at most n values a model
    upper = F.element_at("s", F.floor(F.size("s") / 2).cast("int") + 1)
    return per.select("model", F.when(F.size("s") < 2, F.lit(base_s)).otherwise(F.least(F.greatest(F.lit(base_s), 3 * upper), F.lit(cap_s))).alias("timeout_s"))


def cooldowns(failures: DataFrame, now_ms: int) -> DataFrame:
    """(key, until_ms, reason) still active: the latest end of each key and the reason that set it."""
    g = failures.groupBy("key").agg(F.max("until_ms").alias("until_ms"), F.max_by("reason", F.struct("until_ms", "reason")).alias("reason"))
    return g.where(F.col("until_ms") > now_ms)


def strikes(failures: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """Each failure's running number per key and what follows: a cool-down of 60 s times the number, removal at the third.

    With ``forget_ms`` (``at`` is then a timestamp) the numbers begin anew after so long without a failure.
    """
    w = Window.partitionBy("key").orderBy("at", "call_id")
    rows, keys = failures, ["key"]
    if forget_ms is not None:
        ms = F.unix_millis("at")
        rows, keys = rows.withColumn("_run", F.count_if(ms - F.lag(ms).over(w) > forget_ms).over(w)), ["key", "_run"]
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("at", "call_id"))
    out = rows.withColumn("strike", n).withColumn("action", F.when(F.col("strike") >= 3, F.lit("remove")).otherwise(F.concat(F.lit("cooldown_"), (F.col("strike") * 60).cast("string"))))
    return out.select(*failures.columns, "strike", "action")


def silent_jobs(events: DataFrame, silent_ms: int, late_ms: int) -> DataFrame:
    """(job_id, status, at_ms): each job's newest status, ``paused`` for a running one that was silent for ``silent_ms`` before the last watermark of all events."""
    newest = events.where("job_id is not null").groupBy("job_id").agg(F.max_by(F.struct("status", F.unix_millis("at").alias("at_ms")), F.struct("at", "seq")).alias("n"))
    end = events.agg(F.max(F.unix_millis("at"))).first()[0]  # one number
    stale = (F.col("n.status") == "running") & (F.col("n.at_ms") + silent_ms < F.lit((end or 0) - late_ms))
    return newest.select("job_id", F.when(stale, "paused").otherwise(F.col("n.status")).alias("status"), "n.at_ms")


def stage_status(events: DataFrame) -> DataFrame:
    """Upsert of stage events: status from the newest event, cache key and start from the newest that has one."""
    terminal = F.col("status").isin("completed", "failed", "skipped")
    newest = F.max_by(F.struct("status", "error", F.when(terminal, F.col("at")).alias("finished_at")), F.struct("at", "seq"))
    keyed = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("at", "seq")))
    return events.groupBy("job_id", "stage").agg(newest.alias("n"), keyed("cache_key").alias("cache_key"), keyed("started_at").alias("started_at")).select("job_id", "stage", "n.status", "n.error", "n.finished_at", "cache_key", "started_at")


def route_ranking(tables: DataFrame, floor: float = 78.0) -> DataFrame:
    """(key, score, rank) from (file, key, score, estimated, exclude): later files win, but an estimate never beats a measurement; estimates stay below the floor."""
    priority = F.struct((~F.coalesce("estimated", F.lit(False))).cast("int"), "file")
    best = tables.groupBy("key").agg(F.max_by(F.struct("score", "estimated"), priority).alias("b"), F.max(F.col("exclude").cast("int")).alias("x"))
    score = F.when(F.col("b.estimated"), F.least(F.col("b.score"), F.lit(floor - 0.5))).otherwise(F.col("b.score"))
    kept = best.where("x = 0").select("key", score.alias("score"))
    # A leaderboard of models: as many rows as there are models.
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "key")))


def translation_memory(rows: DataFrame) -> DataFrame:
    """One row per (series or 0, src, tgt, term): the translation of greatest confidence, uses summed."""
    g = rows.groupBy(F.coalesce("series", F.lit(0)).alias("series"), "src", "tgt", "term")
    return g.agg(F.max_by("translation", F.struct("confidence", "translation")).alias("translation"), F.least(F.greatest(F.max("confidence"), F.lit(0.0)), F.lit(1.0)).alias("confidence"), F.sum("uses").alias("uses"))
