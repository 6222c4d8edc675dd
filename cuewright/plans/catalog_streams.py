"""Queries over streams with state, each replayed in slices of time, with the SQL of its batch form, and over folders of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import languages
from ..operators import history, published
from ..sources import adapters as a
from ..sources import files
from ..sources import subtitles as sub
from ..streaming import jobs, state
from .catalog_runs import stage_events_of
from .oracle import catalog, sql

QUERIES, query = catalog()

HOUR = 3_600_000
#: A running job is paused after so long without an event; strikes are forgotten after so long.
SILENT_MS, FORGET_MS, LATE_MS = 12 * HOUR, 24 * HOUR, HOUR // 6
_MS = "epoch_us(ts) // 1000"


def _timed(s, d):
    return a.table(s, d, "events").withColumn("at", F.col("ts").cast("timestamp"))


def _statuses(s, d):
    return stage_events_of(_timed(s, d)).select("job_id", "seq", "status", F.timestamp_millis("at").alias("at"))


_SILENT_SQL = f"""WITH e AS (SELECT user_id AS job_id, event_id AS seq, {_MS} AS at_ms, ['running', 'completed', 'failed'][(event_id % 3 + 1)::INTEGER] AS status FROM events),
n AS (SELECT * FROM e WHERE job_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY at_ms DESC, seq DESC) = 1)
SELECT job_id, CASE WHEN status = 'running' AND at_ms + {SILENT_MS} < (SELECT max(at_ms) FROM e) - {LATE_MS} THEN 'paused' ELSE status END AS status, at_ms FROM n"""


@query("stream_silent_jobs", _SILENT_SQL)
def _(s, d):
    events = state.replayed(_statuses(s, d), "at")
    return state.run_updating(state.silent_jobs(events, SILENT_MS, "10 minutes"), "silent-jobs", ["job_id"])


@query("silent_jobs", _SILENT_SQL)
def _(s, d):
    return history.silent_jobs(_statuses(s, d), SILENT_MS, LATE_MS)


_STRIKES_SQL = f"""WITH f AS (SELECT user_id AS key, event_id AS call_id, {_MS} AS ms, ts FROM events WHERE event_type = 'error' OR value > 100),
r AS (SELECT *, sum(CASE WHEN gap > {FORGET_MS} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ms, call_id) AS run FROM (SELECT *, ms - lag(ms) OVER (PARTITION BY key ORDER BY ms, call_id) AS gap FROM f))
SELECT key, call_id, strike, CASE WHEN strike >= 3 THEN 'remove' ELSE 'cooldown_' || strike * 60 END AS action FROM (SELECT key, call_id, row_number() OVER (PARTITION BY key, run ORDER BY ms, call_id) AS strike FROM r)"""


def _failures(s, d):
    return _timed(s, d).where("event_type = 'error' or value > 100").select(F.col("user_id").alias("key"), F.col("event_id").alias("call_id"), "at")


@query("stream_strikes", _STRIKES_SQL)
def _(s, d):
    return jobs.run_appending(state.strikes(state.replayed(_failures(s, d), "at"), FORGET_MS, "10 minutes"), "strikes")


@query("strikes_forgotten", _STRIKES_SQL)
def _(s, d):
    return history.strikes(_failures(s, d), FORGET_MS).select("key", "call_id", F.col("strike").cast("long").alias("strike"), "action")


@query("stream_latency_last20", f"SELECT user_id AS model, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT * FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {_MS} DESC, event_id DESC) <= 20) GROUP BY user_id")
def _(s, d):
    calls = _timed(s, d).select(F.col("user_id").alias("model"), F.col("event_id").alias("call_id"), "at", F.col("value").alias("seconds"))
    rows = state.run_updating(state.last_latencies(state.replayed(calls, "at")), "latencies", ["model"])
    return rows.withColumn("mean", F.round("mean", 6))


@query("stream_sliding_quality", "SELECT w * 900000 AS window_ms, count(*) AS n, count(*) FILTER (WHERE value > 100) AS high FROM (SELECT value, epoch_us(ts) // 1000 AS ms FROM events WHERE value IS NOT NULL), LATERAL (SELECT unnest(generate_series((ms - 3600000) // 900000 + 1, ms // 900000)) AS w) GROUP BY w")
def _(s, d):
    events = state.replayed(_timed(s, d).select("at", "value"), "at", closing="1 day")
    return jobs.run_appending(state.sliding_quality(events), "sliding-quality")


@query("stream_speech_sessions", "SELECT user_id, count(*) AS events, min(ms) AS start_ms FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS session FROM (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 3600000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, session")
def _(s, d):
    events = state.replayed(_timed(s, d).select("user_id", "at"), "at", closing="1 day")
    return jobs.run_appending(state.speech_sessions(events), "speech-sessions")


def _directory(s, d) -> str:
    """A folder of all episodes: SubRip in UTF-8 or UTF-16, and WebVTT, written by format name."""
    files.register(s)
    at, rows = jobs.place(s, "subtitle-files"), a.lines(s, d)
    name = F.col("episode_id").cast("string").alias("name")
    srt = sub.to_srt(rows.where("episode_id % 3 < 2")).select(name, F.when(F.col("episode_id") % 3 == 0, F.encode("content", "UTF-16")).otherwise(F.encode("content", "UTF-8")).alias("content"))
    for ext, part in (("srt", srt), ("vtt", sub.to_vtt(rows.where("episode_id % 3 = 2")).select(name, "content"))):
        part.write.format("subtitles").option("extension", ext).mode("append").save(at)
    return at


_CUES = "SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY start_ms, unit_id) - 1 AS pos, greatest(start_ms, 0) AS start_ms, greatest(end_ms, 0) AS end_ms, trim(text) AS text FROM lines"


def _episodes(cues):
    return cues.where("corrupt is null").select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("episode_id"), "pos", "start_ms", "end_ms", "text")


@query("subtitle_directory", sql(_CUES, "lines"))
def _(s, d):
    return _episodes(s.read.format("subtitles").load(_directory(s, d)))


@query("subtitle_directory_any_store", sql(_CUES, "lines"))
def _(s, d):
    return _episodes(files.cues_of(s.read.format("binaryFile").option("recursiveFileLookup", "true").load(_directory(s, d))))


def _winners(payloads):
    """A stand-in for a judge: the longer text of two wins."""
    texts = [p.split("\x1f") for p in payloads]
    return ["A" if len(a) > len(b) else "B" if len(a) < len(b) else "tie" for a, b in texts]


@query("score_pairs_cached", sql("SELECT episode_id, unit_id, CASE WHEN length(source) > length(target) THEN 'A' WHEN length(source) < length(target) THEN 'B' ELSE 'tie' END AS winner FROM pairs", "pairs"))
def _(s, d):
    # A half of the pairs is judged first; the run over all of them then asks for the rest only.
    cache = jobs.place(s, "replies")
    rows = a.pairs(s, d).select("episode_id", "unit_id", F.concat_ws("\x1f", "source", "target").alias("payload"))
    key = published.request_key(F.lit("judge-1"), F.lit("v1"), "payload")
    published.with_replies(rows.where("episode_id % 2 = 0"), cache, _winners, key=key)
    return published.with_replies(rows, cache, _winners, key=key).select("episode_id", "unit_id", F.col("reply").alias("winner"))


_REPORT = "SELECT '{0}' AS report, lang || '.documents' AS metric, count(*)::DOUBLE AS value FROM documents GROUP BY lang"


@query("report_history", f"{_REPORT.format('first')} UNION ALL {_REPORT.format('second')}")
def _(s, d):
    at = jobs.place(s, "history")
    summary = a.table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("value")).select(F.concat("lang", F.lit(".documents")).alias("metric"), "value")
    for run in ("first", "second", "first"):
        published.append_report(summary, at, run)
    return published.report_history(s, at)


# Languages

_CODES = [c for codes in languages.SCRIPTS.values() for c in codes] + ["de", "en"]
_SCRIPT_CASE = " ".join(f"WHEN code IN ({', '.join(repr(c) for c in codes)}) THEN length(regexp_replace(text, '[^{''.join(chr(92) + 'p{' + x + '}' for x in names.split())}]', '', 'g'))" for names, codes in languages.SCRIPTS.items())


@query("wrong_script", rf"""WITH d AS (SELECT doc_id, text, ([{', '.join(repr(c) for c in _CODES)}])[(doc_id % {len(_CODES)} + 1)::INTEGER] AS code, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters FROM documents)
SELECT doc_id, code, coalesce(CASE WHEN letters = 0 THEN code IN ('de', 'en') AND false ELSE (CASE {_SCRIPT_CASE} END) < 0.6 * letters END, false) AS wrong FROM d""")
def _(s, d):
    code = F.get(F.array(*[F.lit(c) for c in _CODES]), (F.col("doc_id") % len(_CODES)).cast("int"))
    return a.table(s, d, "documents").select("doc_id", code.alias("code"), languages.wrong_script(F.col("text"), code).alias("wrong"))


def _negates(text, table, code):
    found = [f"WHEN {code} = '{k}' THEN len(list_intersect(words({text}), [" + ", ".join("'" + w.replace("'", "''") + "'" for w in v) + "])) > 0" for k, v in table.items() if k in ("en", "fr", "de", "es")]
    return f"CASE {' '.join(found)} END".replace(f"words({text})", f"regexp_extract_all(lower({text}), '[''0-9a-z_\\x{{DF}}-\\x{{24F}}]+')")


@query("negation_by_language", sql(f""", p AS (SELECT l.episode_id, l.unit_id, l.text AS s, b.text AS t, (['en', 'fr', 'de', 'es'])[(l.episode_id % 4 + 1)::INTEGER] AS sl, (['en', 'fr', 'de', 'es'])[(l.unit_id % 4 + 1)::INTEGER] AS tl FROM lines l JOIN lines_b b USING (episode_id, unit_id))
SELECT episode_id, unit_id, {_negates('s', languages.NEGATION_SOURCE, 'sl')} AND NOT {_negates('t', languages.NEGATION_TARGET, 'tl')} AS lost FROM p""", "lines", "lines_b"))
def _(s, d):
    b = a.lines_b(s, d).select("episode_id", "unit_id", F.col("text").alias("t"))
    code = lambda c: F.get(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.col(c) % 4).cast("int"))
    return a.lines(s, d).join(b, ["episode_id", "unit_id"]).select("episode_id", "unit_id", languages.lost_negation(F.col("text"), F.col("t"), code("episode_id"), code("unit_id")).alias("lost"))
