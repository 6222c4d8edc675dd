"""Further queries: requests and replies, aggregates of judged rows, dashboards and user-defined surfaces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.replies import block_requests, reply_items
from ..operators import checks, evaluation, names
from ..sources import adapters as a
from ..sources import subtitles as sub
from .catalog_io import _known, _named_lines
from .catalog_runs import chrf_sql
from .oracle import catalog, sql

QUERIES, query = catalog()


@query("reply_salvage", sql(r"SELECT episode_id, unit_id AS id, trim(regexp_replace(translate(text, '\"{}', '   '), '\s+', ' ', 'g')) AS text FROM lines", "lines"))
def _(s, d):
    # Replies cut off before their end: complete items are saved.
    item = F.to_json(F.struct(F.col("unit_id").alias("id"), t.squeeze(F.translate("text", '"{}', "   ")).alias("text")))
    torn = a.lines(s, d).groupBy("episode_id").agg(F.concat(F.lit('{"items": ['), F.array_join(F.sort_array(F.collect_list(item)), ","), F.lit(', {"id": 99, "te')).alias("reply"))
    return torn.select("episode_id", F.explode(reply_items(F.col("reply"))).alias("i")).select("episode_id", "i.id", "i.text")


@query("block_requests", sql("SELECT episode_id, block, count(*) AS lines, least(6, min(rn)) AS before FROM (SELECT episode_id, (row_number() OVER w - 1) // 25 AS block, row_number() OVER w - 1 AS rn FROM lines WINDOW w AS (PARTITION BY episode_id ORDER BY unit_id)) GROUP BY ALL", "lines"))
def _(s, d):
    r = block_requests(a.lines(s, d)).withColumn("j", F.from_json("payload", "previous array<string>, lines array<struct<id:bigint>>, next array<string>"))
    return r.select("episode_id", "block", F.size("j.lines").cast("long").alias("lines"), F.size("j.previous").cast("long").alias("before"))


@query("name_fix_requests", sql("SELECT episode_id, unit_id FROM lines WHERE unit_id % 2 = 0 AND unit_id % 4 <> 0", "lines"))
def _(s, d):
    # Lines whose target misses a name that stands in the source.
    rows = _named_lines(s, d)
    hits = names.source_names(rows, _known(s, d)).join(rows.select("episode_id", "unit_id", "target"), ["episode_id", "unit_id"])
    return hits.where(~F.expr("contains(target, 'Marl')")).select("episode_id", "unit_id")


@query("collect_names", sql("SELECT DISTINCT episode_id % 5 AS series, 'Marlon' || repeat('a', (episode_id % 5)::INTEGER) AS name, episode_id % 2 = 0 AS accepted FROM lines", "lines"))
def _(s, d):
    # A reported spelling with the name's sound joins the glossary; another is a rejected rendering.
    word = F.concat(F.lit("Marlon"), F.expr("repeat('a', cast(episode_id % 5 as int))"))
    said = F.when(F.col("episode_id") % 2 == 0, F.concat(F.lit("Mr. "), F.regexp_replace(word, "o", "e"))).otherwise(F.lit("Peter"))
    rows = a.lines(s, d).select(F.expr("episode_id % 5").alias("series"), word.alias("name"), t.name_tokens(said)[0].alias("said"))
    return rows.select("series", "name", (t.latin_skeleton(F.col("name")) == t.latin_skeleton(F.col("said"))).alias("accepted")).distinct()


@query("names_audit_log", sql("SELECT episode_id, unit_id, 'Marlen' || repeat('a', (episode_id % 5)::INTEGER) AS old, 'Marlon' || repeat('a', (episode_id % 5)::INTEGER) AS new FROM lines WHERE unit_id % 4 = 0", "lines"))
def _(s, d):
    rows = names.normalize_names(_named_lines(s, d), _known(s, d)).where("fixed <> target")
    first = lambda c: F.split(c, " ")[0]
    return rows.select("episode_id", "unit_id", first("target").alias("old"), first("fixed").alias("new"))


@query("double_check_requests", sql("SELECT l.episode_id, l.unit_id, l.text AS a, b.text AS b FROM lines l JOIN lines_b b USING (episode_id, unit_id) WHERE length(l.text) > 60 AND l.text <> b.text", "lines", "lines_b"))
def _(s, d):
    b = a.lines_b(s, d).select("episode_id", "unit_id", F.col("text").alias("b"))
    return a.lines(s, d).where("length(text) > 60").join(b, ["episode_id", "unit_id"]).where("text <> b").select("episode_id", "unit_id", F.col("text").alias("a"), "b")


@query("session_counts", "SELECT o_orderpriority AS series, o_orderstatus AS confidence, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def _(s, d):
    return a.table(s, d, "orders").cube(F.col("o_orderpriority").alias("series"), F.col("o_orderstatus").alias("confidence")).agg(F.count("*").alias("n"))


@query("confidence_pivot", sql("SELECT episode_id, count(*) FILTER (WHERE unit_id % 3 = 0) AS \"HIGH\", count(*) FILTER (WHERE unit_id % 3 = 1) AS \"MEDIUM\", count(*) FILTER (WHERE unit_id % 3 = 2) AS \"LOW\" FROM lines GROUP BY episode_id", "lines"))
def _(s, d):
    c = F.when(F.col("unit_id") % 3 == 0, "HIGH").when(F.col("unit_id") % 3 == 1, "MEDIUM").otherwise("LOW")
    return a.lines(s, d).withColumn("c", c).groupBy("episode_id").pivot("c", ["HIGH", "MEDIUM", "LOW"]).count().fillna(0)


@query("machine_rollup", sql("SELECT machine, status, count(*) AS jobs, sum(media_s)::BIGINT AS media_s FROM jobs GROUP BY ROLLUP (machine, status)", "jobs"))
def _(s, d):
    return a.jobs(s, d).rollup("machine", "status").agg(F.count("*").alias("jobs"), F.sum("media_s").alias("media_s"))


@query("sliding_quality", "SELECT w * 900000 AS window_ms, count(*) AS n, count(*) FILTER (WHERE value > 100) AS high FROM (SELECT value, epoch_us(ts) // 1000 AS ms FROM events), LATERAL (SELECT unnest(generate_series((ms - 3600000) // 900000 + 1, ms // 900000)) AS w) GROUP BY w")
def _(s, d):
    rows = a.table(s, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.window("at", "1 hour", "15 minutes")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 100).alias("high")).select(F.unix_millis("window.start").alias("window_ms"), "n", "high")


@query("speech_sessions", "SELECT user_id, count(*) AS events, min(ms) AS start_ms FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS session FROM (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 3600000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, session")
def _(s, d):
    rows = a.table(s, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    g = rows.groupBy("user_id", F.session_window("at", "1 hour")).agg(F.count("*").alias("events"), F.min("at").alias("first"))
    return g.select("user_id", "events", F.unix_millis("first").alias("start_ms"))


@query("parse_subtitles_udtf", sql("SELECT episode_id, count(*) AS cues, min(greatest(start_ms, 0)) AS first_ms FROM lines GROUP BY episode_id", "lines"))
def _(s, d):
    @F.udtf(returnType="pos int, start_ms long, end_ms long, text string")
    class ParseSubtitles:
        """File text -> cue rows, for lateral use in SQL."""

        def eval(self, content: str):
            for i, (b, e, x) in enumerate(sub.parse_any(content or "")):
                yield i, b, e, x

    s.udtf.register("parse_subtitles", ParseSubtitles)
    sub.to_srt(a.lines(s, d)).createOrReplaceTempView("cuewright_files")
    return s.sql("SELECT episode_id, count(*) AS cues, min(c.start_ms) AS first_ms FROM cuewright_files, LATERAL parse_subtitles(content) c GROUP BY episode_id")


@query("latency_last20", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20) GROUP BY user_id")
def _(s, d):
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return a.table(s, d, "events").withColumn("rn", rn).where("rn <= 20").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("omissions", sql("SELECT episode_id, unit_id FROM lines EXCEPT SELECT episode_id, unit_id FROM lines_b", "lines", "lines_b"))
def _(s, d):
    key = lambda df: df.select("episode_id", "unit_id")
    return key(a.lines(s, d)).exceptAll(key(a.lines_b(s, d)))


@query("judge_agreement", "WITH v AS (SELECT doc_id, quality, toxic FROM labels) SELECT quality, toxic, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM v GROUP BY quality, toxic")
def _(s, d):
    g = a.table(s, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    # Four cells: the total is one more grouped row, not a pass over the labels.
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("stage_percentiles", sql("SELECT stage, median(elapsed_s) AS p50, max(elapsed_s) AS top, round(avg(elapsed_s), 6) AS mean FROM job_stages GROUP BY stage", "job_stages"))
def _(s, d):
    return a.job_stages(s, d).groupBy("stage").agg(F.median("elapsed_s").alias("p50"), F.max("elapsed_s").alias("top"), F.round(F.avg("elapsed_s"), 6).alias("mean"))


@query("props_counts", "SELECT event_type, sum((props->>'k')::BIGINT)::BIGINT AS total, count(*) AS n FROM events GROUP BY event_type")
def _(s, d):
    return a.table(s, d, "events").groupBy("event_type").agg(F.sum(F.from_json("props", "k bigint")["k"]).alias("total"), F.count("*").alias("n"))


@query("sample_swap_is_fair", sql("SELECT count(*) AS n FROM (SELECT 1 FROM lines QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY md5('sample-1:' || episode_id || ':' || unit_id)) <= 2)", "lines"))
def _(s, d):
    return evaluation.sample_per_item(a.lines(s, d).select("episode_id", "unit_id"), "episode_id", "unit_id", 2).agg(F.count("*").alias("n"))


@query("review_after_edit", sql("SELECT episode_id, count(*) FILTER (WHERE unit_id % 5 = 0) AS approved, count(*) FILTER (WHERE unit_id % 3 <> 0 AND unit_id % 5 <> 0) AS open FROM lines GROUP BY episode_id", "lines"))
def _(s, d):
    c = checks.confidence_category(F.when(F.col("unit_id") % 3 != 0, F.array(F.lit("too_long"))).otherwise(F.array().cast("array<string>")), F.lit(None).cast("double"))
    rows = a.lines(s, d).withColumn("c", c).withColumn("approved", F.col("unit_id") % 5 == 0)
    return rows.groupBy("episode_id").agg(F.count_if("approved").alias("approved"), F.count_if((F.col("c") != "HIGH") & ~F.col("approved")).alias("open"))


@query("arabic_skeleton", sql("SELECT DISTINCT word, " + "regexp_replace(" * 10 + "translate(word, 'btdkgfsrlmnaeiou', 'BTTKGFSRLMN')" + "".join(f", '{c}+', '{c}', 'g')" for c in "BTKGFSRLMN") + " AS skeleton FROM words WHERE regexp_matches(word, '^[btdkgfsrlmnaeiou]+$')", "words"))
def _(s, d):
    # Words of the lines in Arabic letters, with a vowel mark and tatweel after each and a final teh marbuta.
    letters = F.translate("word", "btdkgfsrlmnaeiou", "بتدكگفسرلمناييوو")
    marked = F.concat(F.regexp_replace(letters, "(.)", "$1\u064e\u0640"), F.lit("ة"))
    return a.words(s, d).where(F.col("word").rlike("^[btdkgfsrlmnaeiou]+$")).select("word").distinct().select("word", t.arabic_skeleton(marked).alias("skeleton"))


@query("name_certain", sql("SELECT episode_id, unit_id, unit_id % 2 = 0 AS certain FROM lines", "lines"))
def _(s, d):
    said = F.when(F.col("unit_id") % 2 == 0, F.concat(F.lit("we saw Marlon. "), "text")).otherwise(F.concat(F.lit("Marlon came. "), F.lower("text")))
    return a.lines(s, d).select("episode_id", "unit_id", t.name_certain(said, F.lit("Marlon")).alias("certain"))


@query("needs_review", sql("SELECT episode_id, unit_id FROM lines WHERE unit_id % 3 <> 0 AND unit_id % 4 <> 1", "lines"))
def _(s, d):
    c = checks.confidence_category(F.when(F.col("unit_id") % 3 != 0, F.array(F.lit("overlap"))).otherwise(F.array().cast("array<string>")), F.lit(0.9))
    return a.lines(s, d).withColumn("c", c).where("c <> 'HIGH' and unit_id % 4 <> 1").select("episode_id", "unit_id")


@query("insertions", sql("SELECT b.episode_id, b.unit_id FROM lines_b b WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.episode_id = b.episode_id AND l.start_ms = b.start_ms)", "lines", "lines_b"))
def _(s, d):
    return a.lines_b(s, d).join(a.lines(s, d).select("episode_id", "start_ms"), ["episode_id", "start_ms"], "left_anti").select("episode_id", "unit_id")


@query("new_name_issues", sql("SELECT episode_id, unit_id, 'Marlon' || repeat('a', (episode_id % 5)::INTEGER) AS name FROM lines WHERE unit_id % 6 = 0", "lines"))
def _(s, d):
    # Issues of the new text that the old text did not have: sets of names per line, one taken from the other.
    rows, known = _named_lines(s, d), _known(s, d)
    old = rows.withColumn("target", F.col("source"))
    new = rows.withColumn("target", F.when(F.col("unit_id") % 6 == 0, F.lit("Peter")).otherwise(F.col("source")))
    key = ["episode_id", "unit_id", "name"]
    return names.name_issues(new, known).select(key).exceptAll(names.name_issues(old, known).select(key))


@query("wilson_udaf", "SELECT lang, CASE WHEN count(*) = 0 THEN 0.5 ELSE round(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) / count(*), 4) END AS rate FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def _(s, d):
    rows = a.table(s, d, "labels").join(a.table(s, d, "documents"), "doc_id")
    return rows.groupBy("lang").agg(evaluation.wilson_agg(F.col("quality") == 1).alias("w")).select("lang", "w.rate")


@query("chrf_udaf", chrf_sql("unit_id"))
def _(s, d):
    b = a.lines_b(s, d).select("episode_id", "unit_id", F.col("text").alias("other"))
    return evaluation.chrf(a.lines(s, d).join(b, ["episode_id", "unit_id"]), "unit_id", "text", "other")

