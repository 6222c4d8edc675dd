"""Queries over text functions and per-line checks, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.layout import dialogue, wrapped
from ..functions.unicode import norm_cmp, text_similarity
from ..operators import checks, selection, timing
from ..sources import adapters as a
from .oracle import catalog, sql

_J = lambda c: F.array_join(c, ",")

QUERIES, query = catalog()




_STAMP = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@query("format_timestamp", sql("SELECT episode_id, unit_id, " + _STAMP.format("greatest(start_ms, 0)") + " AS stamp FROM lines", "lines"))
def _(s, d):
    return a.lines(s, d).select("episode_id", "unit_id", t.format_timestamp(F.col("start_ms")).alias("stamp"))


@query("parse_timestamp", sql("SELECT episode_id, unit_id, greatest(end_ms, 0) AS ms, NULL::BIGINT AS bad FROM lines", "lines"))
def _(s, d):
    stamp = t.format_timestamp(F.col("end_ms"))
    return a.lines(s, d).select("episode_id", "unit_id", t.parse_timestamp(stamp).alias("ms"), t.parse_timestamp(F.concat(stamp, F.lit("x"))).alias("bad"))


@query("format_eta", sql("SELECT episode_id, unit_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS eta FROM (SELECT *, greatest(end_ms // 100, 0) AS s FROM lines)", "lines"))
def _(s, d):
    return a.lines(s, d).select("episode_id", "unit_id", t.format_eta(F.expr("end_ms div 100")).alias("eta"))


@query("norm_cmp", r"SELECT doc_id, trim(regexp_replace(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[^\p{L}\p{N}]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM documents")
def _(s, d):
    return a.table(s, d, "documents").select("doc_id", norm_cmp("text").alias("norm"))


@query("norm_words", r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM documents")
def _(s, d):
    return a.table(s, d, "documents").select("doc_id", t.norm_words(F.col("text"), F.col("lang")).alias("norm"))


@query("text_similarity")
def _(s, d):
    return a.pairs(s, d).select("episode_id", "unit_id", F.round(text_similarity("source", "target"), 6).alias("similarity"))


@query("script_ratio", r"SELECT doc_id, CASE WHEN n = 0 THEN 1.0 ELSE round(latin / n, 9) END AS ratio FROM (SELECT doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g'))::DOUBLE AS n, length(regexp_replace(text, '[^\p{Latin}]', '', 'g'))::DOUBLE AS latin FROM documents)")
def _(s, d):
    return a.table(s, d, "documents").select("doc_id", F.round(t.script_ratio(F.col("text")), 9).alias("ratio"))


@query("numbers_in", r"SELECT doc_id, array_to_string(list_sort(regexp_extract_all(text, '\d+')), ',') AS numbers FROM documents")
def _(s, d):
    return a.table(s, d, "documents").select("doc_id", _J(t.numbers_in(F.col("text"))).alias("numbers"))


@query("language_fix", r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), x -> trim(regexp_replace(x, '\s+', ' ', 'g'))), x -> x <> ''), chr(10)) AS fixed FROM documents")
def _(s, d):
    return a.table(s, d, "documents").select("doc_id", t.language_fix(F.col("text")).alias("fixed"))


@query("arabic_fix")
def _(s, d):
    return a.table(s, d, "documents").select("doc_id", t.arabic_fix(F.col("text")).alias("fixed"), _J(t.language_check(F.col("text"), arabic=True)).alias("flags"))


@query("language_check", r"SELECT doc_id, CASE WHEN contains(text, chr(10) || chr(10)) OR len(list_filter(string_split(text, chr(10)), x -> x <> trim(regexp_replace(x, '\s+', ' ', 'g')))) > 0 THEN 'extra_whitespace' ELSE '' END AS flags FROM documents")
def _(s, d):
    return a.table(s, d, "documents").select("doc_id", _J(t.language_check(F.col("text"))).alias("flags"))


@query("mark_rtl", "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), x -> chr(8207) || x || chr(8207)), chr(10)) AS marked FROM documents")
def _(s, d):
    # Marking twice gives what marking once gives.
    return a.table(s, d, "documents").select("doc_id", t.mark_rtl(t.mark_rtl(F.col("text"))).alias("marked"))


@query("wrap_text")
def _(s, d):
    return a.lines(s, d).select("episode_id", "unit_id", wrapped("text", F.lit("en")).alias("wrapped"))


@query("wrap_keeps_words", sql(r"SELECT episode_id, unit_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS words FROM lines", "lines"))
def _(s, d):
    return a.lines(s, d).select("episode_id", "unit_id", t.squeeze(wrapped("text", F.lit("de"))).alias("words"))


@query("dialogue_text")
def _(s, d):
    return a.lines(s, d).select("episode_id", "unit_id", dialogue(t.squeeze(F.col("text")), F.expr("0.15D + (unit_id % 8) / 10.0D")).alias("dialogue"))


@query("max_chars", sql("SELECT episode_id, unit_id, greatest(12, least((end_ms - start_ms) * 17 // 1000, 84))::INTEGER AS budget FROM lines", "lines"))
def _(s, d):
    return a.lines(s, d).select("episode_id", "unit_id", t.max_chars(F.col("end_ms") - F.col("start_ms"), F.lit(17), F.lit(42)).alias("budget"))


@query("qa_limits", "SELECT doc_id, CASE lang WHEN 'fr' THEN 17 WHEN 'en' THEN 17 WHEN 'de' THEN 17 WHEN 'es' THEN 17 ELSE 17 END AS cps, 42 AS max_line, 833 AS min_ms FROM documents")
def _(s, d):
    guide = s.createDataFrame([(k, *v) for k, v in checks.GUIDES.items()], "base string, cps int, max_line int, min_ms int")
    base = F.lower(F.split(F.concat(F.col("lang"), F.lit("-X")), "[-_]")[0])
    g = checks.GENERIC
    # The guide has a row per language: a fixed, small table.
    return a.table(s, d, "documents").withColumn("base", base).join(F.broadcast(guide), "base", "left").select("doc_id", F.coalesce("cps", F.lit(g[0])).alias("cps"), F.coalesce("max_line", F.lit(g[1])).alias("max_line"), F.coalesce("min_ms", F.lit(g[2])).alias("min_ms"))


@query("series_slug", r"SELECT DISTINCT url, lower(regexp_replace(regexp_replace(url, '[^\w]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM pages")
def _(s, d):
    return a.table(s, d, "pages").select("url", t.series_slug(F.col("url")).alias("slug")).distinct()


@query("clean_model_line", sql(r"SELECT episode_id, unit_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line FROM lines", "lines"))
def _(s, d):
    reply = F.concat(F.lit("<think>step\nby step</think> ["), F.col("unit_id").cast("string"), F.lit('] "'), F.regexp_replace("text", '"', "'"), F.lit('"'))
    return a.lines(s, d).select("episode_id", "unit_id", t.clean_model_line(reply).alias("line"))


@query("parse_block_reply", sql(r"""SELECT episode_id, unit_id AS idx, trim(regexp_replace(text, '\s+', ' ', 'g')) AS reply FROM lines""", "lines"))
def _(s, d):
    from pyspark.sql import Window

    # A block reply: one "[n] text" line for each line, the first given again at the end (the first wins).
    numbered = a.lines(s, d).select("episode_id", "unit_id", F.concat(F.lit("["), F.col("unit_id").cast("string"), F.lit("] "), t.squeeze(F.col("text"))).alias("x"))
    block = numbered.groupBy("episode_id").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(unit_id, x))), v -> v.x)"), "\n").alias("reply"))
    block = block.withColumn("reply", F.concat(F.lit("context line\n"), F.col("reply"), F.lit("\n[0] again")))
    rows = block.select("episode_id", F.posexplode(F.split("reply", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"^\[\d+\] "))
    rows = rows.select("episode_id", "pos", F.regexp_extract("line", r"^\[(\d+)\] (.*)$", 1).cast("long").alias("idx"), F.regexp_extract("line", r"^\[(\d+)\] (.*)$", 2).alias("reply"))
    first = F.row_number().over(Window.partitionBy("episode_id", "idx").orderBy("pos"))
    return rows.withColumn("rn", first).where("rn = 1").select("episode_id", "idx", "reply")


@query("extract_reply_json", sql(r"SELECT episode_id, unit_id AS id, trim(regexp_replace(replace(text, chr(34), ' '), '\s+', ' ', 'g')) AS text FROM lines", "lines"))
def _(s, d):
    item = F.to_json(F.struct(F.col("unit_id").alias("id"), t.squeeze(F.translate("text", '"', " ")).alias("text")))
    reply = a.lines(s, d).groupBy("episode_id").agg(F.concat(F.lit('<think>{"x"</think>```json\n{"items": ['), F.array_join(F.sort_array(F.collect_list(item)), ","), F.lit("]}\n```")).alias("reply"))
    body = F.regexp_extract(F.regexp_replace("reply", r"(?s)<think>.*?</think>", ""), r"(?s)(\{.*\})", 1)
    return reply.select("episode_id", F.explode(F.from_json(body, "items array<struct<id:bigint,text:string>>")["items"]).alias("i")).select("episode_id", "i.id", "i.text")


@query("stable_key", """SELECT doc_id, substr(sha256('{"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}'), 1, 16) AS key FROM documents""")
def _(s, d):
    return a.table(s, d, "documents").select("doc_id", t.stable_key("source", "lang", "n_chars").alias("key"))


@query("input_fingerprint", "SELECT doc_id, fp, count(*) OVER (PARTITION BY fp) AS copies FROM (SELECT doc_id, sha256(length(text) || ':' || text) AS fp FROM documents)")
def _(s, d):
    fp = F.sha2(F.concat(F.length("text").cast("string"), F.lit(":"), F.col("text")), 256)
    rows = a.table(s, d, "documents").select("doc_id", fp.alias("fp"))
    # Counted with map-side combine and joined back: many copies of one text meet in no task.
    counts = rows.groupBy(F.col("fp").alias("same")).agg(F.count("*").alias("copies"))
    return rows.join(counts, F.col("fp").eqNullSafe(F.col("same"))).select("doc_id", "fp", "copies")


@query("latin_skeleton")
def _(s, d):
    return a.words(s, d).select("word").distinct().select("word", t.latin_skeleton(F.col("word")).alias("skeleton"))


@query("name_tokens", r"SELECT c_custkey, array_to_string(list_filter(string_split('Dr. ' || replace(c_name, '#', ' '), ' '), x -> x <> '' AND lower(x) <> 'dr.'), '|') AS tokens FROM customer")
def _(s, d):
    return a.table(s, d, "customer").select("c_custkey", F.array_join(t.name_tokens(F.concat(F.lit("Dr. "), F.translate("c_name", "#", " "))), "|").alias("tokens"))


# DuckDB's levenshtein counts bytes; tests compare with brute force.
@query("edit_distance_chars")
def _(s, d):
    return a.pairs(s, d).select("episode_id", "unit_id", F.levenshtein("source", "target").cast("long").alias("distance"))


@query("question_lost", sql("SELECT episode_id, unit_id, contains(source, 'on') AND contains(source || '?', '?') AND NOT contains(target, '?') AND unit_id % 2 = 0 AS lost FROM pairs", "pairs"))
def _(s, d):
    return a.pairs(s, d).select("episode_id", "unit_id", (F.col("source").contains("on") & t.question_lost(F.concat("source", F.lit("?")), F.col("target")) & (F.col("unit_id") % 2 == 0)).alias("lost"))


def _neg(col):
    words = ", ".join(f"'{w}'" for w in t.NEGATION["en"])
    return rf"(len(list_filter(regexp_extract_all(lower({col}), '[\p{{L}}\p{{N}}_'']+'), x -> x IN ({words}) OR suffix(x, 'n''t'))) > 0)"


@query("negation_lost", sql(f"SELECT episode_id, unit_id, {_neg('src')} AND NOT {_neg('target')} AS lost FROM (SELECT *, CASE WHEN unit_id % 2 = 0 THEN source || ' Not this' ELSE source END AS src FROM pairs)", "pairs"))
def _(s, d):
    src = F.when(F.col("unit_id") % 2 == 0, F.concat("source", F.lit(" Not this"))).otherwise(F.col("source"))
    return a.pairs(s, d).select("episode_id", "unit_id", t.negation_lost(src, F.col("target"), "en", "en").alias("lost"))


@query("classify_error", "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'too_large' WHEN 1 THEN 'not_free' WHEN 2 THEN 'daily' WHEN 3 THEN 'monthly' WHEN 4 THEN 'fatal' WHEN 5 THEN 'timed_out' ELSE 'model_unavailable' END AS class FROM events")
def _(s, d):
    said = F.expr("element_at(array('Request too large', 'Add credits', 'Limit of tokens per day', 'quota per month', 'Invalid API key', 'Timed out', 'no such model'), cast(event_id % 7 + 1 as int))")
    status = F.when(F.col("event_id") % 7 == 6, 404).otherwise(500)
    return a.table(s, d, "events").select("event_id", t.classify_error(said, status).alias("class"))


@query("estimated_words", sql("SELECT episode_id, unit_id, i - 1 AS pos, w[i] AS word, (end_ms - start_ms) * coalesce(list_sum(list_transform(w[:i - 1], x -> length(x))), 0)::BIGINT // list_sum(list_transform(w, x -> length(x)))::BIGINT + start_ms AS start_ms FROM (SELECT *, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM lines), generate_series(1, len(w)) g(i)", "lines"))
def _(s, d):
    w = F.split(t.squeeze(F.col("text")), " ")
    rows = a.lines(s, d).withColumn("w", w).withColumn("total", F.expr("aggregate(w, 0, (a, x) -> a + length(x))")).select("episode_id", "unit_id", "start_ms", "end_ms", "w", "total", F.posexplode("w").alias("pos", "word"))
    before = F.expr("aggregate(slice(w, 1, pos), 0, (a, x) -> a + length(x))")
    return rows.withColumn("before", before).select("episode_id", "unit_id", F.col("pos").cast("long").alias("pos"), "word", F.expr("(end_ms - start_ms) * before div total + start_ms").alias("start_ms"))


@query("parse_title", r"SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS series, (page_id % 9 + 1)::INTEGER AS season, (page_id % 24 + 1)::INTEGER AS episode FROM pages")
def _(s, d):
    from ..functions.titles import parse_title

    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    se, ep = F.expr("page_id % 9 + 1"), F.expr("page_id % 24 + 1")
    forms = F.when(F.col("page_id") % 3 == 0, F.concat(host, F.format_string(" S%02dE%02d ", se, ep), F.lit("The end"))).when(F.col("page_id") % 3 == 1, F.concat(host, F.format_string(" %dx%02d", se, ep))).otherwise(F.concat(host, F.format_string(" Season %d Episode %d", se, ep)))
    return a.table(s, d, "pages").select("page_id", parse_title(forms).alias("p")).select("page_id", "p.series", "p.season", "p.episode")


@query("detect_series", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'user' WHEN doc_id % 3 = 0 THEN source ELSE lang END AS series FROM documents")
def _(s, d):
    none = F.lit(None).cast("string")
    told = lambda series: F.struct(series.alias("series"), none.alias("season"), none.alias("episode"))
    user, meta = F.when(F.col("doc_id") % 5 == 0, "user").otherwise(""), F.when(F.col("doc_id") % 3 == 0, F.col("source"))
    found = selection.detect_series(told(user), told(meta), told(F.col("lang")))
    return a.table(s, d, "documents").select("doc_id", found["series"].alias("series"))


# Checks and filters

_GUIDE = "len(array_to_string(l, ' ')) * 1000 > dur * 17"
_CHECK = sql(r""", v AS (SELECT *, end_ms - start_ms AS dur, trim(text) AS shown, list_filter(string_split(trim(text), chr(10)), x -> trim(x) <> '') AS l, lag(end_ms) OVER w AS pe, lag(trim(text)) OVER w AS pt FROM lines WINDOW w AS (PARTITION BY episode_id ORDER BY unit_id)),
checked AS (SELECT episode_id, unit_id, list_filter([
 CASE WHEN dur <= 0 THEN 'invalid_timing' END, CASE WHEN start_ms < pe THEN 'overlap' END, CASE WHEN dur > 0 AND dur < 833 THEN 'too_short' END, CASE WHEN dur > 7000 THEN 'too_long' END,
 CASE WHEN shown = '' THEN 'empty_cue' END, CASE WHEN shown <> '' AND dur > 0 AND length(array_to_string(l, ' ')) * 1000 > dur * 17 THEN 'reading_speed' END,
 CASE WHEN len(list_filter(l, x -> length(x) > 42)) > 0 THEN 'line_too_long' END, CASE WHEN len(l) > 2 THEN 'too_many_lines' END,
 CASE WHEN shown <> '' AND pt = shown AND start_ms - pe <= 500 THEN 'duplicate_cue' END], x -> x IS NOT NULL) AS f FROM v)
""", "lines")


@query("check_cues", _CHECK + "SELECT episode_id, unit_id, array_to_string(f, ',') AS flags FROM checked")
def _(s, d):
    return checks.check_cues(a.lines(s, d)).select("episode_id", "unit_id", _J(F.col("qa_flags")).alias("flags"))


_AUDIO = "(unit_id * 37 + episode_id) % 100 / 100.0"
_CAT = f"CASE WHEN len(list_intersect(f, ['invalid_timing', 'overlap', 'empty_cue'])) > 0 OR {_AUDIO} < 0.5 THEN 'LOW' WHEN len(f) > 0 OR {_AUDIO} < 0.75 THEN 'MEDIUM' ELSE 'HIGH' END"


def _judged(s, d):
    audio = F.expr("((unit_id * 37 + episode_id) % 100) / 100.0D")
    rows = checks.check_cues(a.lines(s, d)).withColumn("audio", audio)
    return rows.withColumn("confidence", checks.confidence_category(F.col("qa_flags"), F.col("audio")))


@query("confidence_category", _CHECK + f"SELECT episode_id, unit_id, {_CAT} AS confidence FROM checked")
def _(s, d):
    return _judged(s, d).select("episode_id", "unit_id", "confidence")


@query("confidence_counts", _CHECK + f"SELECT episode_id, count(*) FILTER (WHERE c = 'HIGH') AS high, count(*) FILTER (WHERE c = 'MEDIUM') AS medium, count(*) FILTER (WHERE c = 'LOW') AS low, count(*) FILTER (WHERE c <> 'HIGH') AS needs_review FROM (SELECT *, {_CAT} AS c FROM checked) GROUP BY episode_id")
def _(s, d):
    c = F.col("confidence")
    return _judged(s, d).groupBy("episode_id").agg(F.count_if(c == "HIGH").alias("high"), F.count_if(c == "MEDIUM").alias("medium"), F.count_if(c == "LOW").alias("low"), F.count_if(c != "HIGH").alias("needs_review"))


@query("episode_report", _CHECK + f", e AS (SELECT *, {_CAT} AS c FROM checked), fl AS (SELECT episode_id, x, count(*) AS n FROM (SELECT episode_id, unnest(f) AS x FROM e) GROUP BY ALL), top AS (SELECT episode_id, x AS top_flag FROM fl QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY n DESC, x) = 1) SELECT e.episode_id, count(*) AS lines, round(count(*) FILTER (WHERE len(f) > 0) / count(*), 6) AS flagged_share, round(count(*) FILTER (WHERE c = 'LOW') / count(*), 6) AS low_share, any_value(top_flag) AS top_flag FROM e LEFT JOIN top USING (episode_id) GROUP BY e.episode_id")
def episode_report(s, d):
    """Flagship: quality of every episode in one pass over its lines."""
    rows = _judged(s, d)
    per = rows.groupBy("episode_id").agg(F.count("*").alias("lines"), F.round(F.count_if(F.size("qa_flags") > 0) / F.count("*"), 6).alias("flagged_share"), F.round(F.count_if(F.col("confidence") == "LOW") / F.count("*"), 6).alias("low_share"))
    top = rows.select("episode_id", F.explode("qa_flags").alias("flag")).groupBy("episode_id", "flag").count().groupBy("episode_id").agg(F.min_by("flag", F.struct(-F.col("count"), "flag")).alias("top_flag"))
    return per.join(top, "episode_id", "left")


@query("review_reasons", _CHECK + f"SELECT episode_id, unit_id, array_to_string(list_concat(CASE WHEN unit_id % 4 = 0 THEN [] ELSE ['weak_ai_model'] END, f, CASE WHEN {_AUDIO} < 0.75 THEN ['low_audio_confidence'] ELSE [] END), ',') AS reasons, {_CAT} <> 'HIGH' AND unit_id % 5 <> 0 AS needs_review FROM checked")
def _(s, d):
    r = checks.review_reasons(F.array(F.lit("weak_ai_model")), F.col("qa_flags"), F.col("audio"), F.col("unit_id") % 4 == 0)
    return _judged(s, d).select("episode_id", "unit_id", _J(r).alias("reasons"), ((F.col("confidence") != "HIGH") & (F.col("unit_id") % 5 != 0)).alias("needs_review"))


@query("flag_ranking", _CHECK + "SELECT x AS flag, count(*) AS n FROM (SELECT unnest(f) AS x FROM checked) GROUP BY x ORDER BY n DESC, x")
def _(s, d):
    return checks.check_cues(a.lines(s, d)).select(F.explode("qa_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "flag")


@query("flag_vocabulary_check", _CHECK + "SELECT x AS flag FROM (SELECT unnest(f) AS x FROM checked) WHERE x NOT IN ('invalid_timing', 'overlap', 'too_short', 'too_long', 'empty_cue', 'reading_speed', 'line_too_long', 'too_many_lines', 'duplicate_cue')")
def _(s, d):
    vocabulary = s.createDataFrame([(x,) for x in checks.VOCABULARY], "flag string")
    return checks.check_cues(a.lines(s, d)).select(F.explode("qa_flags").alias("flag")).join(F.broadcast(vocabulary), "flag", "left_anti")


@query("flag_counts_ab", _CHECK + ", b AS (SELECT count(*) FILTER (WHERE end_ms - start_ms > 0 AND length(array_to_string(list_filter(string_split(trim(text), chr(10)), x -> trim(x) <> ''), ' ')) * 1000 > (end_ms - start_ms) * 20) AS n FROM lines) SELECT 'reading_speed' AS flag, (SELECT count(*) FROM checked WHERE list_contains(f, 'reading_speed')) AS cps_17, n AS cps_20 FROM b")
def _(s, d):
    counts = lambda cps, name: checks.check_cues(a.lines(s, d), max_cps=cps).agg(F.count_if(F.array_contains("qa_flags", "reading_speed")).alias("n")).withColumn("rules", F.lit(name))
    both = counts(17, "cps_17").unionByName(counts(20, "cps_20"))
    return both.groupBy(F.lit("reading_speed").alias("flag")).pivot("rules", ["cps_17", "cps_20"]).agg(F.sum("n"))


@query("check_line", sql(r""", p AS (SELECT *, lag(source) OVER w AS ps, lag(target) OVER w AS pt, list_sort(regexp_extract_all(source, '\d+')) AS sn, list_sort(regexp_extract_all(target, '\d+')) AS tn FROM pairs WINDOW w AS (PARTITION BY episode_id ORDER BY unit_id))
SELECT episode_id, unit_id, CASE WHEN trim(target) = '' THEN 'empty_translation' ELSE array_to_string(list_filter([
 CASE WHEN sn <> tn AND NOT (len(tn) = 0 AND len(list_filter(sn, x -> length(x) > 3 OR x::INTEGER > 20)) = 0) THEN 'numbers_differ' END,
 CASE WHEN length(source) >= 12 AND (length(target) / length(source) < 0.3 OR length(target) / length(source) > 3.0) THEN 'suspicious_length' END,
 CASE WHEN trim(pt) = trim(target) AND trim(ps) <> trim(source) THEN 'same_as_previous_line' END], x -> x IS NOT NULL), ',') END AS flags FROM p""", "pairs"))
def _(s, d):
    rows = checks.with_previous(a.pairs(s, d))
    found = checks.check_line(F.col("source"), F.col("target"), F.col("prev_source"), F.col("prev_target"))
    # The back reference of the repetition rule has no twin in the other engine; it has a query of its own.
    return rows.select("episode_id", "unit_id", _J(F.array_remove(found, "repetition_loop")).alias("flags"))


@query("repetition_loop")
def _(s, d):
    found = checks.check_line(F.lit("x"), F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return a.table(s, d, "documents").select("doc_id", F.array_contains(found, "repetition_loop").alias("repeats"))


@query("risk_reasons", sql(rf"""SELECT episode_id, unit_id, array_to_string(list_filter([CASE WHEN trim(target) = '' THEN 'check_line' END, CASE WHEN unit_id % 6 = 5 THEN 'weak_model' END,
 CASE WHEN length(source) >= 8 AND NOT (length(target) / greatest(length(source), 1) BETWEEN 0.5 AND 2.0) THEN 'length_ratio' END, CASE WHEN {_neg('source')} AND NOT {_neg('target')} THEN 'negation_lost' END,
 CASE WHEN regexp_matches(source, '[?]') AND NOT regexp_matches(target, '[?]') THEN 'question_lost' END, CASE WHEN {_AUDIO} < 0.5 THEN 'low_audio' END], x -> x IS NOT NULL), ',') AS reasons FROM pairs""", "pairs"))
def _(s, d):
    return _risky(s, d).select("episode_id", "unit_id", _J(F.col("reasons")).alias("reasons"))


def _risky(s, d):
    empty = t.flags(("empty_translation", F.trim("target") == ""))
    r = checks.risk_reasons(empty, F.col("source"), F.col("target"), "en", "en", F.expr("((unit_id * 37 + episode_id) % 100) / 100.0D"), F.col("unit_id") % 6 == 5, F.lit(False))
    return a.pairs(s, d).withColumn("reasons", r)


@query("risk_top12", QUERIES["risk_reasons"][1].replace("SELECT episode_id, unit_id, array_to_string(", "SELECT block, episode_id, unit_id FROM (SELECT episode_id // 10 AS block, episode_id, unit_id, len(", 1).replace(", ',') AS reasons FROM pairs", ") AS n FROM pairs) WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY block ORDER BY n DESC, episode_id, unit_id) <= 12"))
def _(s, d):
    from pyspark.sql import Window

    rows = _risky(s, d).withColumn("block", F.expr("episode_id div 10")).where(F.size("reasons") > 0)
    rn = F.row_number().over(Window.partitionBy("block").orderBy(F.desc(F.size("reasons")), "episode_id", "unit_id"))
    return rows.withColumn("rn", rn).where("rn <= 12").select("block", "episode_id", "unit_id")


@query("asr_hallucination_reason")
def _(s, d):
    rows = a.table(s, d, "documents").select("doc_id", checks.hallucination_reason(F.col("text"), F.expr("(doc_id % 10) / 10.0D"), F.expr("-(doc_id % 13) / 10.0D"), F.expr("(doc_id % 30) / 10.0D")).alias("reason"))
    return rows


@query("drop_hallucinations")
def _(s, d):
    docs = a.table(s, d, "documents")
    reason = checks.hallucination_reason(F.col("text"), F.expr("(doc_id % 10) / 10.0D"), F.expr("-(doc_id % 13) / 10.0D"), F.expr("(doc_id % 30) / 10.0D"))
    return docs.withColumn("reason", reason).where("reason is not null").groupBy("source", "reason").agg(F.count("*").alias("n"))


@query("drop_by_scores", "SELECT source, reason, count(*) AS n FROM (SELECT source, CASE WHEN NOT regexp_matches(text, '[\\p{L}\\p{N}]') THEN 'no words' WHEN doc_id % 10 >= 6 AND doc_id % 13 >= 10 THEN 'probably not speech' WHEN doc_id % 30 > 24 AND length(text) > 40 THEN 'repetition' END AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY ALL")
def _(s, d):
    # The rules on scores alone, which the other engine can repeat; phrases and word loops are in drop_hallucinations.
    docs = a.table(s, d, "documents")
    reason = F.when(~F.col("text").rlike(r"[\p{L}\p{N}]"), "no words").when(F.expr("(doc_id % 10) / 10.0D >= 0.6 and -(doc_id % 13) / 10.0D <= -1.0"), "probably not speech").when(F.expr("(doc_id % 30) / 10.0D > 2.4 and length(text) > 40"), "repetition")
    return docs.withColumn("reason", reason).where("reason is not null").groupBy("source", "reason").agg(F.count("*").alias("n"))


@query("ngram_loop")
def _(s, d):
    return a.table(s, d, "documents").select("doc_id", checks.is_loop(F.col("text")).alias("is_loop"))


_LOW = """, g AS (SELECT episode_id, unit_id, avg(probability) AS m, list(probability ORDER BY pos) AS p FROM words GROUP BY ALL),
low AS (SELECT episode_id, unit_id, round(m, 9) AS mean, round(m, 9) < 0.5 OR len(list_filter(generate_series(1, len(p) - 2), i -> p[i] < 0.3 AND p[i + 1] < 0.3 AND p[i + 2] < 0.3)) > 0 AS low FROM g)
"""


@query("low_confidence_segment", sql(_LOW + "SELECT * FROM low", "words"))
def _(s, d):
    g = a.words(s, d).groupBy("episode_id", "unit_id").agg(F.round(F.avg("probability"), 9).alias("mean"), F.expr("transform(array_sort(collect_list(struct(pos, probability))), x -> x.probability)").alias("p"))
    return g.select("episode_id", "unit_id", "mean", checks.low_confidence_words(F.col("p")).alias("low"))


@query("evidence_status", "SELECT doc_id, CASE WHEN lang <> 'en' AND doc_id % 3 = 0 THEN 'rejected' WHEN lang <> 'en' THEN 'reference' WHEN doc_id % 7 = 0 THEN 'unverified' WHEN doc_id % 100 < 30 THEN 'rejected' WHEN doc_id % 100 >= 60 THEN 'matches_audio' ELSE 'partial' END AS status FROM documents")
def _(s, d):
    kind = F.when(F.col("doc_id") % 3 == 0, "auto").otherwise("manual")
    agreement = F.when(F.col("doc_id") % 7 != 0, F.expr("(doc_id % 100) / 100.0D"))
    return a.table(s, d, "documents").select("doc_id", checks.evidence_status(F.col("lang") == "en", kind, agreement).alias("status"))


@query("filter_units_by_time", sql("SELECT episode_id, unit_id FROM lines WHERE start_ms < 20000 AND end_ms > 5000", "lines"))
def _(s, d):
    return a.lines(s, d).where("start_ms < 20000 and end_ms > 5000").select("episode_id", "unit_id")


@query("validate_transcript", sql(", v AS (SELECT *, row_number() OVER w - 1 AS pos, lag(start_ms) OVER w AS prev FROM lines_b WINDOW w AS (PARTITION BY episode_id ORDER BY unit_id)) SELECT episode_id, unit_id, array_to_string(list_filter([CASE WHEN unit_id <> pos THEN 'id_sequence' END, CASE WHEN start_ms < 0 OR end_ms < start_ms THEN 'bad_times' END, CASE WHEN start_ms < prev THEN 'unordered' END, CASE WHEN unit_id % 5 = 4 THEN 'confidence_range' END], x -> x IS NOT NULL), ',') AS problems FROM v", "lines_b"))
def _(s, d):
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("episode_id").orderBy("unit_id")) - 1
    rows = a.lines_b(s, d).withColumn("id", F.col("unit_id")).withColumn("pos", pos).withColumn("confidence", F.expr("(unit_id % 5) * 0.3"))
    return checks.validate_transcript(rows).select("episode_id", "unit_id", _J(F.col("problems")).alias("problems"))


@query("resume_remaining", sql("SELECT episode_id, unit_id FROM lines l WHERE NOT EXISTS (SELECT 1 FROM lines_b b WHERE b.episode_id = l.episode_id AND b.unit_id = l.unit_id)", "lines", "lines_b"))
def _(s, d):
    return a.lines(s, d).join(a.lines_b(s, d), ["episode_id", "unit_id"], "left_anti").select("episode_id", "unit_id")


@query("fill_missing", sql("SELECT l.episode_id, l.unit_id, coalesce(b.text, l.text) AS text, b.text IS NULL AS filled FROM lines l LEFT JOIN lines_b b USING (episode_id, unit_id)", "lines", "lines_b"))
def _(s, d):
    b = a.lines_b(s, d).select("episode_id", "unit_id", F.col("text").alias("own"))
    return a.lines(s, d).join(b, ["episode_id", "unit_id"], "left").select("episode_id", "unit_id", F.coalesce("own", "text").alias("text"), F.col("own").isNull().alias("filled"))


@query("over_budget_lines", sql("SELECT episode_id, unit_id FROM pairs WHERE length(target) * 10 > 12 * greatest(12, least((end_ms - start_ms) * 17 // 1000, 84))", "pairs"))
def _(s, d):
    budget = t.max_chars(F.col("end_ms") - F.col("start_ms"), F.lit(17), F.lit(42))
    return a.pairs(s, d).where(F.length("target") * 10 > 12 * budget).select("episode_id", "unit_id")


# Timing

@query("fix_overlaps", sql("SELECT episode_id, unit_id, start_ms, CASE WHEN end_ms > n THEN greatest(start_ms, n) ELSE end_ms END AS end_ms FROM (SELECT *, lead(start_ms) OVER (PARTITION BY episode_id ORDER BY start_ms, unit_id) AS n FROM lines)", "lines"))
def _(s, d):
    return timing.fix_overlaps(a.lines(s, d)).select("episode_id", "unit_id", "start_ms", "end_ms")


@query("shift_cues", sql("SELECT episode_id, unit_id, greatest(start_ms - 2500, 0) AS start_ms, greatest(end_ms - 2500, greatest(start_ms - 2500, 0) + 100) AS end_ms FROM lines", "lines"))
def _(s, d):
    return timing.shift_cues(a.lines(s, d), -2500).select("episode_id", "unit_id", "start_ms", "end_ms")


@query("split_unit", sql(r""", w AS (SELECT *, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w, max(unit_id) OVER (PARTITION BY episode_id) AS top FROM lines), c AS (SELECT *, unit_id % 3 = 0 AND len(w) > 1 AS cut, sum(CASE WHEN unit_id % 3 = 0 AND len(w) > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY unit_id) AS r FROM w)
SELECT episode_id, unit_id, start_ms, CASE WHEN cut THEN (start_ms + end_ms) // 2 ELSE end_ms END AS end_ms, CASE WHEN cut THEN array_to_string(w[:greatest(1, len(w) // 2)], ' ') ELSE text END AS text FROM c
UNION ALL SELECT episode_id, (top + r)::BIGINT, (start_ms + end_ms) // 2, end_ms, array_to_string(w[greatest(1, len(w) // 2) + 1:], ' ') FROM c WHERE cut""", "lines"))
def _(s, d):
    return timing.split_units(a.lines(s, d), "unit_id % 3 = 0").select("episode_id", "unit_id", "start_ms", "end_ms", "text")


@query("merge_units", sql("SELECT episode_id, min(unit_id) AS unit_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(text, ' ' ORDER BY start_ms, unit_id) AS text FROM lines GROUP BY episode_id, unit_id // 2", "lines"))
def _(s, d):
    return timing.merge_units(a.lines(s, d), "unit_id div 2")


@query("gap_islands", sql("""SELECT episode_id, unit_id, sum(CASE WHEN pe IS NULL OR regexp_matches(pt, '[.!?…"”]$') OR start_ms - pe > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY start_ms, unit_id)::BIGINT AS island FROM (SELECT *, lag(end_ms) OVER w AS pe, rtrim(lag(text) OVER w) AS pt FROM lines WINDOW w AS (PARTITION BY episode_id ORDER BY start_ms, unit_id))""", "lines"))
def _(s, d):
    return timing.gap_islands(a.lines(s, d)).select("episode_id", "unit_id", "island")


@query("build_units")
def _(s, d):
    return timing.build_units(a.lines_b(s, d)).withColumn("segment_ids", F.array_join("segment_ids", ","))


@query("collapse_rolling")
def _(s, d):
    return timing.collapse_rolling(a.lines(s, d))


@query("polish_timing")
def _(s, d):
    return timing.polish_timing(timing.fix_overlaps(a.lines(s, d))).withColumn("absorbed", F.array_join("absorbed", ","))


@query("polish_keeps_lines", sql("SELECT episode_id, unit_id FROM lines", "lines"))
def _(s, d):
    out = timing.polish_timing(timing.fix_overlaps(a.lines(s, d)))
    return out.select("episode_id", F.explode(F.concat(F.array("unit_id"), "absorbed")).alias("unit_id"))


@query("polish_has_no_overlap", sql("SELECT 0::BIGINT AS overlaps", "lines"))
def _(s, d):
    from pyspark.sql import Window

    out = timing.polish_timing(timing.fix_overlaps(a.lines(s, d)))
    nxt = F.lead("start_ms").over(Window.partitionBy("episode_id").orderBy("start_ms", "unit_id"))
    return out.withColumn("bad", F.col("end_ms") > nxt).agg(F.count_if("bad").alias("overlaps"))


@query("snap_frames")
def _(s, d):
    return timing.snap_frames(timing.fix_overlaps(a.lines(s, d))).select("episode_id", "unit_id", "start_ms", "end_ms")


@query("segment_cues")
def _(s, d):
    return timing.segment_cues(a.worded_lines(s, d))


@query("segment_keeps_words", sql(r"SELECT episode_id, unit_id AS segment_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS words FROM lines", "lines"))
def _(s, d):
    return timing.segment_cues(a.worded_lines(s, d)).groupBy("episode_id", "segment_id").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(unit_id, text))), x -> x.text)"), " ").alias("words"))
