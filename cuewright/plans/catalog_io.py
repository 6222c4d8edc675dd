"""Queries over sources, sinks, names, voices, briefs, selections and streams, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import latin_skeleton, norm_words
from ..functions.unicode import text_similarity
from ..operators import checks, history, joins, names, selection, voices
from ..sources import adapters as a
from ..sources import subtitles as sub
from ..streaming import jobs as streams
from .catalog_runs import STAGE_STATUS_SQL, stage_events_of
from .finalize import finalize_episode
from .oracle import catalog, sql

QUERIES, query = catalog()

_CUES = "SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY start_ms, unit_id) - 1 AS pos, greatest(start_ms, 0) AS start_ms, greatest(end_ms, 0) AS end_ms, trim(text) AS text FROM lines"


@query("read_srt", sql(_CUES, "lines"))
def _(s, d):
    return sub.read_cues(sub.to_srt(a.lines(s, d)), "episode_id", "content", sub.parse_srt)


@query("read_vtt", sql(_CUES, "lines"))
def _(s, d):
    return sub.read_cues(sub.to_vtt(a.lines(s, d)), "episode_id", "content", sub.parse_vtt)


@query("read_subtitles", sql(_CUES, "lines"))
def _(s, d):
    rows = a.lines(s, d)
    files = sub.to_srt(rows.where("episode_id % 2 = 0")).unionByName(sub.to_vtt(rows.where("episode_id % 2 = 1")))
    return sub.read_cues(files, "episode_id")


@query("read_zip_subtitles", sql(_CUES, "lines"))
def _(s, d):
    return sub.read_cues(sub.read_archives(sub.to_archives(sub.to_srt(a.lines(s, d)), "episode_id", "content"), "episode_id"), "episode_id")


@query("write_srt", sql("SELECT episode_id, string_agg(n || chr(10) || printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) || chr(10) || trim(text) || chr(10), chr(10) ORDER BY n) AS content FROM (SELECT episode_id, greatest(start_ms, 0) AS start_ms, end_ms, text, row_number() OVER (PARTITION BY episode_id ORDER BY start_ms, unit_id) AS n FROM lines) GROUP BY episode_id", "lines"))
def _(s, d):
    return sub.to_srt(a.lines(s, d))


@query("decode_subtitle_bytes", "SELECT doc_id, text FROM documents")
def _(s, d):
    docs = a.table(s, d, "documents")
    data = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-16")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(b"\xef\xbb\xbf"), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    return docs.select("doc_id", sub.decoded(data, F.col("lang")).alias("text"))


@query("write_review_required", sql("SELECT episode_id, length('Lines needing review: ' || count(*) FILTER (WHERE unit_id % 3 <> 0) || ' of ' || count(*)) AS head, count(*) FILTER (WHERE unit_id % 3 <> 0) AS entries FROM lines GROUP BY episode_id", "lines"))
def _(s, d):
    units = a.lines(s, d).withColumn("confidence", F.when(F.col("unit_id") % 3 == 0, "HIGH").otherwise("LOW")).withColumn("reasons", F.array(F.lit("overlap")))
    f = sub.review_file(units)
    return f.select("episode_id", F.length(F.regexp_extract("content", r"^(Lines needing review: \d+ of \d+)", 1)).cast("long").alias("head"), F.regexp_count("content", F.lit(r"(?m)^#\d+  ")).cast("long").alias("entries"))


@query("read_jsonl_prefix", "SELECT user_id AS path, pos, record FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, props AS record FROM events) WHERE pos < 5")
def _(s, d):
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = a.table(s, d, "events").withColumn("pos", rn).withColumn("x", F.when(F.col("pos") == 5, F.lit('{"torn')).otherwise(F.col("props")))
    files = rows.groupBy(F.col("user_id").alias("path")).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda v: v["x"]), "\n"), F.lit("\n")).alias("content"))
    return sub.jsonl_prefix(files)


@query("read_transcripts", sql("SELECT episode_id, unit_id, coalesce(CASE WHEN unit_id % 2 = 0 THEN 'final ' || text END, text) AS target, CASE WHEN unit_id % 3 = 0 THEN 'x,y' ELSE 'x' END AS flags FROM lines", "lines"))
def _(s, d):
    unit = F.struct(F.col("unit_id").alias("id"), F.col("text").alias("translation"), F.when(F.col("unit_id") % 2 == 0, F.concat(F.lit("final "), "text")).alias("final_text"), F.array(F.lit("x")).alias("flags"), F.when(F.col("unit_id") % 3 == 0, F.array(F.lit("y"))).alias("qa_flags"))
    docs = a.lines(s, d).groupBy("episode_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(unit)).alias("translation_units"))).alias("json"))
    schema = "translation_units array<struct<id:bigint,translation:string,final_text:string,flags:array<string>,qa_flags:array<string>>>"
    rows = docs.select("episode_id", F.explode(F.from_json("json", schema)["translation_units"]).alias("u"))
    return rows.select("episode_id", F.col("u.id").alias("unit_id"), F.coalesce("u.final_text", "u.translation").alias("target"), F.array_join(F.concat("u.flags", F.coalesce("u.qa_flags", F.array().cast("array<string>"))), ",").alias("flags"))


@query("units_from_artifacts", sql("SELECT episode_id, unit_id AS id, text FROM lines", "lines"))
def _(s, d):
    # Two shapes of artifact and a duplicate of every id: the last one in the list counts.
    rows = a.lines(s, d)
    item = lambda t, n: F.struct(F.lit(n).alias("n"), F.col("unit_id").alias("id"), t.alias("text"))
    both = rows.select("episode_id", F.explode(F.array(item(F.lit("old"), 0), item(F.col("text"), 1))).alias("u"))
    docs = both.groupBy("episode_id").agg(F.transform(F.sort_array(F.collect_list("u")), lambda u: F.struct(u["id"].alias("id"), u["text"].alias("text"))).alias("units"))
    json = F.when(F.col("episode_id") % 2 == 0, F.to_json(F.struct(F.col("units").alias("translation_units")))).otherwise(F.to_json(F.struct("units")))
    kind = "array<struct<id:bigint,text:string>>"
    got = docs.select("episode_id", F.from_json(json, f"translation_units {kind}, units {kind}").alias("j"))
    each = got.select("episode_id", F.posexplode(F.coalesce("j.translation_units", "j.units")).alias("pos", "u"))
    last = F.row_number().over(Window.partitionBy("episode_id", "u.id").orderBy(F.desc("pos")))
    return each.withColumn("rn", last).where("rn = 1").select("episode_id", "u.id", "u.text")


@query("newest_artifact", "SELECT user_id AS job, event_id FROM events WHERE event_type IN ('view', 'click', 'purchase') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ts DESC, event_id DESC) = 1")
def _(s, d):
    priority = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(priority, F.desc("ts"), F.desc("event_id")))
    return a.table(s, d, "events").where("event_type in ('view', 'click', 'purchase')").withColumn("rn", rn).where("rn = 1").select(F.col("user_id").alias("job"), "event_id")


@query("read_reference_csv", sql("SELECT episode_id, unit_id, printf('%.3f', start_ms / 1000.0) AS start, coalesce(nullif(CASE WHEN unit_id % 2 = 0 THEN text END, ''), '') AS target_ref FROM lines", "lines"))
def _(s, d):
    row = F.to_csv(F.struct(F.format_string("%.3f", F.col("start_ms") / 1000.0).alias("start"), F.when(F.col("unit_id") % 2 == 0, F.regexp_replace("text", "\n", "\\\\n")).alias("target_ref")))
    back = F.from_csv(row, F.lit("start double, target_ref string"))
    rows = a.lines(s, d).select("episode_id", "unit_id", back.alias("r"))
    return rows.select("episode_id", "unit_id", F.format_string("%.3f", "r.start").alias("start"), F.coalesce(F.regexp_replace("r.target_ref", r"\\n", "\n"), F.lit("")).alias("target_ref"))


@query("write_reference_lines", sql("SELECT episode_id, unit_id, printf('%.3f', start_ms / 1000.0) AS start, printf('%.3f', end_ms / 1000.0) AS \"end\", source AS source_ref, CASE WHEN unit_id % 2 = 0 THEN target ELSE '' END AS target_ref FROM pairs", "pairs"))
def _(s, d):
    return a.pairs(s, d).select("episode_id", "unit_id", F.format_string("%.3f", F.col("start_ms") / 1000.0).alias("start"), F.format_string("%.3f", F.col("end_ms") / 1000.0).alias("end"), F.col("source").alias("source_ref"), F.when(F.col("unit_id") % 2 == 0, F.col("target")).otherwise("").alias("target_ref"))


@query("report_summary", sql("SELECT episode_id || '.lines.count' AS metric, count(*)::DOUBLE AS value FROM lines GROUP BY episode_id UNION ALL SELECT episode_id || '.text.chars', sum(length(text))::DOUBLE FROM lines GROUP BY episode_id", "lines"))
def _(s, d):
    g = a.lines(s, d).groupBy("episode_id").agg(F.count("*").cast("double").alias("n"), F.sum(F.length("text")).cast("double").alias("c"))
    return g.select("episode_id", F.expr("stack(2, '.lines.count', n, '.text.chars', c) as (k, value)")).select(F.concat(F.col("episode_id").cast("string"), "k").alias("metric"), "value")


@query("union_evidence", "SELECT 'docs' AS provider, lang AS language, count(*) AS cues, NULL AS warning FROM documents GROUP BY lang UNION ALL SELECT 'pages', NULL, count(*), CASE WHEN count(*) > 0 THEN 'no language' END FROM pages")
def _(s, d):
    docs = a.table(s, d, "documents").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("cues")).withColumn("provider", F.lit("docs")).withColumn("warning", F.lit(None).cast("string"))
    pages = a.table(s, d, "pages").agg(F.count("*").alias("cues")).withColumn("provider", F.lit("pages")).withColumn("warning", F.when(F.col("cues") > 0, "no language"))
    return docs.unionByName(pages, allowMissingColumns=True)


@query("strip_html", r"SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS chars FROM pages")
def _(s, d):
    return a.table(s, d, "pages").select("page_id", F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("chars"))


# Names

_WORD = r"(?U)(\w+)"


def _glossary(s, d):
    """Names: words with a capital inside a line; a name's spelling is the first one met, every seventh pinned."""
    rows = a.lines(s, d).select(F.expr("episode_id % 5").alias("series"), "episode_id", "unit_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?<=[a-z,] )([A-Z][a-z]{3,})"), F.lit(1))).alias("name"))
    return rows.withColumn("spelling", F.when(F.col("episode_id") % 2 == 0, F.col("name")).otherwise(F.concat("name", F.lit("e")))).withColumn("pinned", F.col("episode_id") % 7 == 0)


def _named_lines(s, d):
    """Pairs in which every tenth line names the episode's series word, with a near spelling in the target."""
    word = F.concat(F.lit("Marlon"), F.expr("repeat('a', cast(episode_id % 5 as int))"))
    near = F.concat(F.lit("Marlen"), F.expr("repeat('a', cast(episode_id % 5 as int))"))
    rows = a.pairs(s, d).withColumn("series", F.expr("episode_id % 5"))
    return rows.withColumn("source", F.when(F.col("unit_id") % 2 == 0, F.concat(word, F.lit(" "), F.col("source"))).otherwise(F.col("source"))).withColumn("target", F.when(F.col("unit_id") % 4 == 0, F.concat(near, F.lit(" "), F.col("target"))).otherwise(F.col("target")))


def _known(s, d):
    return a.lines(s, d).select(F.expr("episode_id % 5").alias("series")).distinct().withColumn("name", F.concat(F.lit("Marlon"), F.expr("repeat('a', cast(series as int))"))).withColumn("spelling", F.col("name"))


@query("learn_glossary", sql("SELECT series, name, CASE WHEN episode_id % 2 = 0 THEN name ELSE name || 'e' END AS spelling FROM (SELECT episode_id % 5 AS series, episode_id, unit_id, unnest(regexp_extract_all(text, '[a-z,] ([A-Z][a-z]{3,})', 1)) AS name FROM lines) QUALIFY row_number() OVER (PARTITION BY series, name ORDER BY CASE WHEN episode_id % 7 = 0 THEN 0 ELSE 1 END, episode_id, unit_id) = 1", "lines"))
def _(s, d):
    return names.learn_glossary(_glossary(s, d))


@query("name_issues")
def _(s, d):
    return names.name_issues(_named_lines(s, d), _known(s, d))


@query("normalize_names", sql("SELECT episode_id, unit_id, 'Marlon' || repeat('a', (episode_id % 5)::INTEGER) AS name, unit_id % 4 = 0 AS fixed FROM lines WHERE unit_id % 2 = 0", "lines"))
def _(s, d):
    rows = names.normalize_names(_named_lines(s, d), _known(s, d)).where("spellings is not null")
    return rows.select("episode_id", "unit_id", F.col("spellings")[0].alias("name"), F.col("fixed").startswith(F.col("spellings")[0]).alias("fixed"))


@query("repair_swapped_names", sql("SELECT episode_id, unit_id, 'Berit' AS wrong, 'Marlon' || repeat('a', (episode_id % 5)::INTEGER) AS right FROM lines WHERE unit_id % 4 = 2", "lines"))
def _(s, d):
    rows = _named_lines(s, d).withColumn("target", F.when(F.col("unit_id") % 4 == 2, F.concat(F.lit("Berit "), "target")).otherwise(F.col("target")))
    known = _known(s, d)
    return names.repair_swapped(rows, known.unionByName(known.withColumn("name", F.lit("Berit")).withColumn("spelling", F.lit("Berit"))))


@query("known_names", sql("SELECT DISTINCT episode_id % 5 AS series, 'Marlon' || repeat('a', (episode_id % 5)::INTEGER) AS name FROM lines UNION SELECT 0, n_name FROM nation", "lines"))
def _(s, d):
    own = _known(s, d).select("series", "name")
    return own.union(a.table(s, d, "nation").select(F.lit(0).cast("long"), "n_name")).distinct()


@query("skeleton_match")
def _(s, d):
    # Words of lines beside the words of the next line: every pair that sounds alike, found by the first class and checked.
    word = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b([A-Z][a-z]{3,})\b"), F.lit(1))))
    rows = a.pairs(s, d)
    return names.skeleton_matches(rows.select("episode_id", "unit_id", word("source").alias("name")), rows.select("episode_id", "unit_id", word("target").alias("word")))


# Voices, windows, diffs

@query("link_speakers")
def _(s, d):
    return voices.link_speakers(a.voices(s, d))


@query("link_speakers_one_to_one", "SELECT vec_id // 50 AS episode_id, count(*) AS voices, 0::BIGINT AS shared FROM embeddings GROUP BY 1")
def _(s, d):
    out = voices.link_speakers(a.voices(s, d))
    per = out.groupBy("episode_id", "window", "speaker").count()
    return out.groupBy("episode_id").agg(F.count("*").alias("voices")).join(per.groupBy("episode_id").agg(F.count_if(F.col("count") > 1).alias("shared")), "episode_id")


@query("plan_windows")
def _(s, d):
    # A month of events is read as an episode of three quarters of an hour: its milliseconds are thousandths of theirs.
    first = F.min("start_ms").over(Window.partitionBy("episode_id"))
    at = lambda c: F.floor((F.col(c) - F.col("first")) / 1000).alias(c)
    return voices.plan_windows(a.segments(s, d).withColumn("first", first).select("episode_id", at("start_ms"), at("end_ms")))


@query("diff_runs")
def _(s, d):
    return voices.diff_runs(a.lines(s, d), a.lines_b(s, d))


@query("translate_in_batches", sql("SELECT episode_id, unit_id, '> ' || text AS translation FROM lines", "lines"))
def _(s, d):
    return voices.translate_in_batches(a.lines(s, d), lambda texts, last: ["> " + t for t in texts]).select("episode_id", "unit_id", "translation")


@query("score_pairs", sql("SELECT episode_id, unit_id, CASE WHEN length(source) > length(target) THEN 'A' WHEN length(source) < length(target) THEN 'B' ELSE 'tie' END AS winner FROM pairs", "pairs"))
def _(s, d):
    def judge(batches):
        for pdf in batches:
            la, lb = pdf["source"].str.len(), pdf["target"].str.len()
            pdf["winner"] = ["A" if x > y else "B" if x < y else "tie" for x, y in zip(la, lb)]
            yield pdf[["episode_id", "unit_id", "winner"]]

    return a.pairs(s, d).select("episode_id", "unit_id", "source", "target").mapInPandas(judge, "episode_id long, unit_id long, winner string")


@query("complete_text_from_track")
def _(s, d):
    rows = joins.side_by_side(a.lines_b(s, d), a.lines(s, d))
    longer = F.length(norm_words(F.col("other"))) > F.length(norm_words(F.col("text")))
    return rows.withColumn("replaced", longer & (text_similarity("text", "other") >= 0.6)).select("episode_id", "unit_id", F.when(F.col("replaced"), F.col("other")).otherwise(F.col("text")).alias("text"), "replaced")


@query("merge_decode_candidate", sql(", p AS (SELECT s.episode_id, s.seg_id, t.* EXCLUDE (episode_id), t.end_ms - t.start_ms AS n FROM segments s JOIN turns t ON s.episode_id = t.episode_id AND (t.start_ms + t.end_ms) // 2 BETWEEN s.start_ms AND s.end_ms) SELECT episode_id, seg_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(speaker, ' ' ORDER BY start_ms, turn_id) AS text, round(CASE WHEN sum(n) > 0 THEN sum(-(turn_id % 20) / 10.0::DOUBLE * n) / sum(n) END, 6) AS logprob, max((turn_id % 9) / 9.0::DOUBLE) AS no_speech, max(value) AS compression FROM p GROUP BY ALL", "segments", "turns"))
def _(s, d):
    pieces = a.turns(s, d).select("episode_id", F.col("turn_id").alias("piece_id"), "start_ms", "end_ms", F.col("speaker").alias("text"), F.expr("-(turn_id % 20) / 10.0D").alias("logprob"), F.expr("(turn_id % 9) / 9.0D").alias("no_speech"), F.col("value").alias("compression"))
    return selection.merge_decode(a.segments(s, d), pieces, joins.SESSIONS)


@query("pick_decode_candidate", "WITH o AS (SELECT user_id AS seg_id, avg(-value / 100) AS logprob FROM events GROUP BY user_id), b AS (SELECT user_id AS seg_id, event_id FROM events JOIN o ON user_id = seg_id WHERE -value / 100 > logprob AND (event_id % 40) / 10.0::DOUBLE <= 2.4 AND event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) = 1) SELECT seg_id, event_id AS candidate_id FROM o LEFT JOIN b USING (seg_id)")
def _(s, d):
    e = a.table(s, d, "events")
    originals = e.groupBy(F.col("user_id").alias("seg_id")).agg(F.avg(-F.col("value") / 100).alias("logprob"))
    return selection.pick_decode(originals, e.select(F.col("user_id").alias("seg_id"), F.col("event_id").alias("candidate_id"), (-F.col("value") / 100).alias("logprob"), F.expr("(event_id % 40) / 10.0D").alias("compression"), (F.col("event_type") == "error").alias("hallucinated")))


# Selections

def _tracks(s, d):
    """Documents as tracks: twenty to a medium, regional and original codes, every third one automatic, agreement by length."""
    code = F.concat("lang", F.expr("case doc_id % 4 when 0 then '-XX' when 1 then '-orig' else '' end"))
    return a.table(s, d, "documents").select(F.expr("doc_id div 20").alias("media"), F.col("doc_id").alias("track_id"), code.alias("language"), F.expr("if(doc_id % 3 = 0, 'auto', 'manual')").alias("kind"), F.expr("(n_chars % 100) / 100.0D").alias("agreement"), F.expr("element_at(array('en', 'de', 'fr', 'es'), cast(doc_id div 20 % 4 + 1 as int))").alias("audio_language"))


_TRACKS = "WITH t AS (SELECT doc_id // 20 AS media, doc_id AS track_id, lang AS base, lang || CASE doc_id % 4 WHEN 0 THEN '-xx' WHEN 1 THEN '-orig' ELSE '' END AS code, doc_id % 3 <> 0 AS manual, (n_chars % 100) / 100.0 AS agreement, (['en', 'de', 'fr', 'es'])[(doc_id // 20 % 4 + 1)::INTEGER] AS audio FROM documents) "


@query("best_track", _TRACKS + "SELECT media, track_id FROM t WHERE manual AND base = audio AND agreement >= 0.6 QUALIFY row_number() OVER (PARTITION BY media ORDER BY agreement DESC, track_id) = 1")
def _(s, d):
    return selection.best_track(_tracks(s, d))


@query("best_community_file", "SELECT lang AS language, doc_id AS file_id FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) = 1")
def _(s, d):
    docs = a.table(s, d, "documents")
    return selection.best_community_file(docs.select(F.col("lang").alias("language"), F.col("doc_id").alias("file_id"), F.col("n_chars").alias("downloads"), F.expr("doc_id % 4").alias("n_files"), F.expr("doc_id % 7 = 0").alias("machine_translated")))


@query("select_tracks", _TRACKS + ", s AS (SELECT *, CASE WHEN manual AND base = 'fr' THEN 0 WHEN manual AND base = 'de' THEN 1 WHEN manual AND base = 'en' THEN 2 WHEN NOT manual THEN 3 END AS slot, CASE WHEN manual THEN (code <> base)::INTEGER ELSE (NOT suffix(code, '-orig'))::INTEGER END AS p FROM t), o AS (SELECT media, track_id, slot FROM s WHERE slot IS NOT NULL QUALIFY row_number() OVER (PARTITION BY media, slot ORDER BY p, code, track_id) = 1) SELECT media, track_id, row_number() OVER (PARTITION BY media ORDER BY slot) AS slot FROM o")
def _(s, d):
    return selection.select_tracks(_tracks(s, d), "fr", "de").withColumn("slot", F.col("slot").cast("long"))


# Briefs

@query("merge_briefs", sql("SELECT episode_id, string_agg(name, ',' ORDER BY first) AS names FROM (SELECT episode_id, lower(name) AS name, min(unit_id * 1000 + i) AS first FROM (SELECT episode_id, unit_id, w[i] AS name, i FROM (SELECT *, regexp_extract_all(text, '[A-Z][a-z]{4,}') AS w FROM lines), generate_series(1, len(w)) g(i)) GROUP BY ALL) GROUP BY episode_id", "lines"))
def _(s, d):
    items = a.lines(s, d).select("episode_id", "unit_id", F.posexplode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{4,})"), F.lit(1))).alias("pos", "name"))
    first = items.groupBy("episode_id", F.lower("name").alias("name")).agg(F.min(F.struct("unit_id", "pos")).alias("first"))
    return first.groupBy("episode_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda x: x["name"]), ",").alias("names"))


_BRIEF = sql(""", i AS (SELECT episode_id, unit_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{4,}')) AS name FROM lines), m AS (SELECT DISTINCT episode_id, lower(name) AS name FROM i),
w AS (SELECT DISTINCT episode_id, unit_id // 3 AS block, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM lines),
k AS (SELECT DISTINCT w.episode_id, block, name FROM w JOIN m ON m.episode_id = w.episode_id AND (word = name OR word = name || 's')),
r AS (SELECT episode_id, name AS a, lead(name) OVER (PARTITION BY episode_id ORDER BY name) AS b FROM m)
SELECT n.episode_id, n.block, n.names, (SELECT count(*) FROM r WHERE r.episode_id = n.episode_id AND b IS NOT NULL AND (list_contains(n.l, a) OR list_contains(n.l, b))) AS relations FROM (SELECT episode_id, block, list(name) AS l, string_agg(name, ',' ORDER BY name) AS names FROM k GROUP BY ALL) n""", "lines")


@query("trim_brief", _BRIEF)
def _(s, d):
    rows = a.lines(s, d)
    items = rows.select("episode_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{4,})"), F.lit(1))).alias("name")).select("episode_id", F.lower("name").alias("name")).distinct()
    after = F.lead("name").over(Window.partitionBy("episode_id").orderBy("name"))
    relations = items.select("episode_id", F.col("name").alias("a"), after.alias("b")).where("b is not null")
    blocks = rows.select("episode_id", F.expr("unit_id div 3").alias("block"), "text")
    return names.trim_brief(blocks, items.withColumn("aliases", F.array(F.concat("name", F.lit("s")))), relations)


@query("validate_brief", sql("SELECT episode_id, least(40, count(*) FILTER (WHERE trim(text) <> '')) AS characters, max(length(trim(text)[:60])) FILTER (WHERE trim(text) <> '') AS longest, count(*) FILTER (WHERE trim(text) <> '' AND unit_id % 3 = 0) AS female, least(60, count(*) FILTER (WHERE unit_id % 2 = 0)) AS relations, least(40, count(*) FILTER (WHERE unit_id % 4 <> 1)) AS terms FROM lines GROUP BY episode_id", "lines"))
def _(s, d):
    kind = F.when(F.col("unit_id") % 3 == 0, "female").otherwise("other")
    character = F.struct(F.col("text").alias("name"), kind.alias("gender"), F.array_repeat(F.lit("alias"), 9).alias("aliases"))
    relation = F.struct(F.col("speaker").alias("from"), F.when(F.col("unit_id") % 2 == 0, F.lit("x")).alias("to"), F.lit("friends").alias("type"))
    term = F.struct(F.when(F.col("unit_id") % 4 != 1, F.col("speaker")).otherwise(F.lit("  ")).alias("term"), F.col("text").alias("meaning"))
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("unit_id", c.alias("c")))), lambda x: x["c"])
    brief = a.lines(s, d).groupBy("episode_id").agg(F.to_json(F.struct(listed(character).alias("characters"), listed(relation).alias("relations"), listed(term).alias("terms"), F.lit("about").alias("summary"))).alias("json"))
    out = brief.select("episode_id", names.validated_brief(F.col("json")).alias("b"))
    n = lambda c: F.size(f"b.{c}").cast("long").alias(c)
    return out.select("episode_id", n("characters"), F.array_max(F.transform("b.characters", lambda x: F.length(x["name"]))).cast("long").alias("longest"), F.size(F.filter("b.characters", lambda x: x["gender"] == "female")).cast("long").alias("female"), n("relations"), n("terms"))


@query("validate_speakers", sql("SELECT s.episode_id, seg_id AS voice, CASE WHEN s.speaker = 'view' THEN '' ELSE s.speaker END AS name, CASE seg_id % 3 WHEN 0 THEN 'female' ELSE 'unknown' END AS gender FROM segments s WHERE EXISTS (SELECT 1 FROM turns t WHERE t.episode_id = s.episode_id AND t.turn_id = s.seg_id + 1)", "segments", "turns"))
def _(s, d):
    # A reply names the voices; voices are known where the next event is a turn of the same user.
    known = a.turns(s, d).select("episode_id", (F.col("turn_id") - 1).alias("voice"))
    item = F.struct(F.col("seg_id").alias("voice"), F.when(F.col("speaker") == "view", "Unknown").otherwise(F.col("speaker")).alias("name"), F.when(F.col("seg_id") % 3 == 0, "female").otherwise("robot").alias("gender"))
    replies = a.segments(s, d).groupBy("episode_id").agg(F.to_json(F.struct(F.collect_list(item).alias("speakers"))).alias("json"))
    return names.validated_speakers(replies, known)


# The production plan

@query("finalize_episode")
def _(s, d):
    return finalize_episode(a.lines(s, d)).withColumn("qa_flags", F.array_join("qa_flags", ","))


@query("finalize_keeps_lines", sql("SELECT episode_id, unit_id FROM lines", "lines"))
def _(s, d):
    return finalize_episode(a.lines(s, d)).select("episode_id", "unit_id")


@query("assemble_refined", sql("SELECT l.episode_id, l.unit_id, coalesce(b.text, l.text) AS final, array_to_string(list_filter([CASE WHEN b.text IS NULL THEN 'not_refined_by_ai' END, CASE WHEN l.unit_id % 6 = 5 THEN 'weak_ai_model' END], x -> x IS NOT NULL), ',') AS flags FROM lines l LEFT JOIN lines_b b USING (episode_id, unit_id)", "lines", "lines_b"))
def _(s, d):
    from ..functions.text import flags

    b = a.lines_b(s, d).select("episode_id", "unit_id", F.col("text").alias("refined"))
    rows = a.lines(s, d).join(b, ["episode_id", "unit_id"], "left")
    found = flags(("not_refined_by_ai", F.col("refined").isNull()), ("weak_ai_model", F.col("unit_id") % 6 == 5))
    return rows.select("episode_id", "unit_id", F.coalesce("refined", "text").alias("final"), F.array_join(found, ",").alias("flags"))


# Streams

@query("stream_stage_status", STAGE_STATUS_SQL)
def _(s, d):
    events = streams.stream_table(s, d, "events")
    return streams.run_complete(history.stage_status(stage_events_of(events)), "stage-status")


@query("stream_cooldown", "SELECT user_id AS key, max(epoch_us(ts) // 1000 + 1800000) AS until_ms FROM events GROUP BY user_id HAVING max(epoch_us(ts) // 1000 + 1800000) > 0")
def _(s, d):
    rows = streams.stream_table(s, d, "events").select(F.col("user_id").alias("key"), F.expr("unix_millis(cast(ts as timestamp)) + 1800000").alias("until_ms"), F.col("event_type").alias("reason"))
    return streams.run_complete(history.cooldowns(rows, 0).select("key", "until_ms"), "cooldown")


@query("windowed_quality", "SELECT epoch_us(date_trunc('hour', ts)) // 1000 AS window_ms, count(*) AS n, count(*) FILTER (WHERE value > 100) AS high FROM events GROUP BY 1")
def _(s, d):
    return streams.run_complete(streams.windowed_quality(streams.stream_table(s, d, "events")), "windows")


@query("stream_segments")
def _(s, d):
    return streams.run_appending(streams.accepted_segments(streams.stream_table(s, d, "events")), "segments")


@query("stream_line_qa", "SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'empty' WHEN length(text) > 500 THEN 'long' ELSE '' END AS flag FROM conversations")
def _(s, d):
    rows = streams.stream_table(s, d, "conversations")
    flag = F.when(F.trim("text") == "", "empty").when(F.length("text") > 500, "long").otherwise("")
    return streams.run_appending(streams.per_line(rows, lambda r: r.select("conv_id", "turn", flag.alias("flag"))), "line-qa")
