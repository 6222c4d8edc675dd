"""DuckDB twins of the adapters, and the catalogs' registration."""

import re

CTES = {
    "lines": """lines AS (SELECT conv_id AS episode_id, turn AS unit_id, start_ms, start_ms + dur AS end_ms, role AS speaker, text FROM (
  SELECT *, coalesce(sum(dur + gap) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM (
    SELECT *, (600 + 55 * least(length(text), 120))::BIGINT AS dur, ([-150, 0, 300, 900])[((turn * 7 + conv_id) % 4 + 1)::INTEGER]::BIGINT AS gap FROM conversations)))""",
    "lines_b": r"""lines_b AS (SELECT episode_id, unit_id, start_ms + ((unit_id * 13 + episode_id) % 5 - 2) * 120 AS start_ms, end_ms + ((unit_id * 13 + episode_id) % 5 - 2) * 120 AS end_ms, speaker,
  CASE WHEN (unit_id + episode_id) % 3 = 0 THEN regexp_replace(text, '\s+\S+$', '') ELSE text END AS text FROM lines WHERE (unit_id + episode_id) % 11 <> 0)""",
    "pairs": "pairs AS (SELECT episode_id, unit_id, start_ms, end_ms, speaker, text AS source, coalesce(lead(text) OVER (PARTITION BY episode_id ORDER BY unit_id), '') AS target FROM lines)",
    "segments": "segments AS (SELECT user_id AS episode_id, event_id AS seg_id, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + floor(value * 60000)::BIGINT AS end_ms, event_type AS speaker, value, props FROM events WHERE event_id % 2 = 0)",
    "turns": "turns AS (SELECT user_id AS episode_id, event_id AS turn_id, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + floor(value * 60000)::BIGINT AS end_ms, event_type AS speaker, value, props FROM events WHERE event_id % 2 = 1)",
    "words": r"""words AS (SELECT episode_id, unit_id, (i - 1)::INTEGER AS pos, w[i] AS word, start_ms + (end_ms - start_ms) * (i - 1) // len(w) AS start_ms, start_ms + (end_ms - start_ms) * i // len(w) AS end_ms,
  ((length(w[i]) * 7 + (i - 1) * 3 + unit_id) % 11) / 10.0::DOUBLE AS probability FROM (SELECT *, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM lines), generate_series(1, len(w)) g(i))""",
    "jobs": "jobs AS (SELECT o_orderkey AS job_id, o_custkey % 50 AS machine, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'running' END AS status, round(o_totalprice)::BIGINT AS media_s, o_orderdate::DATE AS created FROM orders)",
    "job_stages": "job_stages AS (SELECT l_orderkey AS job_id, l_linenumber AS stage, max(l_quantity)::BIGINT AS elapsed_s, max(l_returnflag) = 'R' AS cached, max(l_suppkey) AS supplier FROM lineitem GROUP BY 1, 2)",
    "votes": """votes AS (SELECT source AS item, doc_id AS line, v.judge AS judge, v.winner AS winner FROM (SELECT source, doc_id, unnest([
  {'judge': 1, 'winner': CASE WHEN quality = 1 THEN 'new' ELSE 'old' END}, {'judge': 2, 'winner': CASE WHEN toxic = 1 THEN 'old' ELSE 'tie' END},
  {'judge': 3, 'winner': (['new', 'tie', 'old'])[(doc_id % 3 + 1)::INTEGER]}]) AS v FROM labels JOIN documents USING (doc_id)))""",
}
_NEEDS = {"lines_b": ["lines"], "pairs": ["lines"], "words": ["lines"]}


def sql(body: str, *tables: str) -> str:
    """``body`` behind the CTEs of the named domain tables; ``body`` may go on with ", name AS (...) SELECT ..."."""
    names: list[str] = []
    for t in tables:
        for n in [*_NEEDS.get(t, []), t]:
            if n not in names:
                names.append(n)
    return "WITH " + ",\n".join(CTES[n] for n in names) + "\n" + body


def catalog():
    """(queries, decorator): name -> (callable, SQL or None).  Lambdas are written x -> ... and registered in DuckDB's own form."""
    queries: dict = {}

    def query(name: str, oracle: str | None = None):
        def add(fn):
            queries[name] = (fn, re.sub(r"\b(\w) -> ", r"lambda \1: ", oracle) if oracle else None)
            return fn

        return add

    return queries, query
