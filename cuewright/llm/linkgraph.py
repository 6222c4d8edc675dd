"""URL filters: rules, and link-graph propagation for the hosts that no rule judges.

Host edges come from the pages' links (weights are counts): absolute ones, those that begin
with ``//``, and relative ones where a ``<base href>`` names another host; links in comments
and scripts do not count.  With ``tree`` a host and its parent domain point at each other
too.  Trust is personalised PageRank
from hosts with pages that rules allow; distrust is the same on reversed edges from hosts
with pages that rules block.  A host is blocked when its distrust exceeds ``RATIO`` times
its trust.  A page takes its longest fitting rule's verdict, else its host's.

Each round joins ranks to pre-aggregated edges by host and sums by host with map-side
combine; both propagations run in one round, and each round's ranks are written.

Null URLs and URLs without "://" have empty host and path, no rule and the verdict of the
empty host (allow).  Pages that repeat give a row each and count as often; a null page_id is
kept; other columns are not read; an empty table gives no rows.  Ranks are rounded to 12 places before the comparison, so that the
order of summation cannot move a verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: (host, path, verdict) of the rules; a rule fits its host and all subdomains, and paths that start with its path.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
DAMPING = 0.85
ROUNDS = 10
RATIO = 1.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: What no browser reads as links, the base of relative links, and the links.
_UNREAD = r"(?is)<!--.*?-->|<script\b.*?</script\s*>"
_BASE = r"""(?i)<base\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?([^"'\s>]+)"""
_ABSOLUTE = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def named_host(link: Column) -> Column:
    """The host that a link names, empty for relative ones."""
    return F.translate(F.regexp_extract(link, _ABSOLUTE, 1), _UPPER, _LOWER)


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) of the pages' links between hosts, by count."""
    html = F.regexp_replace(F.coalesce(F.col("html").cast("string"), F.lit("")), _UNREAD, " ")
    read = pages.select(host_of(F.col("url")).alias("src"), html.alias("html"))
    links = read.select("src", named_host(F.regexp_extract("html", _BASE, 1)).alias("base"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("link"))
    relative = ~F.col("link").rlike(r"(?i)^(?:[a-z][a-z0-9+.-]*:|//|#)")
    linked = links.select("src", F.when(relative, F.col("base")).otherwise(named_host(F.col("link"))).alias("dst"))
    return linked.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def host_edges(pages: DataFrame, tree: bool = False) -> DataFrame:
    """(src, dst, weight) without loops: links, and with ``tree`` the domain tree both ways."""
    linked = link_edges(pages)
    if not tree:
        return linked
    names = pages.select(host_of(F.col("url")).alias("h")).distinct().unionByName(linked.select(F.col("dst").alias("h")).distinct()).where("h <> ''")
    labels = F.split("h", r"\.")
    # Every suffix of a host is a domain; neighbours in this chain are parent and child.
    chain = names.select(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")).alias("chain"))
    steps = chain.where(F.size("chain") > 1).select(F.explode(F.arrays_zip(F.slice("chain", 1, F.size("chain") - 1).alias("child"), F.slice("chain", 2, F.size("chain") - 1).alias("parent"))).alias("s"))
    steps_ = steps.select("s.child", "s.parent").distinct()
    both = steps_.select(F.col("child").alias("src"), F.col("parent").alias("dst")).unionByName(steps_.select(F.col("parent").alias("src"), F.col("child").alias("dst")))
    return linked.unionByName(both.withColumn("weight", F.lit(1.0))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(kind, host, rank): ``seeds`` are (kind, host, weight); kind "trust" follows edges, "distrust" goes against them."""
    forward = edges.select(F.lit("trust").alias("kind"), F.col("src"), F.col("dst"), "weight")
    backward = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    every = forward.unionByName(backward)
    out = every.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    moves = written(every.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share")), "moves")
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))
    start = written(seeds.join(total, "kind").select("kind", "host", (F.col("weight") / F.col("total")).alias("seed")), "seeds")
    ranks = start.select("kind", "host", F.col("seed").alias("rank"))
    for _ in range(rounds):
        sent = moves.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("r"))
        back = start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("r"))
        ranks = written(sent.unionByName(back).groupBy("kind", "host").agg(F.sum("r").alias("rank")), "ranks")
    return ranks


def judged(pages: DataFrame, rules=RULES, tree: bool = False) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules))
    kind = F.when(F.col("hit.verdict") == "allow", F.lit("trust")).otherwise(F.lit("distrust"))
    seeds = rows.where("hit is not null and host <> ''").groupBy(kind.alias("kind"), "host").agg(F.count("*").cast("double").alias("weight"))
    ranks = propagate(written(host_edges(pages, tree), "edges"), seeds)
    by_host = ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))).alias("distrust"))
    zero = F.lit(0.0)
    by_host = written(by_host.select("host", F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust")), "host-ranks")
    worse = F.round(F.coalesce("distrust", zero), 12) > F.round(F.coalesce("trust", zero) * RATIO, 12)
    return rows.join(by_host, "host", "left").select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), F.when(worse, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), F.round(F.coalesce("trust", zero), 9).alias("trust"), F.round(F.coalesce("distrust", zero), 9).alias("distrust"))


def op3_linkgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("trust", "distrust")


def _oracle() -> str:
    """The same in DuckDB: rules, edges from links, ROUNDS unrolled rounds."""
    fits = lambda h, p: f"((host = '{h}' OR host LIKE '%.{h}') AND path LIKE '{p}%')"
    ordered = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ordered) + " END"
    absolute = _ABSOLUTE
    rounds = ""
    for k in range(ROUNDS):
        prior = "(SELECT kind, host, seed AS rank FROM seeds)" if k == 0 else f"r{k - 1}"
        rounds += f",\nr{k} AS (SELECT kind, host, sum(r) AS rank FROM (SELECT m.kind, m.dst AS host, p.rank * m.share * {DAMPING} AS r FROM moves m JOIN {prior} p ON m.kind = p.kind AND m.src = p.host UNION ALL SELECT kind, host, seed * (1 - {DAMPING}::DOUBLE) FROM seeds) GROUP BY kind, host)"
    return f"""
WITH pg AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)) AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path, html FROM pages
),
hit AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS rv FROM pg),
read AS (SELECT host AS src, regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\\b.*?</script\\s*>', ' ', 'g') AS html FROM pg),
links AS (
  SELECT src, lower(regexp_extract(regexp_extract(html, '(?i)<base\\s[^>]*?href\\s*=\\s*["'']?([^"''\\s>]+)', 1), '{absolute}', 1)) AS base,
    unnest(regexp_extract_all(html, '(?i)\\b(?:href|src)\\s*=\\s*["'']?([^"''\\s>]+)', 1)) AS link FROM read
),
named AS (SELECT src, CASE WHEN regexp_matches(link, '(?i)^(?:[a-z][a-z0-9+.-]*:|//|#)') THEN lower(regexp_extract(link, '{absolute}', 1)) ELSE base END AS dst FROM links),
edges AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM named WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
every AS (SELECT 'trust' AS kind, src, dst, weight FROM edges UNION ALL SELECT 'distrust', dst, src, weight FROM edges),
moves AS (SELECT kind, src, dst, weight / sum(weight) OVER (PARTITION BY kind, src) AS share FROM every),
raw_seeds AS (SELECT CASE rv WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*)::DOUBLE AS weight FROM hit WHERE rv IS NOT NULL AND host <> '' GROUP BY 1, 2),
seeds AS (SELECT kind, host, weight / sum(weight) OVER (PARTITION BY kind) AS seed FROM raw_seeds){rounds},
by_host AS (SELECT host, coalesce(sum(rank) FILTER (WHERE kind = 'trust'), 0) AS trust, coalesce(sum(rank) FILTER (WHERE kind = 'distrust'), 0) AS distrust FROM r{ROUNDS - 1} GROUP BY host)
SELECT page_id, h.host, path, rule, coalesce(rv, CASE WHEN round(coalesce(distrust, 0), 12) > round(coalesce(trust, 0) * {RATIO}, 12) THEN 'block' ELSE 'allow' END) AS verdict
FROM hit h LEFT JOIN by_host b ON h.host = b.host
"""


ORACLE_SQL = _oracle()
