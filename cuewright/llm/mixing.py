"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is (target weight x total rows) / (rows of the source).  A
document's count is the inverse of the Poisson distribution with that mean at a number in
[0, 1) hashed from the seed and the doc_id (md5, so that other engines can repeat it).  A
document is exploded by its count, and the copies are ordered by a hash of seed, doc_id
and copy: a global shuffle that depends on nothing but the rows.

All steps are DataFrame expressions.  The sources' counts are one grouped sum.  Means are
broadcast where there are MAX_BROADCAST sources at most (counted first); beyond that the
join is salted, so that no source, however large, meets in one task.  A mean over
PART_MEAN is split into equal parts whose counts add up, so that exp(-mean) stays a normal
number.  A null source is a source of its own; rows that repeat draw the same count; rows
with a null doc_id draw by a hash of their text, so they neither stand nor fall together;
null texts are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written

SEED = "mix-1"
#: Largest mean that is inverted in one step.
PART_MEAN = 64.0
#: Sources whose means are broadcast at most, and salts of the join beyond that.
MAX_BROADCAST = 100_000
SALTS = 64


def uniform(*parts) -> F.Column:
    """A number in [0, 1) from 52 bits of the md5 of the parts."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _identity() -> F.Column:
    """The doc_id as text, or a hash of the text where it is null."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null-"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))))


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(source, mean): ``weights`` are targets by source, 1 for those not named; null counts as a source."""
    named = F.coalesce(F.col("source").cast("string"), F.lit("\u0000null")).alias("mix_source")
    counts = docs.groupBy(named).agg(F.count("*").alias("rows"))
    if weights:
        named_weights = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "mix_source string, weight double")
        counts = counts.join(named_weights, "mix_source", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    else:
        counts = counts.withColumn("weight", F.lit(1.0))
    counts = written(counts, "sources")
    all_rows, all_weight = counts.agg(F.sum("rows"), F.sum("weight")).first()  # two numbers
    return counts.select("mix_source", (F.col("weight") / F.lit(all_weight) * F.lit(all_rows) / F.col("rows")).alias("mean"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = SEED) -> DataFrame:
    """The documents' own columns and ``mix_copy`` (from 1), ``mix_copies`` and ``mix_key``, in the order of mix_key.

    Columns of the documents that have these three names are replaced; names that begin with mix_ are reserved.
    """
    spark = docs.sparkSession
    docs = docs.drop("mix_copy", "mix_copies", "mix_key")
    rates = repetition_rates(docs, weights)
    rows = docs.withColumn("mix_source", F.coalesce(F.col("source").cast("string"), F.lit("\u0000null")))
    if rates.count() <= MAX_BROADCAST:
        rows = rows.join(F.broadcast(rates), "mix_source")
    else:
        salt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int")
        rows = rows.withColumn("mix_salt", salt).join(rates.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["mix_source", "mix_salt"])
    rows = rows.withColumn("mix_parts", F.greatest(F.lit(1), F.ceil(F.col("mean") / PART_MEAN)).cast("int")).withColumn("mix_mean", F.col("mean") / F.col("mix_parts"))
    rows = rows.withColumn("mix_draws", F.sequence(F.lit(1), F.col("mix_parts")))
    each = F.transform("mix_draws", lambda j: F.struct(uniform(F.lit(seed), _identity(), j.cast("string")).alias("u")))
    rows = rows.withColumn("mix_draws", each)
    # Least k with P(N <= k) > u, found along the running sum; one pass for each part of the mean.
    last = "cast(ceil(mix_mean + 12 * sqrt(mix_mean) + 30) as int)"
    count = F.expr(
        f"aggregate(mix_draws, 0, (n, d) -> n + aggregate(sequence(1, {last}), struct(exp(-mix_mean) as p, exp(-mix_mean) as c, 0 as k),"
        " (s, i) -> case when s.c > d.u then s else struct(s.p * mix_mean / i as p, s.c + s.p * mix_mean / i as c, i as k) end, s -> s.k))"
    )
    rows = rows.withColumn("mix_copies", count).where("mix_copies > 0")
    rows = rows.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    key = F.md5(F.concat_ws(":", F.lit(seed + "-order"), _identity(), F.col("mix_copy").cast("string")).cast("binary"))
    rows = rows.withColumn("mix_key", key).select(*docs.columns, "mix_copy", "mix_copies", "mix_key")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The key is uniform: its first digits give equal ranges without a sampling pass over the texts.
    place = F.floor(F.conv(F.substring("mix_key", 1, 6), 16, 10).cast("long") * n / F.lit(1 << 24)).cast("int")
    return rows.withColumn("mix_range", place).repartitionById(n, F.col("mix_range")).sortWithinPartitions("mix_key").drop("mix_range")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir))


ORACLE_SQL = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM counts) * (SELECT sum(n) FROM counts)::DOUBLE / n AS mean FROM counts),
parts AS (SELECT source, mean / greatest(1, ceil(mean / 64.0)) AS mean, greatest(1, ceil(mean / 64.0))::INTEGER AS parts FROM rates),
steps AS (
  WITH RECURSIVE cdf(source, mean, parts, k, p, c) AS (
    SELECT source, mean, parts, 0, exp(-mean), exp(-mean) FROM parts
    UNION ALL
    SELECT source, mean, parts, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf
    WHERE k < ceil(mean + 12 * sqrt(mean) + 30)
  ) SELECT * FROM cdf
),
draws AS (
  SELECT d.doc_id, d.source, j, ('0x' || substr(md5('mix-1:' || d.doc_id || ':' || j), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, generate_series(1, p.parts) g(j)
),
counted AS (
  SELECT doc_id, d.source, j, u, least(count(*) FILTER (WHERE s.c <= u), max(s.k)) AS k
  FROM draws d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source GROUP BY ALL
),
copies AS (SELECT doc_id, sum(k)::INTEGER AS mix_copies FROM counted GROUP BY doc_id)
SELECT d.*, i::INTEGER AS mix_copy, mix_copies, md5('mix-1-order:' || d.doc_id || ':' || i) AS mix_key
FROM documents d JOIN copies c ON d.doc_id = c.doc_id, generate_series(1, c.mix_copies) g(i)
"""
