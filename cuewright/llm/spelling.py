"""Spelling variants: words that differ by one letter, by a bit-sliced position index.

The vocabulary is cut into buckets.  Two words that differ by one inserted, deleted or replaced
code point agree outside of one stretch of places, so each word goes to a bucket for each half of
its places (for its own length, and for one less as the longer word of a pair), named by what
stands outside of that half.  A bucket of more than BUCKET words is split by halves of its open
stretch, and so on; with one place open, the alphabet bounds it.  So a pair of near words meets in
exactly one bucket, and no bucket grows with the vocabulary.

A bucket's index has one bitset over its words for each (place, letter).  A query word is read
letter by letter; three sets run along, word-parallel: the words without an error so far, those
with one replaced letter, and those with one letter more or less, which are looked up one place
further on or back.  The words of a bucket are numbered by falling count, so that the lowest bit
of the result is the most frequent near word; the number of bits is the number of near words.
No pair leaves the bucket.

Null texts have no words; a null doc_id counts as the empty string; rows that repeat count again;
words and texts of any length are taken whole; other columns are not read; an empty table gives no
words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written

#: What a run is made of, the deletion of one letter in 97 runs, the least length and count of words.
RUN, NOISE, LEAST_LENGTH, LEAST_COUNT = "[a-zÀ-ÿ]+", 97, 5, 3
#: A form has at least so many times its word's count.
RATIO = 2
#: Words of a bucket beyond which its open stretch is halved.
BUCKET = 2048

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, noise: int = NOISE) -> DataFrame:
    """(word, n) of the texts' words; of every run whose hash ``noise`` divides one letter is left out (0: of none)."""
    runs = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(RUN), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(runs).alias("run")).where(F.length("run") >= LEAST_LENGTH)
    if noise:
        h = F.crc32(F.concat(F.col("doc_id"), F.lit(":"), F.col("run")).cast("binary"))
        at = (F.col("h") % F.length("run")).cast("int")
        rows = rows.withColumn("h", h).withColumn("run", F.when(F.col("h") % noise == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run")))
    return rows.where(F.length("run") >= LEAST_LENGTH).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _open(m: Column, lo: Column, hi: Column) -> Column:
    """The open stretch [lo, hi) of places of the shorter length m."""
    return F.struct(m.cast("int").alias("m"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the name of their bucket: the shorter length, the stretch, and the word without it."""
    tail = F.col("m") - F.col("hi")
    return rows.withColumn("bucket", F.concat_ws("|", "m", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), F.substring("word", F.length("word") - tail + 1, tail)))


def buckets(words: DataFrame) -> DataFrame:
    """(word, n, m, lo, hi, bucket): the memberships of each word, split until no bucket is over BUCKET."""
    m = F.length("word")
    half = F.floor(F.col("m") / 2)
    rows = words.select("word", "n", F.explode(F.when(m > LEAST_LENGTH, F.array(m, m - 1)).otherwise(F.array(m))).alias("m"))
    rows = _keyed(rows.select("word", "n", F.explode(F.array(_open(F.col("m"), F.lit(0), half), _open(F.col("m"), half, F.col("m")))).alias("_s")).select("word", "n", "_s.*"))
    done = None
    while True:
        large = written(rows.where("hi - lo > 1").groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > BUCKET).select("bucket"), "spelling-large")
        fits = rows.join(large, "bucket", "left_anti")
        done = fits if done is None else done.unionByName(fits)
        if large.isEmpty():
            return done
        mid = F.floor((F.col("lo") + F.col("hi")) / 2)
        cut = rows.join(large, "bucket", "left_semi").select("word", "n", F.explode(F.array(_open(F.col("m"), F.col("lo"), mid), _open(F.col("m"), mid, F.col("hi")))).alias("_s"))
        rows = written(_keyed(cut.select("word", "n", "_s.*")), "spelling-split")


def near_sets(rests: list[str], width: int, last: bool) -> list[int]:
    """For each string the set, as bits, of those that differ from it by one letter.

    The strings have ``width`` letters or one more; two of the greater length are not compared.
    A pair whose extra letter stands at the very end is left to the next stretch unless this is
    the ``last``.
    """
    at: dict[tuple[int, str], int] = {}
    short = 0
    for i, rest in enumerate(rests):
        bit = 1 << i
        if len(rest) == width:
            short |= bit
        for place in enumerate(rest):
            at[place] = at.get(place, 0) | bit
    everything = (1 << len(rests)) - 1
    long = everything & ~short
    out = []
    for rest in rests:
        zero = everything
        if len(rest) == width:
            replaced = more = 0
            for i, c in enumerate(rest):
                hit = at[i, c]
                more = (more | zero) & at.get((i + 1, c), 0)
                replaced = replaced & hit | zero & ~hit
                zero &= hit
            more = more | zero if last else more & ~zero
            out.append(replaced & short | more & long)
        else:
            less = before = 0
            for i, c in enumerate(rest):
                before = zero
                less = less & at.get((i - 1, c), 0) | zero
                zero &= at[i, c]
            out.append((less if last else less & ~before) & short)
    return out


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, near, near_n) of each bucket's words with a near word; the rows come sorted by bucket."""
    name, rows, out = None, [], []

    def close() -> None:
        if len(rows) < 2:
            return
        rows.sort(key=lambda r: (-r[1], r[0]))
        width, last = rows[0][3], rows[0][4]
        for (word, *_), found in zip(rows, near_sets([r[2] for r in rows], width, last)):
            if found:
                best = rows[(found & -found).bit_length() - 1]
                out.append((word, found.bit_count(), best[0], best[1]))

    def told() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["word", "n_near", "near", "near_n"])

    for batch in batches:
        for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "word", "n", "rest", "width", "last"))):
            if bucket != name:
                close()
                name, rows = bucket, []
            rows.append(row)
        if out:
            yield told()
            out = []
    close()
    if out:
        yield told()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n): number of near words and the most frequent of them (the first in code-point order on ties); words without any are left out."""
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = F.substring("word", F.col("lo") + 1, F.length("word") - F.col("lo") - (F.col("m") - F.col("hi")))
    rows = buckets(words).select("bucket", "word", "n", rest.alias("rest"), (F.col("hi") - F.col("lo")).alias("width"), (F.col("hi") == F.col("m")).alias("last"))
    found = rows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_search, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select("word", "n_near", F.col("_b.near").alias("near"), (-F.col("_b.less")).alias("near_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last by doubling; counts grow along a chain, so it ends."""
    reached = links.select("word", F.col("form").alias("root"))
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        reached = written(reached.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-roots")
        settled = reached.where("moved").isEmpty()
        reached = reached.drop("moved")
        if settled:
            return reached


def variants(docs: DataFrame, noise: int = NOISE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the vocabulary."""
    words = written(vocabulary(docs, noise), "spelling-words")
    near = words.join(near_words(words), "word", "left")
    kept = F.col("near_n") >= RATIO * F.col("n")
    rows = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(kept, F.col("near")).alias("form"), F.when(kept, F.col("near_n")).alias("form_n")), "spelling-forms")
    found = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(found, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


#: Near words by what stands before and after one place (replaced), and by leaving out each letter of the longer word.
ORACLE_SQL = r"""WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
b AS (SELECT run, n, list_transform(range(octet_length(encode(doc_id || ':' || run))), j -> ('0x' || substr(hex(encode(doc_id || ':' || run)), 2 * j + 1, 2))::BIGINT) AS bytes FROM r),
h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(bytes, d -> list_transform(range(8), i -> (d >> i) & 1)))), (x, y) -> xor(x >> 1, (xor(x, y) & 1) * 3988292384)), 4294967295::BIGINT) AS h FROM b),
w AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
q AS (SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM p),
near AS (SELECT a.word, b.word AS x, b.n FROM q a JOIN q b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT q.word, w.word, w.n FROM q JOIN w ON w.word = q.head || q.tail UNION SELECT w.word, q.word, q.n FROM q JOIN w ON w.word = q.head || q.tail),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY 1),
form AS (SELECT w.word, w.n, coalesce(best.n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 2 * w.n THEN (SELECT min(x) FROM near WHERE near.word = w.word AND near.n = best.top) END AS form, CASE WHEN top >= 2 * w.n THEN top END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM form UNION ALL SELECT chain.word, form.form FROM chain JOIN form ON form.word = chain.root WHERE form.form IS NOT NULL)
SELECT form.word, form.form, chain.root, form.n, form.n_near, form.form_n FROM form JOIN chain USING (word) WHERE NOT EXISTS (SELECT 1 FROM form f WHERE f.word = chain.root AND f.form IS NOT NULL)""".replace("j ->", "lambda j:").replace("d ->", "lambda d:").replace("i ->", "lambda i:").replace("(x, y) ->", "lambda x, y:")
