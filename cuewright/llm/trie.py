"""Conversation prefix trie by fixed-length block hashing.

A conversation is a sequence of turns; a node of the trie is a distinct sequence of first
turns.  Conversations are cut into blocks of BLOCK turns.  A turn's digest is mixed with its
depth into two 64-bit lanes, a block's digest is the exclusive or of its turns' lanes, and
the exclusive or of all lanes up to a place names the prefix there; so prefixes come from
running totals, which need no walk through a conversation in order.

1. Conversations are grouped by successive block digests: one row for each distinct block
   under each distinct prefix, with its number of conversations and the least of them.  Copies,
   however many, are one row from here on.
2. Only where blocks that follow one prefix differ are their turns looked at: each distinct
   block gives its turns' prefixes, and equal ones are added up.  Elsewhere all conversations
   of a prefix go through the same block, whose nodes are written down as they are.
3. Sums over subtrees come from members: a node's subtree holds the rest of each of its members.
   Each node counts once, with the least of its members; from some depth on a conversation is the
   least member of every node that it passes, and there it counts as the first of its kind.  So a
   subtree's sum is a sum over members of sums over their later turns.

Every step is a grouping or a running total in two levels; no step gathers a conversation, a
node's members or a subtree in a task, except that the digest of a node's members streams
through one hash in pieces.

Null roles and texts are empty; a null turn comes first; turns with equal numbers are ordered by
their digests, and rows that repeat are turns of their own; rows with a null conv_id belong to
no conversation and are left out; other columns are not read; an empty table gives no nodes.
Prefixes are compared by 128 bits of hashes of MD5 digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_keys, written

BLOCK = 8
#: Rows that a task numbers or adds up at a time under one conversation.
STRETCH = 1024
#: Bytes of conversation numbers that are hashed as one piece.
PIECE = 1 << 16
#: A word, as in the other operators.
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "l1", "l2"]


def running(rows: DataFrame, key: str, at: str, columns: list[str], total: Callable, both: Callable[[Column, Column], Column], reverse: bool = False) -> DataFrame:
    """``rows`` with the total of each column over the rows of its key up to this one (from the end on with ``reverse``), in ``<column>_run``.

    Two levels: inside stretches of STRETCH places, then over the stretches' totals, so that a
    key with very many rows is not added up in one task.
    """
    order = F.desc if reverse else F.asc
    rows = rows.withColumn("_stretch", F.floor(F.col(at) / STRETCH))
    inner = Window.partitionBy(key, "_stretch").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(key).orderBy(order("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, "_stretch").agg(*[total(c).alias(f"_{c}") for c in columns])
    carried = totals.select(key, "_stretch", *[F.coalesce(total(f"_{c}").over(outer), F.lit(0)).alias(f"_{c}") for c in columns])
    out = rows.withColumns({f"{c}_run": total(c).over(inner) for c in columns}).join(carried, [key, "_stretch"])
    return out.withColumns({f"{c}_run": both(F.col(f"{c}_run"), F.col(f"_{c}")) for c in columns}).drop("_stretch", *[f"_{c}" for c in columns])


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, words): the turns of each conversation in order, depth from 1 on; texts are left behind."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written, which fixes the places; they ascend along the sort, so a stretch of places is a stretch of each conversation.
    rows = written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "trie-turns")
    rows = rows.withColumn("stretch", F.floor(F.col("place") / STRETCH))
    parts = rows.groupBy("conv_id", "stretch").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("conv_id", "stretch", (before - F.col("first") + 1).alias("shift"))
    return rows.join(parts, ["conv_id", "stretch"]).select("conv_id", (F.col("place") + F.col("shift")).alias("depth"), "digest", "words")


def blocks_of(turns: DataFrame) -> DataFrame:
    """(conv_id, block, n_turns, turns, p1, p2, q1, q2): turns in blocks; p: prefix with the block, q: prefix before it."""
    lanes = [F.xxhash64(F.lit(i), "depth", "digest").alias(f"d{i}") for i in (1, 2)]
    rows = turns.select("conv_id", "depth", F.floor((F.col("depth") - 1) / BLOCK).alias("block"), "words", *lanes)
    turn = F.struct("depth", "d1", "d2", "words")
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.count("*").alias("n_turns"), F.bit_xor("d1").alias("b1"), F.bit_xor("d2").alias("b2"))
    blocks = running(blocks, "conv_id", "block", ["b1", "b2"], F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    return blocks.select("conv_id", "block", "n_turns", "turns", F.col("b1_run").alias("p1"), F.col("b2_run").alias("p2"), F.col("b1").bitwiseXOR(F.col("b1_run")).alias("q1"), F.col("b2").bitwiseXOR(F.col("b2_run")).alias("q2"))


#: What tells apart a block under its prefix.
SAME = ["block", "n_turns", "p1", "p2"]


def grouped(blocks: DataFrame) -> DataFrame:
    """(SAME, q1, q2, n, conv_id, turns, diverges): distinct blocks under distinct prefixes, with their number of conversations and the least one."""
    groups = blocks.groupBy(*SAME).agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    prefix = ["block", "q1", "q2"]
    # The first blocks all follow the empty prefix: they count as diverging without a look.
    several = groups.where("block > 0").groupBy(*prefix).agg(F.count("*").alias("kinds")).where("kinds > 1").select(*prefix, F.lit(True).alias("several"))
    flagged = groups.where("block > 0").join(several, prefix, "left").withColumn("diverges", F.coalesce("several", F.lit(False))).drop("several")
    flagged = flagged.unionByName(groups.where("block = 0").withColumn("diverges", F.lit(True)))
    return flagged.join(blocks.select("conv_id", "block", "turns"), ["conv_id", "block"])


def turn_rows(groups: DataFrame, *more: Column) -> DataFrame:
    """A row for each turn of each distinct block: KEY of its node, t1, t2 of the parent, words, and the group's columns."""

    def lane(i: str) -> Column:
        return F.transform("turns", lambda _, at: F.aggregate(F.slice("turns", F.lit(1), at + 1), F.col(f"q{i}"), lambda s, x: s.bitwiseXOR(x[f"d{i}"])))

    rows = groups.withColumn("_l1", lane("1")).withColumn("_l2", lane("2"))
    rows = rows.select("*", F.posexplode(F.arrays_zip("turns", "_l1", "_l2")).alias("_at", "_t"))
    turn = F.col("_t.turns")
    return rows.select(
        turn["depth"].alias("depth"), F.col("_t._l1").alias("l1"), F.col("_t._l2").alias("l2"),
        F.col("_t._l1").bitwiseXOR(turn["d1"]).alias("t1"), F.col("_t._l2").bitwiseXOR(turn["d2"]).alias("t2"),
        "conv_id", "n", "diverges", *more,
    )


def merged(rows: DataFrame, sums: list[str]) -> DataFrame:
    """Nodes of ``turn_rows``: those of diverging blocks are added up, the others stand."""
    keep = [*KEY, "t1", "t2", "conv_id", *sums]
    apart = rows.where("not diverges").select(*keep)
    together = rows.where("diverges").groupBy(*KEY).agg(F.min("t1").alias("t1"), F.min("t2").alias("t2"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums])
    return apart.unionByName(together.select(*keep))


def member_digests(ends: DataFrame) -> DataFrame:
    """(KEY, ends_sha256) of rows (KEY, conv_id): SHA-256 of each node's conv_ids, ascending and joined by commas.

    A range sort deals even one node's ids over many tasks, which join them to pieces; the
    pieces of a node then stream through one hash, a piece at a time.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def groups(batch: pa.RecordBatch):
        keys = [batch.column(c).to_numpy() for c in KEY]
        change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield tuple(int(k[a]) for k in keys), a, b

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = PIECE // 8
        for batch in batches:
            ids, out = batch.column("conv_id").to_pylist(), []
            for key, a, b in groups(batch):
                out += [(*key, ids[at], ",".join(map(str, ids[at : min(at + step, b)]))) for at in range(a, b, step)]
            if out:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*out))[:4]), pa.array([x[4] for x in out], pa.string())], names=[*KEY, "first", "piece"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, state = None, None

        def told(rows):
            return pa.RecordBatch.from_arrays([*(pa.array([r[0][i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[1] for r in rows], pa.string())], names=[*KEY, "ends_sha256"])

        for batch in batches:
            text, out = batch.column("piece"), []
            for key, a, b in groups(batch):
                if key != open_:
                    if open_ is not None:
                        out.append((open_, state.hexdigest()))
                    open_, state, first = key, hashlib.sha256(), True
                for at in range(a, b):
                    state.update(text[at].as_py().encode() if first else b"," + text[at].as_py().encode())
                    first = False
            if out:
                yield told(out)
        if open_ is not None:
            yield told([(open_, state.hexdigest())])

    kinds = "depth long, l1 long, l2 long, "
    by_node = [F.col(c) for c in ("l1", "l2", "depth")]
    sorted_ = ends.select(*KEY, "conv_id").repartitionByRange(n, *by_node, "conv_id").sortWithinPartitions(*by_node, "conv_id")
    cut = sorted_.mapInArrow(pieces, kinds + "first long, piece string")
    return cut.repartition(n, *KEY).sortWithinPartitions(*by_node, "first").mapInArrow(digests, kinds + "ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The trie's nodes: KEY, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has (conv_id, depth, digest, words), depths from 1 on without gaps; ``conversations``
    one row (conv_id, n_turns) for each conversation, turnless ones included.
    """
    blocks = written(blocks_of(turns), "trie-blocks")
    groups = written(grouped(blocks), "trie-groups")
    first = merged(turn_rows(groups), ["n"])
    # Where conversations end: the prefix with their last block.
    last = blocks.join(conversations.where("n_turns > 0").select("conv_id", F.floor((F.col("n_turns") - 1) / BLOCK).alias("block"), F.col("n_turns").alias("depth")), ["conv_id", "block"])
    root = [F.lit(0).cast("long").alias(c) for c in KEY]
    ends = written(last.select(*KEY[:1], F.col("p1").alias("l1"), F.col("p2").alias("l2"), "conv_id").unionByName(conversations.where("n_turns = 0").select(*root, "conv_id")), "trie-ends")
    n_ends = ends.groupBy(*KEY).agg(F.count("*").alias("n_ends"))
    # Of each conversation: the depth from which on it is the least member, and whether its end is a leaf that counts by it.
    least = first.join(n_ends, KEY, "left").groupBy("conv_id").agg(F.min("depth").alias("own"), F.max((F.col("n") == F.coalesce("n_ends", F.lit(0))).cast("long")).alias("leaf"))
    repeats = F.filter("turns", lambda x: F.col("own").isNull() | (x["depth"] < F.col("own")))
    weighed = blocks.join(least, "conv_id", "left").withColumn("words", F.aggregate(repeats, F.lit(0).cast("long"), lambda s, x: s + x["words"])).drop("turns")
    weighed = running(weighed, "conv_id", "block", ["words"], F.sum, lambda a, b: a + b, reverse=True)
    weighed = written(weighed.select("conv_id", *SAME, "own", F.coalesce("leaf", F.lit(0)).alias("leaf"), (F.col("words_run") - F.col("words")).alias("later"), "words_run"), "trie-weights")
    summed = weighed.groupBy(*SAME).agg(F.sum("leaf").alias("n_leaves"), F.sum("later").alias("later"), F.min_by("own", "conv_id").alias("own"))
    counted = F.col("n") - 1
    rest = F.aggregate(F.slice("turns", F.col("_at") + 1, F.lit(BLOCK)), F.lit(0).cast("long"), lambda s, x: s + x["words"] * (counted + F.when(F.col("own").isNull() | (x["depth"] < F.col("own")), 1).otherwise(0)))
    rows = turn_rows(groups.join(summed, SAME), "n_leaves", (F.col("later") + rest).alias("saved_tokens"))
    nodes = merged(rows, ["n", "n_leaves", "saved_tokens"])
    # The root; with turnless conversations only, it is the one leaf.
    total = weighed.where("block = 0").agg(F.coalesce(F.sum("words_run"), F.lit(0)).alias("saved_tokens"), F.greatest(F.coalesce(F.sum("leaf"), F.lit(0)), F.lit(1)).alias("n_leaves"))
    top = conversations.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).where("n > 0").withColumns({c: F.lit(0).cast("long") for c in KEY} | {c: F.lit(None).cast("long") for c in ("t1", "t2")})
    nodes = written(nodes.unionByName(top.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one").drop("_one")), "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("t1").alias("l1"), F.col("t2").alias("l2")).agg(F.count("*").alias("n_children"))
    parents = nodes.join(children, KEY).select((F.col("depth") + 1).alias("depth"), F.col("l1").alias("t1"), F.col("l2").alias("t2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    under = join_keys(nodes.where("depth > 0"), parents, ["depth", "t1", "t2"], "_n")
    out = under.unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = out.join(children, KEY, "left").join(member_digests(ends), KEY, "left")
    return out.select(*KEY, "conv_id", "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of a table (conv_id, turn, role, text) as it is."""
    turns = written(numbered(conversations), "trie-numbered")
    return prefix_trie(turns, turns.groupBy("conv_id").agg(F.count("*").alias("n_turns")))


def with_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes with role and text of their last turn (null at the root), read from their least conversation.

    Turns are found by their digest and depth.
    """
    turns = numbered(conversations).select("conv_id", "depth", "digest")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    texts = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), role, text).withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))).dropDuplicates(["conv_id", "digest"])
    return nodes.join(turns, ["conv_id", "depth"], "left").join(texts, ["conv_id", "digest"], "left").drop("digest")


#: Conversations that share their first turns with the first of so many.
FAMILY = 20


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) for ``prefix_trie``: conversation c begins with the first h turns of c - c % FAMILY, then has
    its own after its first h; h is crc32(c) % 4."""
    own = written(numbered(conversations), "trie-numbered")
    lengths = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = lengths.select("conv_id", "n", base.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).alias("h"))
    convs = convs.join(lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left").withColumn("lead", F.least("h", F.coalesce("there", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "h", "lead", (F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")), "trie-convs")
    heads = own.where("depth <= 3").withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base").where("depth <= h").select("conv_id", "depth", "digest", "words")
    tails = own.join(convs.select("conv_id", "h", "lead"), "conv_id").where("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("lead")).alias("depth"), "digest", "words")
    return heads.unionByName(tails), convs.select("conv_id", "n_turns")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie(*rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: crc32 of a number's digits, bit by bit, by the reflected polynomial.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}::VARCHAR, ''), d -> list_transform(range(8), i -> (ascii(d)::BIGINT >> i) & 1)))),
  (x, b) -> xor(x >> 1, (xor(x, b) & 1) * 3988292384)), 4294967295::BIGINT)"""

ORACLE_SQL = r"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, count(*) AS n, CRC % 4 AS h FROM t GROUP BY ALL),
head AS (SELECT c.conv_id, t.p, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.p <= c.h),
r AS (SELECT * FROM head UNION ALL SELECT t.conv_id, t.p - c.h + (SELECT count(*) FROM head WHERE head.conv_id = c.conv_id), t.role, t.text FROM t JOIN c USING (conv_id) WHERE t.p > c.h),
k AS (SELECT conv_id, p AS depth, sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER w) AS key, sha256(coalesce(string_agg(sha256(length(role) || ':' || role || text), '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS up,
  len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY p)
  UNION ALL SELECT conv_id, 0, sha256(''), NULL, 0 FROM c),
e AS (SELECT depth, key, string_agg(conv_id, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(key, depth) AS key, max(depth) AS depth FROM k GROUP BY 1) GROUP BY ALL),
nodes AS (SELECT depth, key, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM k GROUP BY 1, 2),
kids AS (SELECT up AS key, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
below AS (SELECT k.depth, k.key, sum((n.n_convs - 1) * n.words) AS saved_tokens, count(*) FILTER (WHERE kids.key IS NULL) AS n_leaves
  FROM nodes n JOIN k ON k.conv_id = n.conv_id AND k.depth <= n.depth LEFT JOIN kids ON kids.key = n.key AND kids.depth = n.depth GROUP BY ALL)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n_children, 0)::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN below b ON b.depth = n.depth AND b.key = n.key LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.up LEFT JOIN kids ON kids.depth = n.depth AND kids.key = n.key LEFT JOIN e ON e.depth = n.depth AND e.key = n.key""".replace("CRC", _CRC.format("conv_id")).replace("d ->", "lambda d:").replace("i ->", "lambda i:").replace("(x, b) ->", "lambda x, b:")
