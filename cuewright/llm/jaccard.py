"""N-gram Jaccard join as a T-occurrence search, and the groups that its links form.

Two documents link when 100 * |A & B| >= 85 * |A | B| over their sets of word shingles
(4 words here; near-copy stages elsewhere take 5 words and 0.8).

Plan:

1. Rows with equal sets form a class, with a number of its own and its least doc_id.
2. Overlap bound.  Linked sets of sizes m <= n share T(n) = ceil(85 n / 100) shingles at
   least.  Under one global order (by hash), the first n - T + 1 + s shingles of both hold
   s + 1 common ones: that is the T-occurrence bound on prefixes.  Each class indexes that
   prefix; an inverted list of one document is dropped.
3. DivideSkip on Spark: lists of up to ``LONG_LIST`` documents are short and are merged (a
   self join on the shingle, summed per pair); longer ones are never merged.  What the
   long lists could add to a pair is bounded by the number of long lists that a document
   is on, so the merged count must reach s + 1 minus that number.
4. Documents on more long lists than that bound allows are dense (near copies of one
   text).  Their whole sets are indexed again by list length, shortest lists first, which
   leaves long lists only to the core of such a group; each list links its documents to
   its least one: a star, not all pairs.
5. Candidate links fall into components.  Each component is cut into blocks of bounded
   size and each pair of blocks is one task that runs DivideSkip on the whole sets: short
   lists are merged by a heap, long ones probed by binary search, pairs that are connected
   already are skipped.  A task returns a spanning forest of its exact links.

Every candidate is checked exactly on whole sets and no list is cut, so no link is lost.
Rows are joined by their sets' fingerprints, so a doc_id may repeat with different texts.
Null and empty texts have no shingles and link with nothing; rows with a null doc_id link
with nothing and have a null component; rows that repeat are copies like others.  doc_ids may
have any type that can be ordered, and keep it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, documents, join_keys, kind_of, slices, written
from .words import distinct, mix, run_hashes, split_words

#: Documents on an inverted list beyond which the list is long.
LONG_LIST = 32
#: Shingles in a block of a candidate component.
BLOCK = 100_000


def shingle_sets(texts: pa.Array, words: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer words is one shingle."""
    w = split_words(texts, lower=lower)
    hashes, at = w.runs(words)
    cut = np.searchsorted(at, w.first)
    counts = w.counts()
    out = []
    for i in range(len(w)):
        if counts[i] >= words:
            out.append(distinct(hashes[cut[i] : cut[i + 1]]))
        elif counts[i]:
            own = w.hashes[w.first[i] : w.first[i + 1]]
            out.append(mix(run_hashes(own, len(own)) + np.uint64(len(own))))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def least_overlap(n, percent: int):
    """T(n): shingles that any partner shares with a set of n at least."""
    return (percent * n + 99) // 100


def slack(n: int, percent: int) -> int:
    """Shingles indexed beyond the prefix that alone is needed."""
    prefix = n - least_overlap(n, percent) + 1
    return min(n - prefix, prefix // 3 + 8)


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, f1, f2) of each set: its size and two sums of mixed hashes, 128 bits together."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    f1 = np.fromiter((int(mix(s).sum(dtype=np.uint64)) for s in sets), np.uint64, len(sets)).view(np.int64)
    f2 = np.fromiter((int(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)) for s in sets), np.uint64, len(sets)).view(np.int64)
    return n, f1, f2


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text, which tells rows apart whose doc_id repeats."""
    return docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))


def signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n, f1, f2, prefix): set size, a 128-bit fingerprint of the set and its indexed prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = shingle_sets(b["text"], words)
            n, f1, f2 = fingerprints(sets)
            heads = [s[: k - least_overlap(k, percent) + 1 + slack(k, percent)] if k else s for s, k in zip(sets, n.tolist())]
            offsets = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
            flat = np.concatenate(heads).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_key"], pa.array(n), pa.array(f1), pa.array(f2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "text_key", "n", "f1", "f2", "prefix"])

    return _keyed(docs).mapInArrow(run, f"doc_id {kind_of(docs)}, text_key long, n long, f1 long, f2 long, prefix array<long>")


def heap_merge(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """(value, count) of the values that stand on ``need`` of the ascending lists at least.

    The heads of all lists are in a heap.  A head on too few lists is left behind together
    with the next ones: with ``need - 1`` lists taken off, no value below the new head can
    reach ``need``, and these lists go on from that head by binary search.
    """
    heap = [(x[0], i) for i, x in enumerate(lists) if x]
    heapify(heap)
    at = [0] * len(lists)
    out = []
    while len(heap) >= need:
        value, taken = heap[0][0], []
        while heap and heap[0][0] == value:
            taken.append(heappop(heap)[1])
        if len(taken) >= need:
            out.append((value, len(taken)))
            target = value + 1
        else:
            while heap and len(taken) < need - 1:
                taken.append(heappop(heap)[1])
            if not heap:
                break
            target = heap[0][0]
        for i in taken:
            at[i] = bisect_left(lists[i], target, at[i])
            if at[i] < len(lists[i]):
                heappush(heap, (lists[i][at[i]], i))
    return out


def divide_skip(sets: list[np.ndarray], percent: int, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets, found by T-occurrence searches.

    Sets are taken by size; each searches those before it.  Of its inverted lists the
    longest L < T are set aside, the others are merged by a heap, and sets counted at
    least T - L times are probed in the long lists by binary search.  The sets before it
    are searched from the nearest on in growing stretches; what is connected to it by then
    is left out of the lists of the next stretch.  With ``group``, only sets of different
    groups meet.
    """
    k = len(sets)
    order = sorted(range(k), key=lambda i: len(sets[i]))
    sizes = np.fromiter((len(sets[i]) for i in order), np.int64, k)
    owner = np.repeat(np.arange(k), sizes)
    tokens = np.concatenate([sets[i] for i in order]) if k else np.empty(0, np.uint64)
    by_token = np.argsort(tokens, kind="stable")
    postings = owner[by_token]
    sorted_tokens = tokens[by_token]
    new = np.append(True, sorted_tokens[1:] != sorted_tokens[:-1]) if len(tokens) else np.empty(0, bool)
    starts = np.append(np.flatnonzero(new), len(tokens))
    list_of = np.empty(len(tokens), np.int64)
    list_of[by_token] = np.cumsum(new) - 1
    lengths = np.diff(starts)
    first = np.concatenate([[0], np.cumsum(sizes)])
    grouped = None if group is None else np.asarray(group)[order]
    links = []
    label = np.arange(k)
    members: dict[int, list[int]] = {i: [i] for i in range(k)}
    for x in range(k):
        n = int(sizes[x])
        t = least_overlap(n, percent)
        lists = list_of[first[x] : first[x + 1]]
        lists = lists[lengths[lists] > 1]
        if not n or len(lists) < t:
            continue
        lists = lists[np.argsort(lengths[lists], kind="stable")]
        n_long = min(t - 1, int(t / (0.02 * np.log2(int(lengths[lists[-1]]) + 1) + 1)))
        held = [postings[starts[j] : starts[j + 1]] for j in lists.tolist()]
        short, long = held[: len(held) - n_long], held[len(held) - n_long :]
        least = int(np.searchsorted(sizes[:x], -(-percent * n // 100)))  # smaller sets cannot link
        hi, stretch = x, 16
        while hi > least:
            lo = max(least, hi - stretch)
            open_ = label[lo:hi] != label[x]
            if grouped is not None:
                open_ &= grouped[lo:hi] != grouped[x]
            if open_.any():
                parts = [p[np.searchsorted(p, lo) : np.searchsorted(p, hi)] for p in short]
                found = heap_merge([p[open_[p - lo]].tolist() for p in parts if len(p)], t - n_long)
                if found:
                    y, overlap = (np.array(v) for v in zip(*found))
                    for p in long:
                        place = np.minimum(np.searchsorted(p, y), len(p) - 1)
                        overlap = overlap + (p[place] == y)
                    for z in y[100 * overlap >= percent * (n + sizes[y] - overlap)].tolist():
                        a, b = int(label[x]), int(label[z])
                        if a != b:
                            if len(members[a]) < len(members[b]):
                                a, b = b, a
                            label[members[b]] = a
                            members[a] += members.pop(b)
                            links.append((order[x], order[z]))
            hi, stretch = lo, stretch * 4
    return links


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(cid, shingles) of the classes in ``ids`` (cid, rep, n, f1, f2), from a row that has the class's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = shingle_sets(b["text"], words)
            n, f1, f2 = fingerprints(sets)
            keep = np.flatnonzero((n == b["n"].to_numpy()) & (f1 == b["f1"].to_numpy()) & (f2 == b["f2"].to_numpy()))
            if len(keep):
                yield pa.RecordBatch.from_arrays([b["cid"].take(pa.array(keep)), pa.array([sets[i].tobytes() for i in keep.tolist()], pa.binary())], names=["cid", "shingles"])

    joined = docs.select(F.col("doc_id").alias("rep"), F.col("text").cast("string").alias("text")).join(ids.select("cid", "rep", "n", "f1", "f2"), "rep")
    return joined.mapInArrow(run, "cid long, shingles binary").dropDuplicates(["cid"])


def _unpack(column: str):
    """A binary of little-endian 64-bit hashes as rows (cid, token)."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                h = np.frombuffer(b[column][i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), b["cid"][i].as_py())), pa.array(np.full(len(h), len(h))), pa.array(h)], names=["cid", "n", "token"])

    return run


def near_groups(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    return grouped_rows(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def grouped_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) of every row; (doc_id, text_key) names a row or rows that repeat."""
    sig = written(signatures(docs, words, percent), "signatures")
    can_link = "n > 0 and doc_id is not null"
    usable = sig.where(can_link)
    # A class is a set; its number is fixed by writing it.
    classes = usable.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    rows = classes.select("cid", F.col("n").cast("int").alias("n"), F.explode("prefix").alias("token"))
    lists = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    index = written(rows.join(lists, "token"), "index")

    def t_of(n):
        return F.expr(f"({percent} * {n} + 99) div 100")

    def slack_of(n):
        prefix = f"({n} - ({percent} * {n} + 99) div 100 + 1)"
        return F.expr(f"least({n} - {prefix}, {prefix} div 3 + 8)")

    longs = index.where(F.col("df") > LONG_LIST).groupBy("cid", "n").agg(F.count("*").alias("longs"))
    longs = written(longs.withColumn("partner", t_of("n")).withColumn("dense", F.col("longs") > slack_of("partner") - 1).select("cid", "longs", "dense"), "longs")
    short = index.where(F.col("df") <= LONG_LIST)
    a, b = short.select("token", F.col("cid").alias("x"), F.col("n").alias("nx")), short.select("token", F.col("cid").alias("y"), F.col("n").alias("ny"))
    pairs = a.join(b, "token").where(f"x < y and 100 * least(nx, ny) >= {percent} * greatest(nx, ny)").groupBy("x", "y", "nx", "ny").agg(F.count("*").alias("common"))
    # Few pairs are left below the bound even before long lists are looked up: a pair of which neither is on any long list.
    pairs = pairs.withColumn("bound", F.least(slack_of("nx"), slack_of("ny")) + 1)
    on_long = longs.select(F.col("cid"), "longs")
    pairs = pairs.join(on_long.withColumnsRenamed({"cid": "x", "longs": "lx"}), "x", "left").join(on_long.withColumnsRenamed({"cid": "y", "longs": "ly"}), "y", "left")
    pairs = written(pairs.where(F.col("common") >= F.col("bound") - F.least(F.coalesce("lx", F.lit(0)), F.coalesce("ly", F.lit(0)))).select("x", "y"), "pairs")
    dense = longs.where("dense").select("cid")
    wanted = pairs.select(F.col("x").alias("cid")).unionByName(pairs.select(F.col("y").alias("cid"))).unionByName(dense).distinct()
    sets = written(_sets(docs, wanted.join(classes.drop("prefix", "copies"), "cid"), words), "sets")
    tokens = written(sets.join(dense, "cid", "left_semi").mapInArrow(_unpack("shingles"), "cid long, n long, token long"), "dense")
    in_dense = tokens.groupBy("token").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("cid").orderBy("df", "token"))
    core = written(tokens.join(in_dense, "token").withColumn("place", place).where((F.col("place") <= F.col("n") - t_of("n") + 1) & (F.col("df") > 1)).select("token", "cid"), "core")
    hubs = core.groupBy("token").agg(F.min("cid").alias("hub"))
    stars = core.join(hubs, "token").select(F.col("cid").alias("a"), F.col("hub").alias("b")).where("a <> b").distinct()
    candidates = components(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(stars), "candidates")
    links = _checked_links(sets, candidates, percent)
    linked = components(links, "links").withColumnRenamed("node", "cid")
    named = classes.select("cid", "f1", "f2", "n", "rep", "copies").join(linked, "cid", "left")
    joined = named.where("component is not null")
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("classes"))
    columns = ["f1", "f2", "n", "copies", "component_id"]
    keyed = join_keys(joined, least, ["component"], "classes").select(*columns).unionByName(named.where("component is null").withColumn("component_id", F.col("rep")).select(*columns))
    out = ["doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id"]
    rows = sig.drop("prefix")
    found = join_keys(rows.where(can_link), written(keyed, "class-groups"), ["f1", "f2", "n"], "copies")
    return found.select(*out).unionByName(rows.where(f"not ({can_link})").withColumn("component_id", F.col("doc_id")).select(*out))


def _checked_links(sets: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """Exact links (a, b), a spanning forest of them for each pair of blocks of each candidate component."""
    named = candidates.select(F.col("node").alias("cid"), "component")
    # Sizes and blocks are settled on ids alone; the sets then move once, straight to their pairs of blocks.
    sizes = named.join(sets.select("cid", (F.length("shingles") / 8).alias("n")), "cid")
    blocks = sizes.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("members"))
    keyed = written(join_keys(named, blocks, ["component"], "members"), "blocks")
    placed = sets.join(keyed, "cid").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "shingles")
    placed = placed.repartition("component", "i", "j")

    def search(part: pd.DataFrame) -> pd.DataFrame:
        reps = part["cid"].to_numpy()
        group = None if part["i"].iloc[0] == part["j"].iloc[0] else part["block"].to_numpy()
        links = divide_skip([np.frombuffer(x, np.uint64) for x in part["shingles"]], percent, group)
        return pd.DataFrame({"a": reps[[i for i, _ in links]] if links else [], "b": reps[[j for _, j in links]] if links else []}, dtype="int64")

    return placed.groupBy("component", "i", "j").applyInPandas(search, "a long, b long")


def keep_one(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """The documents' own columns, one row of each group of near copies: that with the least doc_id.

    Rows are told apart by doc_id and text, so a doc_id that repeats takes no other row with
    it; of rows that have both in common one stays.  Documents without words and rows with a
    null doc_id stay.
    """
    groups = written(grouped_rows(docs, words, percent).where("n_shingles > 0 and doc_id is not null"), "groups")
    rows = groups.groupBy("doc_id", "text_key").agg(F.first("component_id").alias("component_id"), F.count("*").alias("copies"))
    # The least doc_id may stand for several rows of its group: the one with the least text_key stays.
    first = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.min("text_key").alias("first_key"))
    judged = rows.join(first.withColumnRenamed("doc_id", "component_id"), "component_id")
    stays = (F.col("doc_id") == F.col("component_id")) & (F.col("text_key") == F.col("first_key"))
    gone = judged.where(~stays).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    key = "_key_of_text"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    match = lambda other: (keyed["doc_id"] == other["_id"]) & (keyed[key] == other["_key"])
    left = keyed.join(gone, match(gone), "left_anti")
    twice = judged.where(stays & (F.col("copies") > 1)).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    if twice.isEmpty():
        return left.select(*docs.columns)
    once = left.join(twice, match(twice), "left_semi").dropDuplicates(["doc_id", key])
    return left.join(twice, match(twice), "left_anti").unionByName(once).select(*docs.columns)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))
