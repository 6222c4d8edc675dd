"""Substring dedup with suffix automata of reference shards.

A window is ``window`` consecutive words of one text.  A window is repeated when its word
sequence starts anywhere else, in the same text or another; each word that a repeated
window covers is removed.  Windows are judged on the input.

Plan, for a corpus that is its own reference:

1. Each window elects its least ``gram``-word hash (the leftmost on ties).  Neighbouring
   windows elect the same place, so a text falls into runs of windows; a run is one row
   (anchor hash, hash of the run's words, document, first window, number of windows).
   Equal windows elect equal anchors, so they can only meet under one anchor.  This step
   decides nothing but which shard a run can meet.
2. Anchors are counted (map-side combine); anchors seen once are dropped.  The distinct runs
   under the others, with their numbers of occurrences, are the reference: their words are
   fetched and dealt to shards by anchor.
3. A shard's words go into a generalised suffix automaton with occurrence counts.  A run's
   words are in it, so each prefix of them streams to the state that its insertion reached;
   where that state's last ``window`` words were seen twice, the window is a repeat.  An anchor with more than ``SHARD_RUNS`` distinct runs is dealt on,
   by window, to more shards, so that no automaton outgrows a task.
4. Spans are gathered per document and cut out of the whole text.

No automaton of the whole corpus can be broadcast within a bound, so shards travel by key.
``match_reference`` is the broadcast form, for a reference whose size is checked first.

Automata compare sequences of 64-bit word hashes; runs are one where anchor, length and a
64-bit hash of the words agree.

Null texts are empty; texts shorter than a window keep all words; rows that repeat (also
with one doc_id) count as separate occurrences; null doc_ids are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, kind_of, slices, written
from .words import Words, range_hashes, run_hashes, split_words

GRAM = 8
#: Distinct runs under one anchor beyond which they are dealt by windows.
SHARD_RUNS = 2000
#: Words of a shard, about; an anchor's own runs may exceed it by SHARD_RUNS runs.
SHARD_WORDS = 50_000
#: Windows of a run at most; a longer one is cut.
MASK_BITS = 62
#: Bound of a broadcast reference, in words.
REFERENCE_WORDS = 2_000_000


class SuffixAutomaton:
    """Generalised suffix automaton over word hashes, with a weight for each inserted sequence."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.link) - 1

    def _clone(self, p: int, q: int, symbol: int) -> int:
        c = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = c
            p = self.link[p]
        return c

    def add(self, symbols: list[int], weights: list[int] | None = None) -> list[int]:
        """Insert a sequence; ``weights`` are the occurrences of the prefixes that end with each symbol, 1 unless given.

        Returns the state of each prefix: where a text streams to that holds the sequence.
        """
        last, nxt, length, link, count = 0, self.next, self.length, self.link, self.count
        reached = []
        for a, weight in zip(symbols, weights or [1] * len(symbols)):
            q = nxt[last].get(a)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, q, a)
                count[last] += weight
            else:
                cur = len(link)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                count.append(weight)
                p = last
                while p >= 0 and a not in nxt[p]:
                    nxt[p][a] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][a]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, a)
                last = cur
            reached.append(last)
        return reached

    def finish(self) -> None:
        """Occurrences of every state: sums over the link tree, longest states first."""
        count, link = self.count, self.link
        for s in np.argsort(self.length)[:0:-1].tolist():
            if link[s] > 0:
                count[link[s]] += count[s]

    def of_windows(self, window: int) -> np.ndarray:
        """For each state, the occurrences of the last ``window`` symbols of its sequences; 0 for shorter states."""
        link, length = np.array(self.link), np.array(self.length)
        at = np.where(length >= window, np.arange(len(link)), 0)
        while True:  # up the links as long as the state above is long enough
            above = np.where(length[link[at]] >= window, link[at], at)
            if (above == at).all():
                return np.where(length >= window, np.array(self.count)[at], 0)
            at = above

    def matches(self, symbols: list[int], window: int) -> Iterator[tuple[int, int]]:
        """Matching statistics: (match length up to each word, occurrences of the last ``window`` words or 0)."""
        state, match = 0, 0
        for a in symbols:
            while state and a not in self.next[state]:
                state = self.link[state]
                match = self.length[state]
            if a in self.next[state]:
                state = self.next[state][a]
                match += 1
            if match >= window:
                s = state
                while self.length[self.link[s]] >= window:
                    s = self.link[s]
                yield match, self.count[s]
            else:
                yield match, 0


def window_runs(w: Words, window: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text number, first window, number of windows, anchor hash, hash of the run's words) of a batch's runs."""
    total, counts = len(w.hashes), w.counts()
    none = np.empty(0, np.int64)
    if total < window or not (counts >= window).any():
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams = run_hashes(w.hashes, gram)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(total)
    valid = at + window <= w.first[1:][text]
    # Leftmost least gram of the window's ``window - gram + 1`` grams, by doubling.
    span, width = window - gram + 1, 1
    best = np.arange(len(grams))
    while width * 2 <= span:
        a, b = best[: len(best) - width], best[width:]
        best = np.where(grams[b] < grams[a], b, a)
        width *= 2
    if width < span:
        a, b = best[: len(best) - (span - width)], best[span - width :]
        best = np.where(grams[b] < grams[a], b, a)
    windows = np.flatnonzero(valid)
    owner = best[windows]
    new = np.append(True, (owner[1:] != owner[:-1]) | (np.diff(windows) != 1))
    begin = np.flatnonzero(new)
    new |= (np.arange(len(windows)) - begin[np.cumsum(new) - 1]) % MASK_BITS == 0  # a run's windows are the bits of one mask
    lo = windows[new]
    n = np.diff(np.append(np.flatnonzero(new), len(windows)))
    return text[lo], lo - w.first[text[lo]], n, grams[owner[new]], range_hashes(w.hashes, lo, lo + n + window - 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, whole text and a hash of the text; both keys tell rows apart when a doc_id repeats."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("text_key", F.xxhash64("text"))


def runs_of(docs: DataFrame, window: int) -> DataFrame:
    """One row for each run of windows of every document."""

    def run(batches):
        for b in slices(batches, "text", 2 << 20):
            text, lo, n, anchor, seg = window_runs(split_words(b["text"]), window)
            if len(text):
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(text)), b["text_key"].take(pa.array(text)), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int16)), _signed(anchor), _signed(seg)], names=["doc_id", "text_key", "lo", "n", "anchor", "seg"])

    return _keyed(docs).mapInArrow(run, f"doc_id {kind_of(docs)}, text_key long, lo int, n short, anchor long, seg long")


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_key, spans): runs of every document with a mask of the windows that are repeated."""
    runs = written(runs_of(docs, window), "all-runs")
    # Written, so that the join below stands on its own exchanges and Spark can split a hot anchor in it.
    shared = written(runs.groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    live = written(runs.join(shared, "anchor"), "runs")
    segs = written(live.groupBy("anchor", "seg", "n").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "text_key", "lo")).alias("at")), "segs")
    per_anchor = segs.groupBy("anchor").agg(F.count("*").alias("segs"))
    # Fetch the words of the distinct runs, each from one document that holds it.
    wants = F.sort_array(F.collect_list(F.struct(F.col("at.lo").alias("lo"), "n", "anchor", "seg", "c", "segs")))
    wanted = segs.join(per_anchor, "anchor").groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.text_key").alias("text_key")).agg(wants.alias("wants"))
    keyed = _keyed(docs)
    found = keyed.join(wanted, keyed.doc_id.eqNullSafe(wanted.doc_id) & (keyed.text_key == wanted.text_key)).select(keyed.doc_id, keyed.text_key, "text", "wants").dropDuplicates(["doc_id", "text_key"])
    most = SHARD_RUNS

    def words_of(batches):
        """Stretches of words: (key, words, runs in it).  Runs that share an anchor with others go by the anchor, or by
        windows where these are many; runs that are alone under theirs stay with their neighbours in the text."""
        for b in batches:
            for part in slices(iter([b]), "text", 2 << 20):
                w = split_words(part["text"])
                wants = part["wants"]
                rows = wants.flatten()
                owner = np.repeat(np.arange(part.num_rows), pc.list_value_length(wants).to_numpy())
                anchor, seg, c, n, segs, lo = (rows.field(f).to_numpy().astype(np.int64) for f in ("anchor", "seg", "c", "n", "segs", "lo"))
                pieces = np.where(segs > most, n, 1)
                of = np.repeat(np.arange(len(n)), pieces)
                shift = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                size = np.where(segs[of] > most, 1, n[of])
                begin = lo[of] + shift
                base = w.first[owner[of]] + begin
                key = anchor[of].copy()
                split = np.flatnonzero(segs[of] > most)
                key[split] ^= range_hashes(w.hashes, base[split], base[split] + window).view(np.int64)
                alone = segs[of] == 1
                joins = np.append(False, alone[1:] & alone[:-1] & (owner[of][1:] == owner[of][:-1]) & (begin[1:] == (begin + size)[:-1]))
                head = np.flatnonzero(~joins)
                last = np.append(head[1:], len(of)) - 1
                length = base[last] + size[last] - base[head] + window - 1
                ends = np.cumsum(length)
                flat = w.hashes[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(base[head] - (ends - length), length)]
                words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(head), [None, pa.py_buffer((np.append(0, ends) * 8).astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary())
                borders = pa.array(np.append(head, len(of)).astype(np.int32))
                listed = lambda x: pa.ListArray.from_arrays(borders, pa.array(x))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(key[head]), words, listed(anchor[of]), listed(seg[of]), listed(c[of]), listed(shift), listed(size)], names=["key", "words", "anchor", "seg", "c", "shift", "n"])

    fetched = written(found.select("text", "wants").mapInArrow(words_of, "key long, words binary, anchor array<long>, seg array<long>, c array<long>, shift array<long>, n array<long>"), "words")
    words = fetched.agg(F.sum(F.length("words"))).first()[0] or 0
    shards = max(1, words // (8 * SHARD_WORDS))

    def automaton(part: pd.DataFrame) -> pd.DataFrame:
        sam = SuffixAutomaton()
        states = [sam.add(np.frombuffer(x, np.uint64).tolist(), [0] * (window - 1) + np.repeat(c, n).tolist()) for x, c, n in zip(part["words"], part["c"], part["n"])]
        sam.finish()
        repeated = sam.of_windows(window) > 1
        out = []
        for reached, anchor, seg, shift, n in zip(states, part["anchor"], part["seg"], part["shift"], part["n"]):
            hit = repeated[reached[window - 1 :]]
            at = 0
            for a, g, o, k in zip(anchor.tolist(), seg.tolist(), shift.tolist(), n.tolist()):
                mask = int.from_bytes(np.packbits(hit[at : at + k], bitorder="little").tobytes(), "little") << o
                at += k
                if mask:
                    out.append((a, g, mask))
        return pd.DataFrame(out, columns=["anchor", "seg", "mask"], dtype="int64")

    dealt = fetched.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "words", "anchor", "seg", "c", "shift", "n")
    marked = dealt.groupBy("shard").applyInPandas(automaton, "anchor long, seg long, mask long")
    # Written, so that a run that is very common can be split in the join.
    masks = written(marked.groupBy("anchor", "seg").agg(F.bit_or("mask").alias("mask")), "masks")
    return live.join(masks, ["anchor", "seg"]).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("lo", "mask")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): every text without the words of repeated windows.

    Rows that repeat repeat each other's windows; null texts have no words; null doc_ids are kept; other columns are not
    read; an empty table gives no rows.
    """
    keyed = _keyed(docs)
    spans = repeated_windows(docs, window)
    spans = spans.select(F.col("doc_id").alias("sd"), F.col("text_key").alias("sk"), "spans")
    both = keyed.join(spans, keyed.doc_id.eqNullSafe(spans.sd) & (keyed.text_key == spans.sk), "left").select("doc_id", "text", "spans")

    def cut(batches):
        for b in slices(batches, "text", 2 << 20):
            w = split_words(b["text"])
            total = len(w.hashes)
            cover = np.zeros(total + 1, np.int32)
            spans = b["spans"]
            filled = np.flatnonzero(np.asarray(spans.is_valid()))
            if len(filled):
                flat = spans.flatten()
                owner = np.repeat(np.arange(b.num_rows), np.nan_to_num(np.asarray(pc.list_value_length(spans).to_numpy(zero_copy_only=False), float)).astype(np.int64))
                lo, mask = flat.field("lo").to_numpy(), flat.field("mask").to_numpy()
                for bit in range(64):
                    hit = np.flatnonzero((mask >> bit) & 1)
                    if len(hit):
                        s = w.first[owner[hit]] + lo[hit] + bit
                        np.add.at(cover, s, 1)
                        np.add.at(cover, s + window, -1)
            gone = np.cumsum(cover[:-1]) > 0
            yield kept_rows(b["doc_id"], w, gone)

    return both.mapInArrow(cut, f"doc_id {kind_of(docs)}, n_words long, n_removed long, kept_sha256 string, kept_text string")


def kept_rows(doc_ids: pa.Array, w: Words, gone: np.ndarray) -> pa.RecordBatch:
    """Rows of a batch: the kept words of each text joined by one space, and their digest."""
    kept = np.flatnonzero(~gone)
    text = np.searchsorted(w.first, kept, side="right") - 1
    more = np.append(text[1:] == text[:-1], False)  # a kept word of the same text follows: keep one separator
    edge = np.zeros(len(w.buf) + 2, np.int8)
    edge[w.start[kept]] += 1
    np.add.at(edge, w.end[kept] + more, -1)
    inside = np.cumsum(edge[: len(w.buf)], dtype=np.int8) > 0
    plain = w.buf.copy()
    plain[(plain >= 9) & (plain <= 13)] = 0x20
    data = plain[inside].tobytes()
    borders = np.concatenate([[0], np.cumsum(inside)])[w.text_at] if len(w.buf) else np.zeros(len(w) + 1, np.int64)
    digests = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]
    counts = w.counts()
    removed = np.concatenate([[0], np.cumsum(gone)])
    removed = removed[w.first[1:]] - removed[w.first[:-1]]
    texts = pa.StringArray.from_buffers(len(w), pa.py_buffer(borders.astype(np.int32).tobytes()), pa.py_buffer(data))
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(counts), pa.array(removed), pa.array(digests, pa.string()), texts], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def match_reference(docs: DataFrame, reference: DataFrame, window: int = 35, shards: int = 8) -> DataFrame:
    """(doc_id, spans): maximal word spans of length >= window that also occur in ``reference`` (a column ``text``).

    The reference is cut into shards, an automaton each, and broadcast; its number of words is
    checked against REFERENCE_WORDS first and a larger one is refused (use ``remove_repeats``
    on the union instead).
    """
    spark = docs.sparkSession
    size = reference.select(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")))).first()[0] or 0
    if size > REFERENCE_WORDS:
        raise ValueError(f"the reference has {size} words; a broadcast holds {REFERENCE_WORDS} at most")
    texts = [r[0] for r in reference.select("text").where("text is not null").collect()]
    automata = []
    for k in range(shards):
        sam = SuffixAutomaton()
        for t in texts[k::shards]:
            sam.add(split_words(pa.array([t])).hashes.tolist())
        sam.finish()
        automata.append(sam)
    held = spark.sparkContext.broadcast(automata)

    def run(batches):
        for b in slices(batches, "text", 2 << 20):
            w = split_words(b["text"])
            out = []
            for i in range(b.num_rows):
                symbols = w.hashes[w.first[i] : w.first[i + 1]].tolist()
                best = np.zeros(len(symbols), np.int64)
                for sam in held.value:
                    best = np.maximum(best, np.fromiter((m for m, _ in sam.matches(symbols, window)), np.int64, len(symbols)))
                ends = np.flatnonzero((best >= window) & (np.append(best[1:], 0) <= best))
                out.append([{"start": int(e - best[e] + 1), "end": int(e + 1)} for e in ends])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "spans"])

    return _keyed(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind_of(docs)}, spans array<struct<start:int,end:int>>")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept_text")
