"""Token ids as Simple-8b words: 64-bit words, a 4-bit selector each, with escapes and per-block offsets.

A block is self-describing (little-endian):

    magic b"S8B1" | n_docs u32 | n_ids u32 | n_words u32 | n_escapes u32
    | document ends u32[n_docs] (exclusive, in ids of the block)
    | first id of every SKIP-th word u32[ceil(n_words / SKIP)]   -- offsets for decoding from the middle
    | words u64[n_words]
    | escape positions u32[n_escapes] | escaped values u64[n_escapes]

A word's low 4 bits are its selector; the selector gives the count and the bit width of
the ids in the other 60 bits.  Ids of 2**30 and more are escapes: the stream holds 0 at
their place and the escape list holds position and value.  Blocks are rows of a Parquet
table, so a range of documents is read by reading its blocks only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, kind_of, shared_dir, slices
from .words import byte_hashes

#: Fixed values of the format: ids per word and bits per id, by selector.
COUNTS = [60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
BITS = [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
MAGIC = b"S8B1"
#: Words between stored offsets.
SKIP = 256
_LIMIT = 1 << 30


def encode_block(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """One block from the ids of several documents and each document's end."""
    ids = np.asarray(ids, np.uint64)
    escaped = np.flatnonzero(ids >= _LIMIT)
    values = ids[escaped]
    if len(escaped):
        ids = ids.copy()
        ids[escaped] = 0
    n = len(ids)
    # fits[s, i]: COUNTS[s] ids from i on all fit into BITS[s] bits; the last word may be partly empty.
    need = np.zeros(n, np.uint8)
    for b in BITS[:-1]:
        need[ids >= (1 << b)] += 1
    best = np.full(n, len(COUNTS) - 1, np.uint8)
    over = np.empty(n + 61, np.int32)
    over[0] = 0
    for s in range(len(COUNTS) - 2, -1, -1):
        c = COUNTS[s]
        np.cumsum(need > s, dtype=np.int32, out=over[1 : n + 1])
        over[n + 1 :] = over[n]
        best[over[c : n + c] == over[:n]] = s
    step = np.asarray(COUNTS)[best].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.asarray(starts, np.int64)
    sel = best[at]
    words = sel.astype(np.uint64)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    for s in range(len(COUNTS)):
        rows = np.flatnonzero(sel == s)
        if len(rows):
            c, b = COUNTS[s], BITS[s]
            block = padded[at[rows][:, None] + np.arange(c)]
            shifts = (4 + b * np.arange(c)).astype(np.uint64)
            words[rows] |= np.bitwise_or.reduce(block << shifts, axis=1)
    head = np.asarray([len(ends), n, len(words), len(escaped)], "<u4").tobytes()
    return b"".join([MAGIC, head, np.asarray(ends, "<u4").tobytes(), at[::SKIP].astype("<u4").tobytes(), words.astype("<u8").tobytes(), escaped.astype("<u4").tobytes(), values.astype("<u8").tobytes()])


def decode_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids uint64, document ends) of a block; every selector is decoded in one vector step."""
    if data[:4] != MAGIC:
        raise ValueError("not a Simple-8b block")
    n_docs, n, n_words, n_esc = np.frombuffer(data, "<u4", 4, 4).tolist()
    o = 20
    ends = np.frombuffer(data, "<u4", n_docs, o).astype(np.int64)
    o += 4 * n_docs
    o += 4 * -(-n_words // SKIP)
    words = np.frombuffer(data, "<u8", n_words, o)
    o += 8 * n_words
    out = np.zeros(n + 60, np.uint64)
    sel = (words & np.uint64(15)).astype(np.int64)
    per_word = np.asarray(COUNTS)[sel]
    at = np.cumsum(per_word) - per_word
    for s in range(len(COUNTS)):
        rows = np.flatnonzero(sel == s)
        if len(rows):
            c, b = COUNTS[s], BITS[s]
            shifts = (4 + b * np.arange(c)).astype(np.uint64)
            values = (words[rows][:, None] >> shifts) & np.uint64((1 << b) - 1)
            where = at[rows][:, None] + np.arange(c)
            inside = where < n
            out[where[inside]] = values[inside]
    out = out[:n]
    if n_esc:
        pos = np.frombuffer(data, "<u4", n_esc, o)
        out[pos] = np.frombuffer(data, "<u8", n_esc, o + 4 * n_esc)
    return out, ends


class PieceEncoder:
    """Byte-level BPE through the tokenizers library, called once per distinct piece of text.

    A text is cut where the tokenizer's own splitting rule always ends a piece (see
    ``_cut_places``), so that the parts can be encoded apart.
    Parts are found and hashed on the byte buffer; only parts not seen before are encoded.
    A text that holds an added token's literal is encoded whole, as the library does it:
    a cut may fall inside the literal.
    """

    MAX_CACHE = 1_500_000
    SLOTS = 1 << 22
    PROBES = 4

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # parts hold no added token; joined ones shall not make one
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.width = np.ones(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():  # one character of the vocabulary stands for one byte
            self.width[i] = len(token)
        self.reset()

    def reset(self) -> None:
        self.slot_key = np.zeros(self.SLOTS, np.uint64)  # open addressing: hash of a part, 0 where free
        self.slot_part = np.zeros(self.SLOTS, np.int32)
        self.ids = np.zeros(1 << 16, np.uint16 if len(self.width) <= 1 << 16 else np.uint32)
        self.begin = np.zeros(1 << 16, np.int32)  # part number -> its ids' place; the end is the next one's begin
        self.n_parts = self.n_ids = 0

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(part number of each key, places of the keys that are not known)."""
        mask = self.SLOTS - 1
        slot = (keys & np.uint64(mask)).astype(np.int32)
        part = self.slot_part[slot]
        missed = np.flatnonzero(self.slot_key[slot] != keys)
        for k in range(1, self.PROBES):
            if not len(missed):
                break
            at = (slot[missed] + k) & mask
            hit = self.slot_key[at] == keys[missed]
            part[missed[hit]] = self.slot_part[at[hit]]
            missed = missed[~hit]
        return part, missed

    def _keep(self, keys: np.ndarray, parts: np.ndarray) -> None:
        """Put distinct new keys into free slots; a key that finds none in PROBES is learned again when it comes back."""
        mask = self.SLOTS - 1
        left = np.arange(len(keys))
        for k in range(self.PROBES):
            at = ((keys[left] & np.uint64(mask)).astype(np.int64) + k) & mask
            free = np.flatnonzero(self.slot_key[at] == 0)
            slots, first = np.unique(at[free], return_index=True)
            placed = left[free[first]]
            self.slot_key[slots], self.slot_part[slots] = keys[placed], parts[placed]
            stays = np.ones(len(left), bool)
            stays[free[first]] = False
            left = left[stays]
            if not len(left):
                break

    def _learn(self, parts: list[bytes], between_cuts: np.ndarray) -> None:
        """Encode new parts; those that begin with a lone space and end at a cut are joined, and their ids are told apart by byte widths."""
        joined = np.flatnonzero(between_cuts)
        alone = np.flatnonzero(~between_cuts)
        groups = [joined[i : i + 512] for i in range(0, len(joined), 512)] + [alone[i : i + 1] for i in range(len(alone))]
        texts = [b"".join([parts[i] for i in g.tolist()]).decode("utf-8") for g in groups]
        flat = [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        order = np.concatenate(groups)
        flat = np.concatenate(flat) if flat else np.empty(0, np.int64)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))[order]
        stops = np.searchsorted(np.cumsum(self.width[flat]), np.cumsum(lengths)) + 1
        stops[lengths == 0] -= 1
        begins = np.concatenate([[0], stops[:-1]])
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n_parts + len(parts) + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        # Back into the order of ``parts``.
        size = np.empty(len(parts), np.int64)
        size[order] = stops - begins
        source = np.empty(len(parts), np.int64)
        source[order] = begins
        total = np.cumsum(size)
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat[np.arange(len(flat)) + np.repeat(source - (total - size), size)]
        self.begin[self.n_parts + 1 : self.n_parts + len(parts) + 1] = self.n_ids + total
        self.n_parts += len(parts)
        self.n_ids += len(flat)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text); null texts have none."""
        texts = texts.fill_null("").cast(pa.large_string())
        holds = np.zeros(len(texts), bool)
        for literal in self.added:
            holds |= pc.match_substring(texts, literal).to_numpy(zero_copy_only=False)
        if not holds.any():
            return self._encode_parts(texts)
        ids, counts = self._encode_parts(pc.if_else(pa.array(holds), "", texts).cast(pa.large_string()))
        ends = np.cumsum(counts)
        at = np.flatnonzero(holds)
        out, begin = [], 0
        for i in at.tolist():
            own = self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids
            out += [ids[begin : ends[i]], np.array(own, np.int64)]
            counts[i], begin = len(own), ends[i]
        return np.concatenate([*out, ids[begin:]]), counts

    def _encode_parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` of texts without added tokens."""
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        if not len(raw):
            return np.empty(0, np.int64), np.zeros(n, np.int64)
        if self.n_parts > self.MAX_CACHE:
            self.reset()
        is_cut = _cut_places(raw)
        border = is_cut.copy()
        border[offsets[:-1]] = True  # texts begin
        cuts = np.flatnonzero(border[:-1])
        stops = np.append(cuts[1:], len(raw))
        keys = byte_hashes(raw, cuts, stops)
        part, missed = self._find(keys)
        if len(missed):
            by_key = missed[np.argsort(keys[missed], kind="stable")]
            new = np.append(True, keys[by_key[1:]] != keys[by_key[:-1]])
            at = by_key[new]
            places = self.n_parts + np.arange(len(at), dtype=np.int32)
            part[by_key] = places[np.cumsum(new) - 1]
            self._keep(keys[at], places)
            buf = raw.tobytes()
            self._learn([buf[i:j] for i, j in zip(cuts[at].tolist(), stops[at].tolist())], is_cut[cuts[at]] & is_cut[stops[at]] & (raw[cuts[at]] == 0x20))
        begin = self.begin[part]
        size = self.begin[part + 1] - begin
        total = np.cumsum(size, dtype=np.int32)
        out = self.ids[np.arange(total[-1], dtype=np.int32) + np.repeat(begin - (total - size), size)]
        reached = np.concatenate([[0], total])[np.searchsorted(cuts, offsets)]
        return out, np.diff(reached)


_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:] = True
_VISIBLE[0x7F] = False
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?|")] = True
#: First bytes of characters some of which are Unicode white space.
_ODD_LEAD = np.zeros(256, bool)
_ODD_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _cut_places(raw: np.ndarray) -> np.ndarray:
    """For each place of the buffer, whether the splitting rule surely ends a piece there, whatever stands further off:

    before a lone space between visible characters (none is made near bytes that may belong
    to Unicode white space), before a mark after an ASCII letter or digit, and after a lone
    newline between a visible ASCII character and an ASCII letter.
    """
    cut = np.zeros(len(raw) + 1, bool)
    i = np.flatnonzero(raw[1:-1] == 0x20) + 1
    cut[i[_VISIBLE[raw[i - 1]] & _VISIBLE[raw[i + 1]] & ~_ODD_LEAD[raw[i + 1]] & ~_ODD_LEAD[raw[np.maximum(i - 2, 0)]] & ~_ODD_LEAD[raw[np.maximum(i - 3, 0)]]]] = True
    i = np.flatnonzero(_MARK[raw[1:]]) + 1
    cut[i[_WORD_BYTE[raw[i - 1]]]] = True
    i = np.flatnonzero(raw[1:-1] == 0x0A) + 1
    before = raw[i - 1]
    cut[i[_VISIBLE[before] & (before < 0x80) & _WORD_BYTE[raw[i + 1]]] + 1] = True
    return cut


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, partitions: int | None = None, end_id: int = 0, block_bytes: int = 1 << 20) -> None:
    """Encode ``text`` and write Simple-8b blocks in ascending (doc_id, text) order.

    Rows are dealt by ranges of doc_id, so every partition is one shard of the file; blocks
    close after about ``block_bytes`` of text.  Null and empty texts give the end id alone;
    null doc_ids come first; rows that repeat stay; other columns of the documents are not
    read; an empty table gives no blocks.  Columns: shard, block, first_doc_id,
    n_docs, n_ids, doc_ids (int64 little-endian; nulls are listed in null_ids), payload.
    """
    spark = docs.sparkSession
    if kind_of(docs) not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"the file stores doc_ids as 64-bit integers; doc_id is {kind_of(docs)}: number the rows first")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer_path)
        for b in slices(batches, "text", block_bytes):
            ids, counts = enc.encode(b["text"])
            ends = np.cumsum(counts + 1)
            full = np.full(int(ends[-1]), end_id, np.uint64)
            keep = np.ones(len(full), bool)
            keep[ends - 1] = False
            full[keep] = ids
            doc_ids = b["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
            nulls = np.flatnonzero(np.asarray(b["doc_id"].is_null()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([b["doc_id"][0].as_py()], pa.int64()), pa.array([b.num_rows], pa.int32()), pa.array([len(full)], pa.int64()), pa.array([doc_ids.astype("<i8").tobytes()]), pa.array([nulls.astype("<u4").tobytes()]), pa.array([encode_block(full, ends)])],
                names=["shard", "block", "first_doc_id", "n_docs", "n_ids", "doc_ids", "null_ids", "payload"],
            )
            block += 1

    # The ids are packed already; a general codec would spend CPU for little.
    ordered.mapInArrow(run, SCHEMA).write.option("compression", "snappy").parquet(path)


SCHEMA = "shard int, block int, first_doc_id long, n_docs int, n_ids long, doc_ids binary, null_ids binary, payload binary"


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) per document of a written file; ``ids`` can be left out.

    ``start`` is the number of ids before the document: blocks carry their counts, so only
    (shard, block, n_ids) of all blocks is summed, first within shards and then over shards.
    """
    from pyspark.sql import Window

    blocks = spark.read.schema(SCHEMA).parquet(path)
    meta = blocks.select("shard", "block", "n_ids")
    within = meta.withColumn("in_shard", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    shards = meta.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # One row a shard: as many rows as the file has partitions.
    before = shards.select("shard", F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    starts = within.join(before, "shard").select("shard", "block", (F.coalesce("in_shard", F.lit(0)) + F.coalesce("before", F.lit(0))).alias("block_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, ends = decode_block(batch["payload"][i].as_py())
                doc_ids = np.frombuffer(batch["doc_ids"][i].as_py(), "<i8")
                mask = np.zeros(len(doc_ids), bool)
                mask[np.frombuffer(batch["null_ids"][i].as_py(), "<u4")] = True
                begins = np.concatenate([[0], ends[:-1]])
                flat = ids.astype("<u4")
                view = memoryview(flat.tobytes())
                crc = np.fromiter((zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())), np.int64, len(ends))
                columns = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.astype(np.int32)))] if with_ids else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=mask), pa.array(np.full(len(ends), batch["shard"][i].as_py(), np.int32)), pa.array(np.full(len(ends), batch["block"][i].as_py(), np.int32)), pa.array(begins), pa.array(ends - begins), pa.array(crc), *columns],
                    names=["doc_id", "shard", "block", "in_block", "n_tokens", "ids_crc32", *["ids"] * with_ids],
                )

    rows = blocks.select("shard", "block", "doc_ids", "null_ids", "payload").mapInArrow(run, "doc_id long, shard int, block int, in_block long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return rows.join(starts, ["shard", "block"]).select("doc_id", (F.col("block_start") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_table(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write the documents' ids as a Simple-8b file in the shared folder and return what reading it back gives."""
    import uuid

    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_path)
    return read_tokens(docs.sparkSession, path, with_ids=False)


def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(documents(spark, sf_dir))
