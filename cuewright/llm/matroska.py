"""Media columns in Matroska: writing samples, and parsing files into packet tables.

``parse`` reads variable-length EBML elements (unknown sizes included), clusters, simple
blocks and block groups, all lacings (Xiph, fixed, EBML) and cues, and gives one row per
packet: track, timestamp, key flag and byte range in the file.  ``mux`` writes 8-bit mono
samples as one audio track: FRAME bytes a packet, LACED packets a block, BLOCKS blocks a
cluster, and a cue per cluster.

Packets of a lace follow one another by the track's default duration, or else, for samples
of a whole number of bytes, by their size; a block in a group is a key frame unless it refers to another.  ``seek`` reads
packets from a time on by the cues, without parsing what stands before.

Null and empty texts give 64 zero samples; equal texts give equal files; a file that was
cut off gives the packets before the cut, with the last one's whole bytes only, and an error
text.  A null doc_id is kept; rows that repeat give a row each; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, written

#: Fixed values of the format: element ids.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
_TOP = {INFO, TRACKS, CLUSTER, CUES}

RATE = 8000
FRAME = 2048
LACED = 8
BLOCKS = 4


def _vint(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def _element(eid: int, data: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + _vint(len(data)) + data


def _uint(eid: int, n: int) -> bytes:
    return _element(eid, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


_HEADER = _element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2))
_TRACKS = _element(TRACKS, _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(DEFAULT_DURATION, FRAME * 10**9 // RATE) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _element(AUDIO, _element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))))


def _block(payload: bytes, at: int, n: int, relative: int) -> bytes:
    """A simple block of ``n`` packets of FRAME bytes (the last may be shorter) from ``at`` on."""
    sizes = [min(FRAME, len(payload) - at - i * FRAME) for i in range(n)]
    data = payload[at : at + sum(sizes)]
    if n == 1:
        lacing, head = 0x00, b""
    elif sizes[-1] == FRAME:
        lacing, head = 0x04, bytes([n - 1])
    else:  # EBML lacing: first size, then signed differences; the last size is what is left
        lacing, head = 0x06, bytes([n - 1]) + _vint(sizes[0]) + b"".join(_vint(b - a + 63, 1) for a, b in zip(sizes, sizes[1:-1]))
    return _element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", relative, 0x80 | lacing) + head + data)


def mux(payload: bytes) -> bytes:
    """A Matroska file of 8-bit samples at RATE; the payload's length is a multiple of 64."""
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + _element(MUXING_APP, b"cuewright") + _element(WRITING_APP, b"cuewright"))
    parts, cues, position = [info, _TRACKS], [], len(info) + len(_TRACKS)
    packets = -(-len(payload) // FRAME)
    for c in range(0, packets, LACED * BLOCKS):
        time = c * FRAME * 1000 // RATE
        blocks = [_block(payload, b * FRAME, min(LACED, packets - b), b * FRAME * 1000 // RATE - time) for b in range(c, min(c + LACED * BLOCKS, packets), LACED)]
        cluster = _element(CLUSTER, _uint(TIMESTAMP, time) + b"".join(blocks))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, time) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, position))))
        parts.append(cluster)
        position += len(cluster)
    parts.append(_element(CUES, b"".join(cues)))
    return _HEADER + _element(SEGMENT, b"".join(parts))


def read_id(data: bytes, at: int) -> tuple[int, int]:
    width = 9 - data[at].bit_length()
    if width > 4:
        raise ValueError(f"no element id at {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """(size, next place); None: unknown size (all ones)."""
    width = 9 - data[at].bit_length()
    if width > 8:
        raise ValueError(f"no size at {at}")
    n = int.from_bytes(data[at : at + width], "big") & ((1 << 7 * width) - 1)
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def _laced(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """(packet sizes, place of the first packet) of a laced block's data."""
    if lacing == 0:
        return [end - at], at
    n = data[at] + 1
    at += 1
    if lacing == 2:
        if (end - at) % n:
            raise ValueError("fixed lacing does not divide the block")
        return [(end - at) // n] * n, at
    sizes = []
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size += 255
                at += 1
            sizes.append(size + data[at])
            at += 1
    elif n > 1:
        size, at = read_size(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            width = 9 - data[at].bit_length()
            raw = int.from_bytes(data[at : at + width], "big") & ((1 << 7 * width) - 1)
            at += width
            size += raw - ((1 << (7 * width - 1)) - 1)
            sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced sizes exceed the block")
    return sizes, at


def _lace_step(track: dict, size: int) -> int:
    """Nanoseconds from a packet of a lace to the next one."""
    if track.get("duration"):
        return track["duration"]
    bits = track.get("bits", 0) * track.get("channels", 1)
    if bits and bits % 8 == 0 and track.get("rate"):
        return round(size * 8 * 10**9 / (bits * track["rate"]))
    return 0


def parse(data: bytes, at: int = 0, head: dict | None = None) -> dict:
    """Packets (track, timestamp in ns, key, byte offset, size, cluster, lace), cues, tracks and the error, if any.

    With ``head`` (an earlier result) parsing begins at the cluster at place ``at``.
    """
    out = {"packets": [], "cues": [], "tracks": {}, "clusters": 0, "scale": 1_000_000, "segment": None, "error": None}
    if head:
        out |= {"tracks": head["tracks"], "scale": head["scale"], "segment": head["segment"]}
    stack = [(len(data), None)]
    time, track, cue, group = 0, {}, {}, []
    try:
        while at < len(data):
            while len(stack) > 1 and at >= stack[-1][0]:
                stack.pop()
            eid, body = read_id(data, at)
            size, body = read_size(data, body)
            end = stack[-1][0] if size is None else body + size  # an element of unknown size ends with its parent, or where a top element begins
            if end > len(data):
                out["error"] = out["error"] or f"element at {at} goes beyond the file"
                if eid not in _MASTERS and eid not in (SIMPLE_BLOCK, BLOCK):
                    break
            if eid in _TOP:
                while stack[-1][1] in _TOP:
                    stack.pop()
            if eid in _MASTERS:
                stack.append((min(end, len(data)), eid))
                if eid == SEGMENT:
                    out["segment"] = body
                elif eid == CLUSTER:
                    out["clusters"] += 1
                elif eid == TRACK_ENTRY:
                    track = {}
                elif eid == CUE_POINT:
                    cue = {}
                elif eid == BLOCK_GROUP:
                    group = []
                at = body
                continue
            number_of = lambda: int.from_bytes(data[body:end], "big")  # noqa: B023, E731
            if eid == TIMESTAMP:
                time = number_of()
            elif eid in (SIMPLE_BLOCK, BLOCK):
                number, p = read_size(data, body)
                relative, flags = struct.unpack_from(">hB", data, p)
                sizes, p = _laced(data, p + 3, end, (flags >> 1) & 3)
                begins = (time + relative) * out["scale"]
                group = []
                for i, n in enumerate(sizes):
                    if p + n > len(data):
                        break
                    group.append(len(out["packets"]))
                    out["packets"].append((number, begins, eid == BLOCK or bool(flags & 0x80), p, n, out["clusters"] - 1, i))
                    begins += _lace_step(out["tracks"].get(number, {}), n)
                    p += n
            elif eid == REFERENCE_BLOCK:
                for i in group:
                    row = out["packets"][i]
                    out["packets"][i] = (*row[:2], False, *row[3:])
            elif eid == TIMESTAMP_SCALE:
                out["scale"] = number_of()
            elif eid == TRACK_NUMBER:
                track["number"] = number_of()
                out["tracks"][track["number"]] = track
            elif eid == DEFAULT_DURATION:
                track["duration"] = number_of()
            elif eid == CHANNELS:
                track["channels"] = number_of()
            elif eid == BIT_DEPTH:
                track["bits"] = number_of()
            elif eid == CODEC_ID:
                track["codec"] = data[body:end].decode("ascii", "replace")
            elif eid == SAMPLING_FREQUENCY:
                track["rate"] = struct.unpack(">d" if end - body == 8 else ">f", data[body:end])[0]
            elif eid == CUE_TIME:
                cue["time"] = number_of()
            elif eid == CUE_TRACK:
                cue["track"] = number_of()
            elif eid == CUE_CLUSTER_POSITION:
                out["cues"].append((cue.get("time"), cue.get("track"), number_of()))
            at = end
    except (ValueError, IndexError, struct.error) as e:
        out["error"] = out["error"] or str(e)
    return out


def seek(data: bytes, head: dict, time_ns: int, track: int = 1) -> list[tuple]:
    """The track's packets from the last cue that is no later than a time; ``head`` is a result of ``parse`` with cues and tracks.

    Cluster numbers count from the cue's cluster on.
    """
    places = [p for t, n, p in head["cues"] if n == track and (t or 0) * head["scale"] <= time_ns]
    if not places or head["segment"] is None:
        return [x for x in parse(data)["packets"] if x[0] == track]
    return [x for x in parse(data, head["segment"] + max(places), head)["packets"] if x[0] == track]


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's UTF-8 bytes, zero-padded to a positive multiple of 64, as a Matroska file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = [x or b"" for x in b["text"].cast(pa.binary()).to_pylist()]
            media = [mux(x + bytes(max(64, -(-len(x) // 64) * 64) - len(x))) for x in texts]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """One row per packet: doc_id, track, packet, timestamp_ns, key, offset, size, cluster, lace; offsets are bytes of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = parse(b["media"][i].as_py() or b"")["packets"]
                if rows:
                    track, time, key, offset, size, cluster, lace = zip(*rows)
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array([i] * n)), pa.array(track, pa.int32()), pa.array(range(n), pa.int32()), pa.array(time, pa.int64()), pa.array(key), pa.array(offset, pa.int64()), pa.array(size, pa.int64()), pa.array(cluster, pa.int32()), pa.array(lace, pa.int32())], names=["doc_id", "track", "packet", "timestamp_ns", "key", "offset", "size", "cluster", "lace"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, track int, packet int, timestamp_ns long, key boolean, offset long, size long, cluster int, lace int")


def features(payload: bytes, parsed: dict) -> str:
    """Packet counts and plain statistics of the samples, as text."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    above = x >= 128
    return f"packets={len(parsed['packets'])};clusters={parsed['clusters']};cues={len(parsed['cues'])};ms={len(x) * 1000 // RATE};sum={int(x.sum())};energy={int((x * x).sum())};peak={int(x.max(initial=0))};crossings={int((above[1:] != above[:-1]).sum())}"


def described(media: DataFrame) -> DataFrame:
    """Digests and features of stored files, all from the stored bytes' packets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media"):
            out = []
            for data in b["media"].to_pylist():
                parsed = parse(data)
                payload = b"".join([data[p[3] : p[3] + p[4]] for p in parsed["packets"]])
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(payload, parsed)))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_bytes"], pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4]), pa.array(cols[5])], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(written(to_media(documents(spark, sf_dir)), "media"))
