"""Vectorised word and shingle hashing over Arrow string columns (shared by the llm operators).

A word is ``[^\\x20\\x09-\\x0D]+``.  All work is done on the UTF-8 buffer of a whole
Arrow batch: one pass finds word boundaries, and each word's hash takes in eight of its
bytes at a time, for all words at once; every step is a one-to-one mix, so words of up to
eight bytes and one length never collide.  Sums of byte codes times powers would be no
better in speed and give equal hashes to certain long words whatever the multiplier.  Runs
of words are hashed by doubling: a run of 2n words mixes the hashes of its halves.  No
per-word Python objects are made, but for words over LONG_WORD bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes beyond which a word's hash is taken by blake2b.
LONG_WORD = 512


def _splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A-Z to lower case and ASCII punctuation to spaces.
_PLAIN = _LOWER.copy()
_PLAIN[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = 0x20

#: The low bytes of a little-endian word of eight.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def byte_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges."""
    size = end - start
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))  # the eight bytes from each place on
    out = _splitmix(size.astype(np.uint64))
    long = np.flatnonzero(size > LONG_WORD)
    out = _splitmix(out ^ (eight[start] & _LOW[np.minimum(size, 8)]))
    at, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(at):
        left = size[at] - done
        out[at] = _splitmix(out[at] ^ (eight[start[at] + done] & _LOW[np.minimum(left, 8)]))
        done += 8
        at = at[left > 8]
    for i in long.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Public finaliser for 64-bit hashes."""
    return _splitmix(x)


class Words:
    """Words of a batch of texts.

    buf          uint8 buffer of all texts of the batch
    start, end   byte range of each word in ``buf``
    hashes       64-bit hash of each word
    first        word index at which each text begins (length: texts + 1)
    """

    __slots__ = ("buf", "end", "first", "hashes", "start", "text_at")

    def __init__(self, buf, start, end, hashes, first, text_at):
        self.buf, self.start, self.end, self.hashes, self.first, self.text_at = buf, start, end, hashes, first, text_at

    def __len__(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        """Number of words of each text."""
        return np.diff(self.first)

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, word index) of every run of n consecutive words inside one text."""
        total = len(self.hashes)
        if total < n:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        left = np.repeat(self.first[1:], self.counts()) - np.arange(total)  # words left in the text, this one included
        at = np.flatnonzero(left >= n)
        return run_hashes(self.hashes, n)[at], at


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return _splitmix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def doubled(hashes: np.ndarray, n: int) -> list[np.ndarray]:
    """Hashes of all runs of 1, 2, 4, ... values, up to the greatest power of two that is ``n`` at most."""
    out, width = [hashes], 1
    while width * 2 <= n:
        last = out[-1]
        out.append(_both(last[: max(0, len(last) - width)], last[width:]))
        width *= 2
    return out


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive values: of the two runs of a power of two that cover it."""
    total = len(hashes)
    if total < n:
        return np.empty(0, np.uint64)
    last = doubled(hashes, n)[-1]
    width = 1 << (n.bit_length() - 1)
    if n == width:
        return last
    return _both(last[: total - n + 1], last[n - width :] ^ np.uint64(n))


def range_hashes(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of each range of one value or more; equal to ``run_hashes`` of its length."""
    n = (hi - lo).astype(np.int64)
    out = np.empty(len(lo), np.uint64)
    if not len(n):
        return out
    levels = doubled(hashes, int(n.max()))
    level = np.frexp(n.astype(float))[1] - 1
    for k in np.unique(level).tolist():
        at = np.flatnonzero(level == k)
        first = levels[k][lo[at]]
        out[at] = np.where(n[at] == 1 << k, first, _both(first, levels[k][hi[at] - (1 << k)] ^ n[at].astype(np.uint64)))
    return out


def split_words(texts: pa.Array, lower: bool = False, plain: bool = False) -> Words:
    """Words of every text of an Arrow string column; null texts have none.

    ``lower`` folds A-Z; ``plain`` folds all letters and takes ASCII punctuation for spaces.
    """
    if plain:
        texts = pc.utf8_lower(texts)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if n == 0 or texts.buffers()[2] is None:
        none = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint8), none, none, np.empty(0, np.uint64), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64))
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if lower or plain:
        buf = (_PLAIN if plain else _LOWER)[buf]
    inside = ~_IS_SPACE[buf]
    # A word starts where a word byte follows a space or a text border; it ends likewise.
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(buf))]
    begins[borders] = inside[borders]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[borders - 1] = inside[borders - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets, side="left")
    return Words(buf, start, end, byte_hashes(buf, start, end), first, offsets)


def hash_of(words: list[str]) -> np.ndarray:
    """Hashes of single words, as ``split_words`` gives them."""
    return split_words(pa.array([" ".join(words)], pa.string())).hashes


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which beats numpy's hashed unique on such arrays."""
    out = np.sort(values)
    return out[np.append(True, out[1:] != out[:-1])] if len(out) else out
