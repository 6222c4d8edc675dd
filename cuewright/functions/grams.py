"""Counts of character n-grams of pairs of texts, for a whole batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are counted in one pass.
PASS = 1 << 16


def gram_counts(references: list[str], hypotheses: list[str], order: int) -> np.ndarray:
    """A row a pair: for each n up to ``order`` the n-grams in common (each as often as both have it), of the hypothesis, of the reference.

    A text's n-grams are numbered by the number of their first n - 1 characters and their last one, so that
    equal numbers are equal grams; no text is cut into strings.
    """
    pairs = len(references)
    lengths = np.array([len(x) for x in (*references, *hypotheses)], np.int64)
    code = np.frombuffer("".join((*references, *hypotheses)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.zeros((pairs, 3 * order), np.int64)
    if not len(code):
        return out
    letters, last = np.unique(code, return_inverse=True)
    text = np.repeat(np.arange(2 * pairs), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(code))  # characters up to the text's end, this one included
    at, number, kinds = np.arange(len(code)), last, len(letters)
    for n in range(1, order + 1):
        if n > 1:
            whole = left[at] >= n
            at = at[whole]
            grams, number = np.unique(number[whole] * len(letters) + last[at + n - 1], return_inverse=True)
            kinds = len(grams)
        of, second = text[at] % pairs, text[at] >= pairs
        (a, n_a), (b, n_b) = (np.unique(of[side] * kinds + number[side], return_counts=True) for side in (~second, second))
        _, in_a, in_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        out[:, 3 * n - 3] = np.bincount(a[in_a] // max(kinds, 1), weights=np.minimum(n_a[in_a], n_b[in_b]), minlength=pairs)
        sizes = np.maximum(lengths - n + 1, 0)
        out[:, 3 * n - 2], out[:, 3 * n - 1] = sizes[pairs:], sizes[:pairs]
    return out


def _passes(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of about PASS characters, one row at least."""
    part = np.cumsum(sizes) // PASS
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    yield from (slice(a, b) for a, b in zip(edges, edges[1:]) if b > a)


def chrf_counts(reference: Column, hypothesis: Column, order: int = 6) -> Column:
    """``gram_counts`` of two text columns without their spaces, as an array; null texts are empty."""

    @F.pandas_udf("array<bigint>")
    def counts(ref: pd.Series, hyp: pd.Series) -> pd.Series:
        x, y = (["".join((t or "").split()) for t in s] for s in (ref, hyp))
        sizes = np.array([len(a) + len(b) for a, b in zip(x, y)], np.int64)
        rows = [row for cut in _passes(sizes) for row in gram_counts(x[cut], y[cut], order)]
        return pd.Series(rows, index=ref.index, dtype=object)

    return counts(reference, hypothesis)
