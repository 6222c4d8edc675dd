"""Vectorised helpers for what Spark has no built-in for: normal forms and sequence similarity."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .matching import ratio


class _Plain(dict):
    """Code point -> its comparison form, worked out once for each."""

    def __missing__(self, code: int) -> str:
        folded = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if unicodedata.category(c) != "Mn").casefold()
        self[code] = "".join(c if c.isalnum() else " " for c in folded)
        return self[code]


_PLAIN = _Plain()


def comparison_form(text: str) -> str:
    """No diacritics, case-folded, letters and digits only, single spaces."""
    return " ".join(text.translate(_PLAIN).split())


def similarity(a: str, b: str) -> float:
    """Mean of the character and the word ratio of the comparison forms."""
    x, y = comparison_form(a), comparison_form(b)
    if not x or not y:
        return float(x == y)
    if x == y:
        return 1.0
    return (ratio(x, y) + ratio(x.split(), y.split())) / 2


@F.pandas_udf(StringType())
def norm_cmp(text: pd.Series) -> pd.Series:
    return text.map(comparison_form, na_action="ignore")


@F.pandas_udf(DoubleType())
def text_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else similarity(x, y) for x, y in zip(a, b)], dtype=float)
