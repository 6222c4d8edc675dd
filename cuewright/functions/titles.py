"""Series, season and episode from titles, by ordered patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered patterns (first that fits wins): season group, episode group (0: none), pattern.
PATTERNS = [
    (1, 2, r"(?i)\bS(\d{1,2})[ ._-]?E(\d{1,3})\b"),
    (1, 2, r"(?i)\b(\d{1,2})x(\d{1,3})\b"),
    (1, 2, r"(?i)\bseason[ ._-]*(\d{1,2})\D{0,12}episode[ ._-]*(\d{1,3})\b"),
    (1, 2, r"(?iu)\b(\d{1,2})\.? ?sezon\D{0,12}(\d{1,3})\.? ?bölüm"),
    (0, 1, r"(?iu)\b(\d{1,3})\.? ?bölüm"),
    (0, 1, r"الحلقة\s*(\d{1,3})"),
    (0, 1, r"(?i)\bepisode[ ._-]*(\d{1,3})\b"),
    (0, 1, r"(?i)\bep\.?[ ._-]*(\d{1,3})\b"),
]


def parse_title(title: Column) -> Column:
    """Struct (series, season, episode, name): what stands before the first fitting pattern, and after it."""
    out = F.struct(F.trim(title).alias("series"), F.lit(None).cast("int").alias("season"), F.lit(None).cast("int").alias("episode"), F.lit(None).cast("string").alias("name"))
    for season, episode, pattern in reversed(PATTERNS):
        whole = F.regexp_extract(title, pattern, 0)
        at = F.instr(title, whole)
        clean = lambda c: F.regexp_replace(c, r"^[\s._|:-]+|[\s._|:-]+$", "")
        hit = F.struct(
            clean(F.substring(title, F.lit(1), at - 1)).alias("series"),
            (F.regexp_extract(title, pattern, season).cast("int") if season else F.lit(None).cast("int")).alias("season"),
            F.regexp_extract(title, pattern, episode).cast("int").alias("episode"),
            F.nullif(clean(F.substring(title, at + F.length(whole), F.length(title))), F.lit("")).alias("name"),
        )
        out = F.when(title.rlike(pattern), hit).otherwise(out)
    return out
