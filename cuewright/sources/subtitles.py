"""Subtitle files as tables: parsing, decoding, archives and rendering.

Files are rows (path, content) of ``binaryFile`` or text reads; parsers emit one row per cue
and run in Arrow batches, so a corpus of small files is spread like any other table.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import format_timestamp

#: Code pages of old subtitle files by language.
CODE_PAGES = {"tr": "cp1254", "ar": "cp1256", "fa": "cp1256", "ru": "cp1251", "uk": "cp1251"}
MAX_ARCHIVE_BYTES = 20 << 20
_SRT_TIME = re.compile(r"\s*(\d+):(\d+):(\d+)[,.](\d{1,3})\s*-->\s*(\d+):(\d+):(\d+)[,.](\d{1,3})")
_VTT_AT = r"(?:(\d+):)?(\d+):(\d+)[.,](\d{1,3})"
#: A cue of WebVTT: its times, and the lines up to an empty one or the next times.
_VTT_CUE = re.compile(rf"^[^\S\n]*{_VTT_AT}\s*-->\s*{_VTT_AT}.*((?:\n(?![^\S\n]*(?:\d+:)?\d+:\d+[.,]\d{{1,3}}\s*-->).+)*+)", re.M)
_TAG = re.compile(r"<[^>]*>")


def _ms(h, m, s, ms) -> int:
    return int(h or 0) * 3_600_000 + int(m) * 60_000 + int(s) * 1000 + int(ms.ljust(3, "0") if len(ms) < 3 else ms)


def _lines(text: str) -> list[str]:
    return text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n").split("\n")


def parse_srt(text: str) -> list[tuple[int, int, str]]:
    """(start, end, text) of lenient SRT: indices may be wrong or missing, a blank line or the next cue's number ends a cue."""
    out, body, rows = [], None, _lines(text)
    for i, row in enumerate(rows):
        m = _SRT_TIME.match(row)
        if m:
            body = []
            out.append((_ms(*m.groups()[:4]), _ms(*m.groups()[4:]), body))
        elif not row.strip():
            body = None
        elif body is not None:
            if row.strip().isdigit() and i + 1 < len(rows) and _SRT_TIME.match(rows[i + 1]):
                body = None
            else:
                body.append(row.rstrip())
    return [(s, e, "\n".join(b)) for s, e, b in out]


def parse_vtt(text: str) -> list[tuple[int, int, str]]:
    """(start, end, text) of WebVTT: only an empty line ends a cue; tags are stripped, entities resolved, blank lines dropped."""
    cues = []
    for cue in _VTT_CUE.finditer("\n".join(_lines(text))):
        *times, body = cue.groups()
        shown = (html.unescape(_TAG.sub("", x)).strip() for x in body.split("\n"))
        cues.append((_ms(*times[:4]), _ms(*times[4:]), "\n".join(filter(None, shown))))
    return cues


def parse_any(text: str) -> list[tuple[int, int, str]]:
    return parse_vtt(text) if text.lstrip("﻿").lstrip()[:6].upper() == "WEBVTT" else parse_srt(text)


def read_cues(files: DataFrame, key: str = "path", content: str = "content", parser=parse_any) -> DataFrame:
    """(key, pos, start_ms, end_ms, text): one row per cue of every file text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, s, e, t) for k, text in zip(pdf[key], pdf[content]) for i, (s, e, t) in enumerate(parser(text or ""))]
            yield pd.DataFrame(rows, columns=[key, "pos", "start_ms", "end_ms", "text"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInPandas(run, f"{key} {kind}, pos long, start_ms long, end_ms long, text string")


def decode(data: bytes, language: str | None = None) -> str:
    """Text of a subtitle file: UTF-8, UTF-16 with a mark, the language's old code page, else Latin-1."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    for page in ("utf-8-sig", CODE_PAGES.get((language or "").split("-")[0].lower())):
        if page:
            try:
                return data.decode(page)
            except UnicodeDecodeError:
                pass
    return data.decode("latin-1")


@F.pandas_udf(StringType())
def decoded(data: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else decode(bytes(x), g) for x, g in zip(data, language)])


def read_archives(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, content): text of the first .srt or .vtt entry of each zip archive; bad or too large archives give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, data in zip(pdf[key], pdf[content]):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        entry = next((i for i in z.infolist() if i.filename.lower().endswith((".srt", ".vtt")) and i.file_size <= MAX_ARCHIVE_BYTES), None)
                        if entry:
                            rows.append((k, decode(z.read(entry))))
                except (zipfile.BadZipFile, TypeError):
                    continue
            yield pd.DataFrame(rows, columns=[key, "content"])

    return files.mapInPandas(run, f"{key} {files.schema[key].dataType.simpleString()}, content string")


def to_archives(files: DataFrame, key: str, content: str, name: str = "episode.srt") -> DataFrame:
    """(key, content): each text as a zip archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf[content]:
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as z:
                    z.writestr(name, text)
                out.append(buffer.getvalue())
            yield pd.DataFrame({key: pdf[key], "content": out})

    return files.mapInPandas(run, f"{key} {files.schema[key].dataType.simpleString()}, content binary")


def _episode_text(cues: DataFrame, block: Column, separator: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "unit_id", block.alias("block")))), lambda x: x["block"])
    return cues.groupBy("episode_id").agg(F.array_join(ordered, separator).alias("content"))


def to_srt(cues: DataFrame) -> DataFrame:
    """(episode_id, content): SRT text with numbered cues in time order."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("episode_id").orderBy("start_ms", "unit_id"))
    rows = cues.withColumn("n", n)
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), format_timestamp(F.col("start_ms")), F.lit(" --> "), format_timestamp(F.col("end_ms")), F.lit("\n"), F.trim("text"), F.lit("\n"))
    return _episode_text(rows, block, "\n")


def to_vtt(cues: DataFrame) -> DataFrame:
    """(episode_id, content): WebVTT text with escaped bodies in italics."""
    stamp = lambda c: F.regexp_replace(format_timestamp(F.col(c)), ",", ".")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim("text"), "&", "&amp;"), "<", "&lt;"), "\n", "</i>\n<i>")
    block = F.concat(stamp("start_ms"), F.lit(" --> "), stamp("end_ms"), F.lit("\n<i>"), body, F.lit("</i>\n"))
    return _episode_text(cues, block, "\n").withColumn("content", F.concat(F.lit("WEBVTT\n\n"), "content"))


def review_file(units: DataFrame) -> DataFrame:
    """(episode_id, content): the lines that need review, under a header with counts."""
    from pyspark.sql import functions as G

    entry = G.concat(G.format_string("#%d  ", G.col("unit_id") + 1), format_timestamp(G.col("start_ms")), G.lit(" --> "), format_timestamp(G.col("end_ms")), G.lit("  "), G.col("confidence"), G.lit("  ["), G.array_join("reasons", ", "), G.lit("]\n  SRC: "), G.col("text"), G.lit("\n"))
    rows = units.withColumn("entry", G.when(G.col("confidence") != "HIGH", G.struct("unit_id", entry.alias("x"))))
    g = rows.groupBy("episode_id").agg(G.count("*").alias("n"), G.array_sort(G.collect_list("entry")).alias("e"))
    head = G.format_string("Lines needing review: %d of %d (approved lines are not listed)\n\n", G.size("e"), G.col("n"))
    return g.select("episode_id", G.concat(head, G.array_join(G.transform("e", lambda v: v["x"]), "\n")).alias("content"))


def jsonl_prefix(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, pos, record): JSON lines of each file up to the first damaged one; an unterminated last line counts as damaged."""
    rows = files.select(key, F.posexplode(F.split(content, "\n")).alias("pos", "record"), F.size(F.split(content, "\n")).alias("n"))
    rows = rows.withColumn("bad", F.try_parse_json("record").isNull() | (F.col("pos") == F.col("n") - 1))
    from pyspark.sql import Window

    first_bad = F.min(F.when(F.col("bad"), F.col("pos"))).over(Window.partitionBy(key))
    return rows.withColumn("stop", first_bad).where(F.col("stop").isNull() | (F.col("pos") < F.col("stop"))).select(key, "pos", "record")
