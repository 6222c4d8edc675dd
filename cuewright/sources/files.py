"""Subtitle files by format name: ``spark.read.format("subtitles").load(path)``, the same as a stream, and a writer.

    register(spark)
    cues = spark.read.format("subtitles").load("/data/subs")
    files.write.format("subtitles").option("extension", "srt").mode("append").save("/data/out")

The reader lists .srt, .vtt and .zip files below the path, deals them by size, and gives a row a cue: path,
lang, pos, start_ms, end_ms, text, corrupt.  ``lang`` comes from a folder ``lang=xx`` or the option ``language`` and
picks the old code page.  A file that can't be read or has no cues gives one row that says why in ``corrupt``.

As a stream, files are taken by (time of change, path) once they are ``settle_ms`` old, so a file is read once
and none that lands while a batch is planned is passed over.

The writer takes rows (name, content), content as text or bytes, a file each.  Tasks write to a folder of their
own attempt, under a hidden one of the run; the driver moves the files of the attempts that count into place, so a
task that is killed or runs twice leaves no file and no half of one that a reader would see.

Files are reached through Arrow's file systems (local, s3, gs, and hdfs where its library is there).  For stores
that only Spark reads, ``cues_of`` does the same over ``binaryFile``, as a batch or a stream.
"""

from __future__ import annotations

import io
import posixpath
import re
import time
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .subtitles import MAX_ARCHIVE_BYTES, decode, parse_any

SUFFIXES = (".srt", ".vtt", ".zip")
COLUMNS = "path string, lang string, pos long, start_ms long, end_ms long, text string, corrupt string"
_LANG = re.compile(r"(?:^|/)lang=([^/]+)/")


def cues_in(path: str, data: bytes, language: str | None) -> Iterator[tuple]:
    """Rows (path, lang, pos, start_ms, end_ms, text, corrupt) of one file."""
    found = _LANG.search(path)
    lang = found[1] if found else language
    try:
        if path.lower().endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                entry = next(i for i in z.infolist() if i.filename.lower().endswith(SUFFIXES[:2]) and i.file_size <= MAX_ARCHIVE_BYTES)
                data = z.read(entry)
        cues = parse_any(decode(data, lang))
        problem = None if cues else "no cues"
    except zipfile.BadZipFile:
        cues, problem = [], "not an archive"
    except StopIteration:
        cues, problem = [], "no subtitle file of allowed size in the archive"
    if problem:
        yield path, lang, None, None, None, None, problem
    for pos, (start, end, text) in enumerate(cues):
        yield path, lang, pos, start, end, text, None


@dataclass
class Files(InputPartition):
    paths: list[str]


class _Reads:
    """What batch and stream have in common: the listing, its parts and their rows."""

    def __init__(self, options: dict):
        self.path, self.language = options["path"], options.get("language")
        self.part_bytes, self.settle_ms = int(options.get("part_bytes", 16 << 20)), int(options.get("settle_ms", 1000))

    def listed(self) -> list[tuple[int, str, int]]:
        """(time of change in ns, path, size) of all files, in this order."""
        store, root = fs.FileSystem.from_uri(self.path)
        files = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        hidden = lambda p: any(x[:1] in "._" for x in posixpath.relpath(p, root).split("/"))
        return sorted((f.mtime_ns or 0, f.path, f.size or 0) for f in files if f.type == fs.FileType.File and f.path.lower().endswith(SUFFIXES) and not hidden(f.path))

    def parts(self, files: list[tuple[int, str, int]]) -> Sequence[InputPartition]:
        out, size = [Files([])], 0
        for _, path, n in files:
            if out[-1].paths and size + n > self.part_bytes:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            try:
                with store.open_input_stream(path) as f:
                    data = f.read()
            except OSError as e:
                yield path, None, None, None, None, None, f"unreadable: {type(e).__name__}"
                continue
            yield from cues_in(path, data, self.language)


class SubtitleReader(_Reads, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        return self.parts(self.listed())


class SubtitleStream(_Reads, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"ns": -1, "path": ""}

    def latestOffset(self) -> dict:
        before = time.time_ns() - self.settle_ms * 1_000_000
        last = max(((ns, path) for ns, path, _ in self.listed() if ns <= before), default=(-1, ""))
        return {"ns": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        lo, hi = ((o["ns"], o["path"]) for o in (start, end))
        return self.parts([f for f in self.listed() if lo < f[:2] <= hi])


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
    folder: str


class SubtitleWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.extension, self.run = options["path"], options.get("extension", "srt"), f".writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, root = fs.FileSystem.from_uri(self.path)
        folder = f"{root}/{self.run}/{TaskContext.get().taskAttemptId()}"
        names = []
        for name, content in iterator:
            if content is None:
                continue
            name = f"{name}.{self.extension}"
            store.create_dir(posixpath.dirname(f"{folder}/{name}"), recursive=True)
            with store.open_output_stream(f"{folder}/{name}") as f:
                f.write(content.encode() if isinstance(content, str) else bytes(content))
            names.append(name)
        return Written(names, folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for message in filter(None, messages):
            for name in message.names:
                store.create_dir(posixpath.dirname(f"{root}/{name}"), recursive=True)
                store.move(f"{message.folder}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Nothing stays of this run's own folder."""
        store, root = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(f"{root}/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.run}")


class SubtitleSource(DataSource):
    """The format ``subtitles``; see the module's text."""

    @classmethod
    def name(cls) -> str:
        return "subtitles"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> DataSourceReader:
        return SubtitleReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return SubtitleStream(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if len(schema) != 2:
            raise ValueError("the writer takes rows (name, content)")
        return SubtitleWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SubtitleSource)


def cues_of(files: DataFrame, language: str | None = None) -> DataFrame:
    """COLUMNS of a ``binaryFile`` table (path, content), batch or stream, in any store that Spark reads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for pdf in batches:
            rows = [row for path, data in zip(pdf["path"], pdf["content"]) for row in cues_in(path, bytes(data), language)]
            yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("pos", "start_ms", "end_ms")})

    return files.where(F.lower("path").rlike(r"\.(srt|vtt|zip)$")).select("path", "content").mapInPandas(run, COLUMNS)
