"""The subtitle format: mixed code pages and damaged files, streams of new files, writers that fail."""

import io
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from cuewright.sources import files
from cuewright.streaming.jobs import place

SRT = "1\n00:00:01,000 --> 00:00:02,500\n{}\n"


def zipped(name, text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, text)
    return out.getvalue()


@pytest.fixture()
def folder(tmp_path):
    def put(name, data):
        at = tmp_path / "subs" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)

    put("a.srt", SRT.format("naïve").encode())
    put("b.vtt", "WEBVTT\n\n00:01.000 --> 00:02.500\n<i>bold &amp; new</i>\n".encode("utf-8-sig"))
    put("lang=tr/c.srt", SRT.format("ığdır şu").encode("cp1254"))
    put("lang=ru/deep/d.SRT", SRT.format("привет").encode("cp1251"))
    put("e.srt", SRT.format("wide").encode("utf-16"))
    put("f.zip", zipped("x/y.srt", SRT.format("packed")))
    put("g.zip", b"PK not really")
    put("h.zip", zipped("readme.txt", "nothing"))
    put("i.srt", b"no times here")
    put("j.txt", SRT.format("not a subtitle file").encode())
    put(".hidden/k.srt", SRT.format("hidden").encode())
    return str(tmp_path / "subs")


WANT = {"a.srt": "naïve", "b.vtt": "bold & new", "c.srt": "ığdır şu", "d.SRT": "привет", "e.srt": "wide", "f.zip": "packed"}
PROBLEMS = {"g.zip": "not an archive", "h.zip": "no subtitle file of allowed size in the archive", "i.srt": "no cues"}


def named(rows, column):
    return {os.path.basename(r["path"]): r[column] for r in rows if r[column] is not None}


def test_a_directory_of_mixed_code_pages(spark, folder):
    files.register(spark)
    for parts, options in ((1, {}), (9, {"part_bytes": 1})):
        df = spark.read.format("subtitles").options(**options).load(folder)
        rows = df.collect()
        assert named(rows, "text") == WANT and named(rows, "corrupt") == PROBLEMS
        assert {(r["start_ms"], r["end_ms"], r["pos"]) for r in rows if not r["corrupt"]} == {(1000, 2500, 0)}
        assert df.rdd.getNumPartitions() == parts
    assert {r["lang"] for r in rows} == {None, "tr", "ru"}
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{folder}")
    rows = files.cues_of(binary).collect()
    assert named(rows, "text") == WANT and named(rows, "corrupt") == PROBLEMS
    assert spark.read.format("subtitles").load(f"{folder}/none").count() == 0


def test_a_stream_reads_each_file_once(spark, folder, tmp_path):
    files.register(spark)
    stream = spark.readStream.format("subtitles").option("settle_ms", 0).load(folder).where("corrupt is null")
    query = stream.writeStream.format("memory").queryName("subs").option("checkpointLocation", place(spark, "subs")).start()
    try:
        query.processAllAvailable()
        assert named(spark.table("subs").collect(), "text") == WANT
        time.sleep(0.1)
        with open(f"{folder}/new.srt", "w") as f:
            f.write(SRT.format("later"))
        query.processAllAvailable()
        rows = spark.table("subs").collect()
        assert len(rows) == len(WANT) + 1 and named(rows, "text") == {**WANT, "new.srt": "later"}
    finally:
        query.stop()


def test_what_is_written_is_read_again(spark, tmp_path):
    files.register(spark)
    at = str(tmp_path / "out")
    rows = spark.createDataFrame([("ep1", SRT.format("one").encode()), ("lang=tr/ep2", SRT.format("ış").encode("cp1254")), ("none", None)], "name string, content binary")
    rows.repartition(3).write.format("subtitles").mode("append").save(at)
    assert named(spark.read.format("subtitles").load(at).collect(), "text") == {"ep1.srt": "one", "ep2.srt": "ış"}
    assert sorted(os.listdir(at)) == ["ep1.srt", "lang=tr"]


def test_a_task_that_fails_leaves_no_file(spark, tmp_path):
    files.register(spark)
    at = str(tmp_path / "out")

    @F.udf("string")
    def content(i):
        if i == 37:
            raise ValueError("task dies")
        return SRT.format(i)

    rows = spark.range(0, 40, 1, 4).select(F.col("id").cast("string").alias("name"), content("id").alias("content"))
    with pytest.raises(Exception, match="task dies"):
        rows.write.format("subtitles").mode("append").save(at)
    # A task that still ran when the driver gave up may leave its hidden folder, which no reader looks into.
    assert not os.path.exists(at) or all(x.startswith(".writing-") for x in os.listdir(at))
    assert spark.read.format("subtitles").load(at).count() == 0
    rows.where("name <> '37'").write.format("subtitles").mode("append").save(at)
    assert sum(not x.startswith(".") for x in os.listdir(at)) == 39
