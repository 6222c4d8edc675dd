"""Structured Streaming forms: folds of stage events, windowed quality and per-episode late-row filters.

Sources are file streams; each job runs with ``availableNow`` and writes Parquet (or a
foreachBatch snapshot) under the shared folder, so tests and backfills end by themselves.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def place(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's output and checkpoint in the shared folder; where none is named, a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="cuewright-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's Parquet files as a stream."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name[:-1]}[{name[-1]}].parquet")


def run_appending(stream: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream to its end and return what it wrote."""
    spark = stream.sparkSession
    at = place(spark, name)
    stream.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def run_complete(stream: DataFrame, name: str) -> DataFrame:
    """Run a complete-mode aggregation to its end and return the last snapshot."""
    spark = stream.sparkSession
    at = place(spark, name)

    def snapshot(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out")

    stream.writeStream.outputMode("complete").foreachBatch(snapshot).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def windowed_quality(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and share of high values per time window, with a watermark for late rows."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", window)).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 100).alias("high")).select(F.unix_millis(F.col("window.start")).alias("window_ms"), "n", "high")


def accepted_segments(events: DataFrame) -> DataFrame:
    """Per user, segments in time order whose end lies beyond what was accepted before; others are late or repeated."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        offset = state.get[0] if state.exists else -(1 << 62)
        keep = []
        for pdf in sorted(batches, key=lambda p: int(p["start_ms"].min())):
            for row in pdf.sort_values(["start_ms", "seg_id"]).itertuples(index=False):
                if row.end_ms > offset:
                    offset = row.end_ms
                    keep.append((key[0], row.seg_id, row.start_ms, row.end_ms))
        state.update((offset,))
        yield pd.DataFrame(keep, columns=["episode_id", "seg_id", "start_ms", "end_ms"])

    rows = events.select(F.col("user_id").alias("episode_id"), F.col("event_id").alias("seg_id"), F.expr("unix_millis(cast(ts as timestamp))").alias("start_ms"), F.expr("unix_millis(cast(ts as timestamp)) + cast(floor(value * 60000) as bigint)").alias("end_ms"))
    return rows.groupBy("episode_id").applyInPandasWithState(step, "episode_id long, seg_id long, start_ms long, end_ms long", "offset long", "append", "NoTimeout")


def per_line(stream: DataFrame, check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stateless checks on lines as they arrive."""
    return check(stream)
