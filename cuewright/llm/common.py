"""Helpers shared by the llm operators: written intermediate tables, batch slicing, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where it is unset, a temporary one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="cuewright-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``max_bytes`` of the text column (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.nan_to_num(np.asarray(pc.binary_length(batch[column]).to_numpy(zero_copy_only=False), dtype=float))
        part = (np.cumsum(sizes) // max_bytes).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def rows_before(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Slice borders in a sorted position array ``at`` for each row that begins at ``first[i]``."""
    return np.searchsorted(at, first, side="left")


#: Keys that are joined by a broadcast.
HOT_KEYS = 1000


def join_keys(rows: DataFrame, keyed: DataFrame, key: list[str], weight: str) -> DataFrame:
    """``rows`` joined to ``keyed``, which has one row a key and in ``weight`` the number of its rows.

    The HOT_KEYS keys with the most rows are broadcast, a fixed number, so their rows stay
    where they are.  None of the other keys holds more than 1 / HOT_KEYS of the rows; they
    are joined by a shuffle.
    """
    hot = keyed.orderBy(F.desc(weight), *key).limit(HOT_KEYS)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(keyed, key)
    return near.unionByName(far).drop(weight)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b) rows; component = smallest node reachable.

    Alternating large-star and small-star rounds; each round is one grouped min and one
    join on ids, and is written to the shared folder.  No adjacency list is collected:
    the minimum of a neighbourhood is an aggregate with map-side combine.  The join is a
    plain one, whose hot nodes are left to Spark's skew join; ``join_keys`` would add a sort and
    more shuffles to every round.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while True:
        # Large star: link every larger neighbour of a node to the least of the node's neighbourhood.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, name)
        # Small star: link every smaller-or-equal neighbour and the node itself to the least one.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = written(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), name)
        # Done where every node has one edge down and none of their lower ends has one itself.
        ends = small.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(small.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        open_ = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down + up > 1")
        e = small
        if open_.isEmpty():
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def kind_of(rows: DataFrame, column: str = "doc_id") -> str:
    """The type of a column, for the schemas of results: ids keep their own type."""
    return rows.schema[column].dataType.simpleString()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows: texts are long, and the default of 10,000 rows is held several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
