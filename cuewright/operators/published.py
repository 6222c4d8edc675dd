"""Tables that grow by runs: a cache of model replies, and a history of reports.

Both add whole folders and never change one.  A run's folder is written under a name that readers skip and then
renamed, in the file system of the table's path (any that Spark has), so that readers see all of a run or nothing of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Folder:
    """A table's folder in its own file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        return self._fs.exists(self._new(f"{self.path}/{name}"))

    def publish(self, rows: DataFrame, name: str) -> bool:
        """Write ``rows`` as ``name`` unless it is there; of two runs at once the first to be renamed counts.  Whether these rows did."""
        if self.has(name):
            return False
        pending = f"_pending-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{pending}/{name}")
        if not self.has(name) and self._fs.rename(self._new(f"{self.path}/{pending}/{name}"), self._new(f"{self.path}/{name}")):
            self._fs.delete(self._new(f"{self.path}/{pending}"), True)
            return True
        self._fs.delete(self._new(f"{self.path}/{pending}"), True)
        return False

    def table(self, schema: str, prefix: str) -> DataFrame:
        """All published folders ``prefix=...`` as one table, the rest of the name as a column."""
        found = self._fs.globStatus(self._new(f"{self.path}/{prefix}=*")) if self._fs.exists(self._new(self.path)) else None
        if not found:
            return self.spark.createDataFrame([], f"{schema}, {prefix} string")
        return self.spark.read.schema(f"{schema}, {prefix} string").option("basePath", self.path).parquet(f"{self.path}/{prefix}=*")


def request_key(*parts: Column | str) -> Column:
    """The key of a request: a hash of everything that its reply depends on (model, version of the prompt, payload); null parts count."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("\u0000")) for p in parts])).cast("binary"), 256)


def with_replies(requests: DataFrame, cache: str, ask: Callable[[list[str]], list[str | None]], payload: str = "payload", key: Column | None = None, batch: int = 16, tasks: int | None = None) -> DataFrame:
    """``requests`` with ``reply``: from the cache, and what it lacks from ``ask(payloads)``, which is then added to the cache.

    A payload that many rows have in common is asked once; a second run over the same requests asks nothing.  A reply of
    None (a request that failed) is not kept, so the next run asks again.  ``tasks`` bounds the requests under way.
    A column ``reply`` of the requests is replaced.
    """
    spark = requests.sparkSession
    folder = Folder(spark, cache)
    key = request_key(payload) if key is None else key
    name = "_request_key"
    rows = requests.withColumn(name, key)
    known = folder.table("key string, reply string", "run")
    wanted = rows.groupBy(F.col(name).alias("key")).agg(F.min(payload).alias("payload")).join(known.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                replies = ask(part["payload"].tolist())
                if len(replies) != len(part):
                    replies = [(ask([p]) or [None])[0] for p in part["payload"]]
                yield pd.DataFrame({"key": part["key"].to_numpy(), "reply": replies})

    dealt = wanted.repartition(tasks, "key") if tasks else wanted.repartition("key")
    folder.publish(dealt.mapInPandas(run, "key string, reply string").where("reply is not null"), f"run={uuid.uuid4().hex}")
    # Two runs at the same time may both have asked: one reply of each key counts.
    replies = folder.table("key string, reply string", "run").groupBy("key").agg(F.min("reply").alias("reply"))
    out = rows.alias("d").join(replies.alias("r"), F.col(f"d.{name}") == F.col("r.key"), "left")
    return out.select(*[F.col(f"d.`{c}`") for c in requests.columns if c != "reply"], "r.reply")


def append_report(summary: DataFrame, history: str, run: str) -> bool:
    """Add rows (metric, value) of a run to the history; one that is there already adds nothing.  Whether it was added."""
    if not run or "/" in run or "=" in run:
        raise ValueError("a run's name is a folder's name, without / and =")
    return Folder(summary.sparkSession, history).publish(summary.select(F.col("metric").cast("string"), F.col("value").cast("double")), f"report={run}")


def report_history(spark: SparkSession, history: str) -> DataFrame:
    """(report, metric, value) of all runs in the history."""
    return Folder(spark, history).table("metric string, value double", "report").select("report", "metric", "value")
