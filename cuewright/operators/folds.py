"""Passes in order within a key, whose state is bounded and which give their rows as they go."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are handed on at a time.
ROWS = 4096


def ordered_fold(rows: DataFrame, keys: list[str], order: list[Column], columns: list[str], fold: Callable[[Iterator[tuple]], Iterator[tuple]], values: str) -> DataFrame:
    """(keys, values) of ``fold`` over each key's rows in order.

    ``fold`` gets an iterator of the ``columns`` of one key's rows, sorted, and yields rows of the
    schema ``values``.  Spark deals the rows by key and sorts them, spilling where it must; the rows
    of a key stream by, so that a key of any length needs no more memory than the fold's own state.
    """
    used = rows.select(*keys, *columns)
    schema = StructType([*used.select(*keys).schema.fields, *StructType.fromDDL(values).fields])
    arrow, n_keys = to_arrow_schema(schema), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

        out: list[tuple] = []
        for key, group in groupby((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), itemgetter(slice(n_keys))):
            for row in fold(r[n_keys:] for r in group):
                out.append((*key, *row))
                if len(out) == ROWS:
                    yield handed(out)
                    out = []
        if out:
            yield handed(out)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *columns).mapInArrow(run, schema)
