"""Shards: rows dealt to tasks by a hash and sorted by it, so that a task meets each key's rows together and needs to hold just a few keys at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt(rows: DataFrame, shard: Column, name: str = "shard") -> DataFrame:
    """rows with `shard` as column `name`, dealt out by it and sorted by it within each task."""
    return rows.withColumn(name, shard).repartition(F.col(name)).sortWithinPartitions(name)


def runs(batches: Iterator[pa.RecordBatch], name: str, most: int, shrink: Callable[[pa.Table], pa.Table] | None = None) -> Iterator[pa.Table]:
    """The rows of batches sorted by column `name`, in tables of about `most` rows that cut no run of equal values.

    A single run may have more rows; `shrink`, which may add rows of one key up but not drop a key, keeps its table small then.
    """
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < most:
            continue
        table = pa.Table.from_batches(held)
        shards = table.column(name).combine_chunks().to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(shards, shards[-1], side="left"))
        if cut:
            yield table.slice(0, cut)
            table = table.slice(cut)
        elif shrink is not None:
            table = shrink(table)
        held, size = table.to_batches(), table.num_rows if cut else 0
    if held:
        yield pa.Table.from_batches(held)
