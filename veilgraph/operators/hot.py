"""Joins of which a few keys have most of the rows.

Each task sums up its keys in a Misra-Gries sketch, a bounded table of counters; sums over tasks show which keys
can have more rows than a fraction of a task's share. Their rows don't meet in one task: where the other side has a row for each
key, these few rows are broadcast and the many stay where they are; else the many are dealt out by a salt. All other keys are shuffled as ever.
This is done by rows counted, before the join, and needs no adaptive execution. A table that one task could join is joined as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise

#: A key is hot from this part of a task's share of rows on; its rows are dealt out in so many parts for each task.
PART, PARTS = 4, 64
#: Bytes of a table that one task joins well, whatever its keys.
SMALL = 16 << 20


class Sketch:
    """Misra-Gries: what `most` counters tell of a stream. A key that occurs n times of N keeps a count of n - N / (most + 1) at least, and n at most."""

    def __init__(self, most: int):
        self.most = most
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        new, counts = np.unique(keys, return_counts=True)
        self.merge(new, counts)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        both, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        sums = np.bincount(at, np.concatenate([self.counts, counts]).astype(np.float64), len(both)).astype(np.int64)
        if len(both) > self.most:  # all go down by the first count too many
            sums = sums - np.partition(sums, -self.most - 1)[-self.most - 1]
            both, sums = both[sums > 0], sums[sums > 0]
        self.keys, self.counts = both, sums


def hot_keys(df: DataFrame, key: Column, tasks: int) -> list[tuple[int, int]]:
    """(hash, rows at least) of keys that have more than a part of a task's share of df's rows; `8 * tasks` at most, however many keys there are."""
    most = 2 * PART * tasks - 1

    def sketch(batches) -> Iterator[pa.RecordBatch]:
        found, n = Sketch(most), 0
        for batch in batches:
            found.add(batch.column(0).to_numpy())
            n += batch.num_rows
        keys, counts = [*found.keys.tolist(), None], [*found.counts.tolist(), n]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["hot", "n"])

    # rows of one partition are few; the row without a key counts all. What is below the error bound goes
    rows = df.select(key.alias("hot")).mapInArrow(sketch, "hot long, n long").groupBy("hot").agg(F.sum("n").alias("n"))
    rows = materialise(rows)  # the table is read for it once
    total = rows.filter("hot IS NULL").first()
    least = (total["n"] if total else 0) / (most + 1)
    found = rows.filter(F.col("hot").isNotNull() & (F.col("n") >= max(least, 2))).collect()
    return sorted((r["hot"], r["n"]) for r in found)


def join(many: DataFrame, few: DataFrame, on: list[tuple[str, str]], how: str = "inner", *, unique: bool, by: list[str] | None = None, tasks: int | None = None, small: int | None = None, shuffled: bool = False) -> DataFrame:
    """many joined with few where all pairs of columns in `on` are equal, nulls too; `how` is inner or left. The right-hand columns of `on` go.

    unique: few has a row at most for each key. Else hot rows of `many` are dealt out by a hash of the columns `by` (all of them, if not given), and the rows of
    few that meet them are repeated for each part. A table of fewer than `small` bytes (`SMALL`) is joined as it is. shuffled: but for its rows of hot keys,
    few is never broadcast, which sends it through the driver: for joins of many rounds.
    """
    return joiner(many, on, how, unique=unique, by=by, tasks=tasks, small=small, shuffled=shuffled)(few)


def joiner(many: DataFrame, on: list[tuple[str, str]], how: str = "inner", *, unique: bool, by: list[str] | None = None, tasks: int | None = None, small: int | None = None, shuffled: bool = False) -> Callable[[DataFrame], DataFrame]:
    """`join` with many, whose hot keys are looked for once, as a function of few."""
    spark = many.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    left, right = [a for a, _ in on], [b for _, b in on]
    code, mark, parts, salt, few_salt = "_hot_code", "_hot_key", "_hot_parts", "_hot_salt", "_hot_few_salt"
    equal = lambda: _all(F.col(a).eqNullSafe(F.col(b)) for a, b in on)
    kept = lambda few: few.hint("merge") if shuffled else few
    plan = many._jdf.queryExecution().optimizedPlan()
    if int(str(plan.stats().sizeInBytes())) < (SMALL if small is None else small):
        return lambda few: many.join(kept(few), equal(), how).drop(*right)
    if not plan.nodeName().startswith("Relation"):  # it is read three times
        many = materialise(many)
    found = hot_keys(many, F.xxhash64(*left), tasks)
    if not found:
        return lambda few: many.join(kept(few), equal(), how).drop(*right)
    share = max(1, sum(n for _, n in found) // (tasks * PARTS))
    # as many rows as hot keys: 8 a task at most
    hot = F.broadcast(spark.createDataFrame([(h, max(1, min(PARTS * tasks, n // share))) for h, n in found], f"{mark} long, {parts} int"))
    told = lambda df, columns, how: df.withColumn(code, F.xxhash64(*columns)).join(hot, F.col(code) == F.col(mark), how).drop(code, mark)

    def stay(few: DataFrame) -> DataFrame:
        cold = told(many, left, "left_anti").join(kept(told(few, right, "left_anti")), equal(), how)
        return told(many, left, "left_semi").join(F.broadcast(told(few, right, "left_semi")), equal(), how).unionByName(cold).drop(*right)

    def deal(few: DataFrame) -> DataFrame:
        nth = F.pmod(F.xxhash64(F.lit(7), *(by or many.columns)), F.coalesce(parts, F.lit(1))).cast("int")
        dealt = told(many, left, "left").withColumn(salt, nth).drop(parts)
        copies = told(few, right, "left").withColumn(few_salt, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop(parts)
        return dealt.join(kept(copies), equal() & (F.col(salt) == F.col(few_salt)), how).drop(*right, salt, few_salt)

    return stay if unique else deal


def _all(conditions) -> Column:
    out = None
    for one in conditions:
        out = one if out is None else out & one
    return out
