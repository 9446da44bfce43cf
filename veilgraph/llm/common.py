"""What the corpus operators share: inputs, the shared folder, fresh names."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import materialise as materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that Spark sends to Python at once, at most, while texts are among them.
ROWS_AT_ONCE = 1000


def bounded_batches(df: DataFrame) -> DataFrame:
    """df itself; its session is set to send Python at most `ROWS_AT_ONCE` rows at a time: ten thousand texts, in several copies, are too many for small executors."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= ROWS_AT_ONCE:
        conf.set(name, str(ROWS_AT_ONCE))
    return df


def give_back() -> None:
    """Return what this Python worker has freed to the system: workers are reused, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, for mapInArrow, with freed memory given back after the last batch."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def salted(rows: DataFrame, few: DataFrame, key: str, by: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """rows joined with `few`, which has a row for some values of `key`; the rows of a value go to `salts` tasks by a hash of `by`.

    `few` grows with the data, so it is never broadcast.
    """
    (salt,) = fresh([*rows.columns, *few.columns], "salt")
    few = few.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return rows.withColumn(salt, F.pmod(F.hash(by), F.lit(salts))).join(few, [key, salt], how).drop(salt)


def passing(df: DataFrame, new: Iterable[str], without: str | None = None) -> list[str]:
    """The columns of df that pass through: all but those named as new ones (without regard to case) and `without`."""
    names = {x.lower() for x in new}
    return [c for c in df.columns if c.lower() not in names and c != without]


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, made unlike all in `taken` (without regard to case)."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def blocks_for(rows: int, rows_per_block: int) -> int:
    return max(1, -(-rows // rows_per_block))


def slices(rows: list, weigh, limit: int) -> list[list]:
    """rows in runs whose weights sum up to `limit` at most (a single row may weigh more)."""
    out, room = [], 0
    for row in rows:
        w = weigh(row)
        if not out or w > room:
            out.append([])
            room = limit
        out[-1].append(row)
        room -= w
    return out


def pack(df: DataFrame, text: str) -> DataFrame:
    """df with `text` as zstd-compressed bytes, for shuffles: their own codec halves no text."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == text else f.dataType, f.nullable) for f in df.schema])

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            small = pa.array([None if x is None else squeeze(x.encode()) for x in batch.column(text).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([small if c == text else batch.column(c) for c in schema.fieldNames()], schema.fieldNames())

    return df.mapInArrow(tidy(run), schema)


def unpacked(column: pa.ChunkedArray) -> pa.Array:
    """The texts of a packed column."""
    restore = zstandard.ZstdDecompressor().decompress
    return pa.array([None if x is None else restore(x) for x in column.to_pylist()], pa.large_binary()).cast(pa.large_string())


def unpack(df: DataFrame, text: str) -> DataFrame:
    """The reverse of `pack`."""
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text else f.dataType, f.nullable) for f in df.schema])

    def run(batches):
        for batch in batches:
            # packed texts of a batch may be more than is good to hold at once
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = unpacked(pa.chunked_array([part.column(text)])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([texts if c == text else part.column(c) for c in schema.fieldNames()], schema.fieldNames())

    return df.mapInArrow(tidy(run), schema)
