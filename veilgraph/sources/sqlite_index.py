"""Index files in SQLite, of schema 1 and 2, as tables: ranges of row ids are read side by side, with the columns that are asked for.

All tasks must see one state of the file. A file with a write-ahead log beside it isn't closed and is refused; of others the
header counts every change, and each task compares that count and the size before and after it reads.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..errors import InputError
from .files import Place

#: Tables and columns that perturbation reads. Fixed values of the file format.
TABLES = {
    "run": "status string, schema_version int, fhir_version string",
    "sources": "id int, path string",
    "resources": "id long, identity string, digest string, resource_type string, logical_id string, contained boolean, payload string",
    "occurrences": "id long, resource_id long, source_id int, locator string",
    "resource_references": "id long, source_resource_id long, path string, literal string, kind string, target_resource_id long, status string",
    "patient_memberships": "resource_id long, patient_resource_id long, basis string",
    "issues": "severity string, code string",
}
#: Row ids of a part, and rows of a batch.
PART, BATCH = 100_000, 5_000


class Changed(RuntimeError):
    """The file is another than when its parts were planned."""


def stamp(path: str) -> str:
    """What changes with each change to the file."""
    with open(path, "rb") as file:
        head = file.read(100)
    if head[:16] != b"SQLite format 3\x00" or os.path.exists(f"{path}-wal") and os.path.getsize(f"{path}-wal"):
        raise InputError("The index file is no SQLite file, or one that is still being written.")
    return f"{head[24:28].hex()}-{os.path.getsize(path)}"


def connect(path: str) -> sqlite3.Connection:
    base = sqlite3.connect(f"file:{path.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)
    base.execute("PRAGMA query_only=ON")
    return base


def here(options: dict) -> str:
    """Where this machine has the file."""
    return SparkFiles.get(options["shipped"]) if options.get("shipped") else options["path"]


class IndexFile(DataSource):
    """spark.read.format("veilgraph_index_file").option("table", ...).load(path); with .schema(...) just its columns are read."""

    @classmethod
    def name(cls) -> str:
        return "veilgraph_index_file"

    def schema(self) -> str:
        return TABLES[self.options["table"]]

    def reader(self, schema: StructType) -> IndexReader:
        return IndexReader(dict(self.options), schema)


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class IndexReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.options, self.columns, self.arrow = options, schema.fieldNames(), to_arrow_schema(schema)
        self.table, self.state, self.part = options["table"], options["state"], int(options.get("part", PART))
        if self.table not in TABLES or not set(self.columns) <= {c.split()[0] for c in TABLES[self.table].split(", ")}:
            raise ValueError("no such table or column")

    def partitions(self) -> list[InputPartition]:
        with closing(connect(here(self.options))) as base:
            first, last = base.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        if first is None:  # an empty list would count as one part that says nothing
            first, last = 1, 0
        return [Range(1, 0)] if last < first else [Range(a, min(a + self.part - 1, last)) for a in range(first, last + 1, self.part)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        path = here(self.options)
        self._same(path)
        with closing(connect(path)) as base:
            rows = base.execute(f"SELECT {', '.join(self.columns) or 'NULL'} FROM {self.table} WHERE rowid BETWEEN ? AND ?", (partition.first, partition.last))
            while found := rows.fetchmany(BATCH):
                columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([self._array(c, f.type) for c, f in zip(columns, self.arrow, strict=False)], schema=self.arrow)
        self._same(path)

    @staticmethod
    def _array(values: tuple, kind: pa.DataType) -> pa.Array:
        return pa.array([None if v is None else bool(v) for v in values] if pa.types.is_boolean(kind) else values, kind)

    def _same(self, path: str) -> None:
        if stamp(path) != self.state:
            raise Changed("The index file has changed while it was read.")


def open_file(spark: SparkSession, place: Place, part: int = PART) -> dict[str, DataFrame]:
    """The tables of an index file. On a cluster, or where the file isn't on a file system of this machine, Spark ships it to its executors."""
    options = {"part": str(part)}
    if place.local and spark.sparkContext.master.startswith("local["):
        options["path"] = str(place.local)
    else:
        spark.sparkContext.addFile(place.uri)
        options["shipped"] = place.name
    try:
        options["state"] = stamp(here(options))
        with closing(connect(here(options))) as base:
            for name, columns in TABLES.items():
                base.execute(f"SELECT {', '.join(c.split()[0] for c in columns.split(', '))} FROM {name} LIMIT 0")
    except sqlite3.Error:
        raise InputError("The index file is no SQLite file of an index that can be read.") from None
    spark.dataSource.register(IndexFile)
    return {name: spark.read.format(IndexFile.name()).options(table=name, **options).load() for name in TABLES}
