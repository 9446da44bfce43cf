"""Packages of examples, .tgz or .zip, as tables of their members, which are never unpacked to disk."""

from __future__ import annotations

import json
import tarfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import InputError

BATCH = 4 << 20


def _members(path: str) -> Iterator[tuple[str, bytes]]:
    """(name, content) of files, as they stand in the archive."""
    if path.lower().endswith(".zip"):
        with zipfile.ZipFile(path) as archive:
            for member in archive.infolist():
                if not member.is_dir():
                    yield member.filename, archive.read(member)
    else:
        with tarfile.open(path, "r|*") as archive:
            for member in archive:
                if member.isfile():
                    yield member.name, archive.extractfile(member).read()


def check_identity(path: Path | str, name: str, version: str, descriptor: str = "package/package.json") -> None:
    """Raise if the archive's descriptor doesn't name this package and version."""
    found = next((json.loads(content.decode("utf-8-sig")) for member, content in _members(str(path)) if member == descriptor), {})
    if (found.get("name"), found.get("version")) != (name, version):
        raise InputError("The archive is not the package, or not the version, that was asked for.")


def scan(spark: SparkSession, archives: list[Path], ending: str = ".json") -> DataFrame:
    """(archive, name, text) of members with an ending; an archive is a stream, so each is read by one task, in batches of bounded size."""
    paths = [str(p) for p in archives]

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                held, size = [], 0
                for name, content in _members(paths[k]):
                    if name.lower().endswith(ending):
                        held.append((Path(paths[k]).name, name, content.decode("utf-8-sig", "replace")))
                        size += len(content)
                    if size >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], ["archive", "name", "text"])
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], ["archive", "name", "text"])

    return spark.range(0, len(paths), 1, max(1, len(paths))).mapInArrow(run, "archive string, name string, text string")
