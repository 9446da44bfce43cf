"""Files and folders of any file system that Spark's Hadoop reaches: HDFS, object stores, mounted and local paths.

The driver lists, names, renames and writes small files; whatever holds data is read and written by Spark's own sources and sinks,
in tasks, which need no mount. A path without a scheme is one of the default file system.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import NamedTuple
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRIVATE_FOLDER, PRIVATE_FILE = 0o700, 0o600


class Entry(NamedTuple):
    """What a listing tells of a file."""

    path: str
    size: int


class Place:
    """A file or folder. str() is a plain path where the file system is this machine's, else a URI."""

    def __init__(self, spark: SparkSession, path):
        self.spark, self._jvm = spark, spark.sparkContext._jvm
        text = path.uri if isinstance(path, Place) else os.fspath(path)
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        if not urlsplit(text).scheme and self._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(hadoop).getScheme() == "file":
            text = os.path.abspath(text)
        found = self._jvm.org.apache.hadoop.fs.Path(text)
        system = found.getFileSystem(hadoop)
        self._path = system.makeQualified(found)
        self.scheme = self._path.toUri().getScheme()
        # local writing leaves no checksum files beside what is written
        self._system = system.getRaw() if self._is(system, "org.apache.hadoop.fs.LocalFileSystem") else system

    def _is(self, thing, kind: str) -> bool:
        return self._jvm.java.lang.Class.forName(kind).isInstance(thing)

    @property
    def uri(self) -> str:
        return self._path.toString()

    @property
    def local(self) -> Path | None:
        return Path(self._path.toUri().getPath()) if self.scheme == "file" else None

    @property
    def name(self) -> str:
        return self._path.getName()

    @property
    def parent(self) -> Place:
        return Place(self.spark, self._path.getParent().toString())

    def __str__(self) -> str:
        return str(self.local) if self.local else self.uri

    def __truediv__(self, name: str) -> Place:
        return Place(self.spark, f"{self.uri.rstrip('/')}/{name}")

    def within(self, other: Place) -> bool:
        """Is this the other, or below it?"""
        return f"{self.uri.rstrip('/')}/".startswith(f"{other.uri.rstrip('/')}/")

    def _status(self):
        """As it stands, links of this machine followed; None if there is nothing."""
        try:
            return self._system.getFileStatus(self._path) if self.local else self._system.getFileLinkStatus(self._path)
        except Exception as error:
            java = getattr(error, "java_exception", None)
            if java is not None and self._is(java, "java.io.FileNotFoundException"):
                return None
            raise

    def exists(self) -> bool:
        return self.is_link() or self._status() is not None

    def is_link(self) -> bool:
        if self.local:
            return self.local.is_symlink()
        status = self._status()
        return status is not None and status.isSymlink()

    def is_folder(self) -> bool:
        status = self._status()
        return status is not None and status.isDirectory()

    def resolved(self) -> Place:
        """Without links in the folders above, where there can be any."""
        return Place(self.spark, os.path.realpath(self.local)) if self.local else self

    def walk(self) -> Iterator[tuple[str, int, bool]]:
        """(path as str() gives it, bytes, is a link) of all files and links below, folder by folder."""
        folders = [self._path]
        while folders:
            for status in self._system.listStatus(folders.pop()):
                path = status.getPath()
                name = path.toUri().getPath() if self.local else path.toString()
                link = os.path.islink(name) if self.local else status.isSymlink()
                if status.isDirectory() and not link:
                    folders.append(path)
                else:
                    yield name, status.getLen(), link

    def stamp(self) -> int:
        """What changes with names, sizes and times of the files below."""
        folders, found = [self._path], []
        while folders:
            for status in self._system.listStatus(folders.pop()):
                if status.isDirectory():
                    folders.append(status.getPath())
                else:
                    found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
        return hash(tuple(sorted(found)))

    def size(self) -> int:
        return self._system.getFileStatus(self._path).getLen()

    def make_folder(self) -> Place:
        """A folder that nobody but its owner looks into, and those above it that aren't there."""
        if self.local:
            for folder in [self.local, *self.local.parents][::-1]:
                folder.mkdir(mode=PRIVATE_FOLDER, exist_ok=True)
            self.local.chmod(PRIVATE_FOLDER)
        else:
            permission = self._jvm.org.apache.hadoop.fs.permission.FsPermission(oct(PRIVATE_FOLDER)[2:])
            self._system.mkdirs(self._path, permission)
            self._system.setPermission(self._path, permission)
        return self

    def lock(self) -> None:
        """Take all rights of others to what is below; elsewhere than on this machine a private folder above does it."""
        for place, _, names in os.walk(self.local) if self.local else ():
            os.chmod(place, PRIVATE_FOLDER)
            for name in names:
                os.chmod(os.path.join(place, name), PRIVATE_FILE)

    def write_text(self, text: str) -> None:
        """A new private file."""
        self.write_bytes(text.encode())

    def write_bytes(self, data: bytes) -> None:
        out = self._system.create(self._path, False)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        if self.local:
            self.local.chmod(PRIVATE_FILE)

    def read_text(self) -> str:
        stream = self._system.open(self._path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace_text(self, text: str) -> None:
        """The file gets a whole new content at once."""
        new = self.parent / f".{self.name}.partial"
        new.delete()
        new.write_text(text)
        new.rename(self, over=True)

    def rename(self, to: Place, over: bool = False) -> None:
        if over and to.scheme != "file":  # others don't rename onto what is there
            to.delete()
        if not self._system.rename(self._path, to._path):
            raise OSError(f"{self.name} could not be renamed")

    def delete(self) -> None:
        self._system.delete(self._path, True)


def same_file(uri: str) -> tuple[str, str, str]:
    """What all spellings of a file's URI have in common."""
    parts = urlsplit(uri)
    return parts.scheme or "file", parts.netloc, unquote(parts.path)


def file_of(path: str) -> tuple[str, str, str]:
    """The same for a path as str() of a place gives it, where nothing is spelt otherwise."""
    found = re.fullmatch(r"([A-Za-z][\w+.-]*)://([^/]*)(/.*)", path)
    return found.groups() if found else ("file", "", path.removeprefix("file:"))


def escaped(path: str) -> str:
    """A path for Spark's readers, which else take some characters for patterns."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def reading(spark: SparkSession, most: int, cost: int = 0) -> SparkSession:
    """A session like `spark` whose readers make parts of `most` bytes, a file counting `cost` more; one that costs as much as a part has one of its own.

    How a file is cut must follow from `most` alone, so that line numbers can be counted part by part.
    """
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for name, value in (("maxPartitionBytes", most), ("openCostInBytes", cost), ("minPartitionNum", 1)):
        own.conf.set(f"spark.sql.files.{name}", str(value))
    return own


def of_session(spark: SparkSession, df: DataFrame, schema: str) -> DataFrame:
    """df as a frame of `spark`, whatever session read it."""
    return spark.createDataFrame([], schema).unionByName(df)


def lines(session: SparkSession, paths: list[str], **options) -> DataFrame:
    """(line as bytes, file, begin) of text files; begin is the first byte of the part of the file that a line was read in."""
    found = session.read.options(**options).text([escaped(p) for p in paths])
    return found.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))


def side_by_side(jobs) -> list:
    """What small calls to a file system return."""
    with ThreadPoolExecutor(8) as pool:
        return [x.result() for x in [pool.submit(job) for job in jobs]]
