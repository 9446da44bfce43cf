"""Intermediate tables in the folder that driver and executors share: private, and deleted when they are done with."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, suppress
from contextvars import ContextVar, copy_context
from pathlib import Path
from urllib.parse import unquote, urlsplit

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Folders of tables not yet deleted: those that end with the process, and those of the scope that a thread is in.
_of_process: list[str] = []
_of_scope: ContextVar[list[str]] = ContextVar("scope", default=_of_process)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what spark.checkpoint.dir names. Where that is unset, a local session
    (tests) gets a folder of its own; on a cluster it is an error, because a
    machine's temporary folder is not seen by the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file:///tmp/checkpoints/veilgraph"
    return named.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def plain(path: str) -> Path | None:
    """The path as one of this machine's file system, or None if it is of another."""
    parts = urlsplit(path)
    return Path(unquote(parts.path)) if parts.scheme in ("", "file") else None


def private_folder(spark: SparkSession, path: str) -> None:
    """Make a folder that nobody but its owner can look into, whatever the files in it allow."""
    local = plain(path)
    if local is not None:  # without a process of its own for the rights, as Hadoop starts
        local.mkdir(mode=0o700, parents=True, exist_ok=True)
        return
    place, system = _hadoop(spark, path)
    system.mkdirs(place)
    system.setPermission(place, spark.sparkContext._jvm.org.apache.hadoop.fs.permission.FsPermission("700"))


def delete(spark: SparkSession | None, path: str) -> None:
    """Delete a folder; one of this machine's file system goes without Spark, too."""
    local = plain(path)
    if local is not None:
        shutil.rmtree(local, ignore_errors=True)
    elif spark is not None and spark.sparkContext._jsc is not None:
        place, system = _hadoop(spark, path)
        system.delete(place, True)


#: How tables are compressed: digests in hex, of which they are full, take half of what they take without entropy coding.
CODEC = "zstd"


def tidy(spark: SparkSession) -> SparkSession:
    """A session like `spark` whose queries delete their shuffle files at their end, and not when the driver happens to collect garbage: a run of many queries takes the room of its largest."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return own


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later steps start from there, on any executor.

    The table is deleted at the end of the innermost `scope`, or of the process.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/veilgraph-{uuid.uuid4().hex}"
    private_folder(spark, folder)
    _of_scope.get().append(folder)
    df.write.parquet(f"{folder}/table", compression=CODEC)
    return spark.read.schema(df.schema).parquet(f"{folder}/table")


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[Callable], object]]:
    """Tables that `materialise` writes within are deleted at the end; nothing that reads them may outlive it. Scopes of other threads are none of its business.

    Gives a function: the tables that a job called by it writes are of the scope outside, and stay.
    """
    own: list[str] = []
    outside = copy_context()
    outer = _of_scope.set(own)
    try:
        yield lambda job: outside.run(job)
    finally:
        _of_scope.reset(outer)
        for folder in own:
            with suppress(Exception):  # what stays takes room, no more
                delete(spark, folder)


@atexit.register
def _end() -> None:
    for folder in _of_process:
        with suppress(Exception):
            delete(SparkSession.getActiveSession() if plain(folder) is None else None, folder)


def parts(spark: SparkSession, rows: int, rows_per_task: int = 20_000) -> int:
    """In how many parts rows are dealt out for such work."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_task))


def spread(df: DataFrame, rows: int | None = None, rows_per_task: int = 20_000) -> DataFrame:
    """df dealt out for work that costs far more than moving its rows: over all cores at least, and so that no task has too many `rows`, where the number is known.

    Adaptive execution would put small rows together again, by their size.
    """
    if rows is None:
        cores = df.sparkSession.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
    return df.repartition(parts(df.sparkSession, rows, rows_per_task))


def together(spark: SparkSession, *jobs: Callable[[], object]) -> list:
    """What independent jobs return, which run side by side: small ones are mostly waiting."""
    with ThreadPoolExecutor(4) as pool:
        return [x.result() for x in [pool.submit(copy_context().run, inheritable_thread_target(spark)(job)) for job in jobs]]
