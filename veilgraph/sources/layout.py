"""The sink: roots written back into files laid out and named as the source files."""

from __future__ import annotations

import gzip
import json
import os
import re
import shutil
import uuid
import zlib
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError, PerturbationError
from ..functions.columns import listed
from .files import Place, file_of, lines, reading, same_file, side_by_side

#: Lines of a file that its task hands on at once; bytes that no file has, so that none is cut.
LINES, UNCUT = 1000, 1 << 50
#: Numbers of roots that a task writes: a larger file, of a mounted file system, is put together from several tasks' parts.
ROOTS = 100_000
NOTHING = sha256().hexdigest()


def plan(sources: list[tuple[int, str]], population: dict[int, tuple[int, str]]) -> list[dict]:
    """What file each source becomes; population has (records, smallest locator) by source id."""
    if not sources:
        raise InputError("The index names no files to write.")
    try:
        base = os.path.commonpath([p.rpartition("/")[0] or "/" for _, p in sources])
    except ValueError:
        raise InputError("The source files lie in several file systems; name those of one.") from None
    plans, taken = [], set()
    for source, path in sources:
        original = os.path.relpath(os.path.normpath(path), base)
        packed = original.lower().endswith(".gz")
        stem = original[: -3 if packed else None]
        records, locator = population.get(source, (0, None))
        json_file = stem.lower().endswith(".json")
        single = json_file and records == 1 and locator == "$"
        name = original if single or not json_file else stem[:-5] + ".ndjson" + ".gz" * packed
        if name.casefold() in taken:
            raise InputError("Two source files would be written under one name; rename one.")
        taken.add(name.casefold())
        plans.append({"source_id": source, "source_file": original, "file": name, "records": records, "compressed": packed, "format": "json" if single else "ndjson", "bundle_unpacked": json_file and not single})
    return plans


def write(roots: DataFrame, plans: list[dict], folder: Place) -> list[dict]:
    """Write (source_id, root_id, line) rows, a task per file or part of `ROOTS` numbers, streaming in root order; the manifest in file order.

    Spark's text sink writes, so any file system will do, and its commit protocol holds: each attempt of a task has a file of its
    own, the one attempt that is told to commit counts, and what others leave goes with the staging folder. Files then get their names,
    and are read back by Spark: each must be what the task that wrote it says it sent. Headers of gzip are fixed, so reruns agree byte by byte.
    Parts of a file are sorted and compressed by tasks of their own; one more task joins their bytes, which costs little, and reads them back.
    A compressed file's parts are members that tell of their size, so `exports.scan` reads them side by side. Elsewhere than on a mounted file system each file has one task.
    The driver holds a row a file, the plan and the manifest: fine for a million of files.
    """
    spark = roots.sparkSession
    folder.make_folder()
    places = {p["source_id"]: folder / p["file"] for p in plans}
    for parent in sorted({q.parent.uri for q in places.values()} - {folder.uri}):
        Place(spark, parent).make_folder()
    told: dict[int, tuple[int, str, str]] = {}
    for packed in (False, True):
        own = {p["source_id"]: p for p in plans if p["compressed"] == packed}
        if any(p["records"] for p in own.values()):
            told |= _commit(roots, own, packed, places, folder)
        for source, entry in own.items():
            if source not in told:
                places[source].write_bytes(gzip.compress(b"", mtime=0) if packed else b"")
                told[source] = (0, NOTHING, NOTHING)
    manifest = []
    read = _read_files(spark, {i: str(q) for i, q in places.items() if told[i][2] is not None})
    for entry in plans:
        records, digest, as_read = told[entry["source_id"]]
        if records != entry["records"]:
            raise PerturbationError("A file did not get the resources planned for it.")
        if as_read is not None and read.get(entry["source_id"], (0, NOTHING)) != (records, as_read):
            raise PerturbationError("A written file, read back, is not what was sent to it.")
        manifest.append({k: v for k, v in entry.items() if k != "source_id"} | {"uncompressed_sha256": digest})
    folder.lock()
    return manifest


def _parts(roots: DataFrame, own: dict[int, dict], folder: Place) -> list[tuple[int, int | None, int]]:
    """(source, chunk, number) of the parts that tasks write, a row a part; the chunk is None where a file has one part. What is cut where follows from the numbers of roots alone."""
    large = [i for i, entry in own.items() if folder.local and entry["records"] > ROOTS]
    cut = []
    if large:
        chunks = roots.filter(F.col("source_id").isin(large)).groupBy("source_id", F.floor(F.col("root_id") / ROOTS).alias("chunk")).count()
        cut = sorted((r["source_id"], r["chunk"]) for r in chunks.select("source_id", "chunk").collect())
    return [(source, chunk, i) for i, (source, chunk) in enumerate([*((i, None) for i in sorted(own) if i not in large), *cut])]


def _commit(roots: DataFrame, own: dict[int, dict], packed: bool, places: dict[int, Place], folder: Place) -> dict[int, tuple[int, str, str | None]]:
    """Write and name the files of `own`; for each (records, digest, digest without a first byte order mark, which readers leave out; None: it was read back already)."""
    spark = roots.sparkSession
    planned = _parts(roots, own, folder)

    def stream(batches):
        current, sums, records = None, None, 0

        def ended():
            return json.dumps([current, records, sums[0].hexdigest(), sums[1].hexdigest()])

        held: list[str] = []
        for batch in batches:
            for source, line in zip(listed(batch.column(0)), listed(batch.column(1)), strict=True):
                if source != current:
                    current, records, sums = source, 0, (sha256(), sha256())
                records += 1
                for nth, digest in enumerate(sums):
                    digest.update((line.removeprefix("\ufeff") if nth and records == 1 else line).encode() + b"\n")
                held.append(line)
                if len(held) >= LINES:  # the last line of a file tells of it: one is held back
                    yield _batch(held[:-1])
                    held = held[-1:]
        if held:
            yield _batch(held, ended())

    # parts are numbered through, so each has a task of its own, and the part of its number is its file
    chosen = F.broadcast(spark.createDataFrame(planned, "wanted int, chunk long, part int"))
    within = F.col("chunk").isNull() | (F.col("chunk") == F.floor(F.col("root_id") / ROOTS))
    dealt = roots.select("source_id", "root_id", "line").join(chosen, (F.col("source_id") == F.col("wanted")) & within).repartitionById(len(planned), F.col("part"))
    ordered = dealt.sortWithinPartitions("root_id").select("part", "line")
    staging, seen = folder.parent / f".{folder.name}.staging", Observation()
    staging.make_folder()
    lines = ordered.mapInArrow(stream, "line string, told string").observe(seen, F.collect_list("told").alias("files"))
    lines.select("line").write.option("maxRecordsPerFile", 0).option("lineSep", "\n").text((staging / "parts").uri, compression="gzip" if packed else "none")
    found = {source: tuple(rest) for source, *rest in map(json.loads, seen.get["files"])}
    parts = {int(m[1]): path for path, _, _ in (staging / "parts").walk() if (m := re.search(r"/part-(\d+)-[^/]*$", path))}
    whole = {number: source for source, chunk, number in planned if chunk is None}
    side_by_side([lambda i=i: Place(spark, parts[i]).rename(places[whole[i]]) for i in found if i in whole])
    done = {whole[i]: rest for i, rest in found.items() if i in whole}
    pieces: dict[int, list] = {}
    for source, chunk, number in planned:
        if chunk is not None:
            pieces.setdefault(source, []).append((Place(spark, parts[number]).local.as_posix(), *found[number][:2]))
    if pieces:
        done |= _join(spark, pieces, packed, places, staging)
    staging.delete()
    return done


#: What stands before a member of gzip that tells of its size: no time, an extra field VG of 8 bytes.
MEMBER = b"\x1f\x8b\x08\x04\0\0\0\0\0\0\x0c\0VG\x08\0"
CHUNK = 1 << 20


def _join(spark: SparkSession, pieces: dict[int, list[tuple[str, int, str]]], packed: bool, places: dict[int, Place], staging: Place) -> dict[int, tuple[int, str, None]]:
    """Put the bytes of parts (path, records, digest) together, a task per file; what stands in the file is read back and compared with what was sent, part by part.

    Attempts of a task write files of their own, of which one is named.
    """
    rows = [(i, part, nth, *piece) for i, (part, of) in enumerate(pieces.items()) for nth, piece in enumerate(of)]
    df = spark.createDataFrame(rows, "task int, source_id int, nth int, path string, records long, digest string").repartitionById(len(pieces), F.col("task")).sortWithinPartitions("nth")
    target = staging.local.as_posix()

    def join(batches):
        rows = [r for batch in batches for r in batch.to_pylist()]
        if not rows:
            return
        source, out = rows[0]["source_id"], f"{target}/joined-{rows[0]['source_id']}-{uuid.uuid4().hex}"
        sizes = []
        with open(out, "xb") as sink:
            os.chmod(out, 0o600)
            for row in rows:
                begin = sink.tell()
                with open(row["path"], "rb") as part:
                    if packed:
                        head = part.read(10)
                        if head[:4] != MEMBER[:3] + b"\0":
                            raise PerturbationError("A part of a compressed file is none that was written here.")
                        sink.write(MEMBER + (os.path.getsize(row["path"]) + len(MEMBER) + 8 - 10).to_bytes(8, "little"))
                    shutil.copyfileobj(part, sink, CHUNK)
                sizes.append(sink.tell() - begin)
        total, records = sha256(), 0
        with open(out, "rb") as back:
            for row, size in zip(rows, sizes):
                digest, left, n = sha256(), size, 0
                undo = zlib.decompressobj(31) if packed else None
                while left:
                    raw = back.read(min(CHUNK, left))
                    if not raw:
                        break
                    left -= len(raw)
                    text = undo.decompress(raw) if packed else raw
                    n += text.count(b"\n")
                    digest.update(text)
                    total.update(text)
                if left or (packed and (not undo.eof or undo.unused_data)) or (n, digest.hexdigest()) != (row["records"], row["digest"]):
                    raise PerturbationError("A written file, read back, is not what was sent to it.")
                records += n
        yield pa.RecordBatch.from_arrays([pa.array([source], pa.int32()), pa.array([out]), pa.array([records], pa.int64()), pa.array([total.hexdigest()])], ["source_id", "path", "records", "digest"])

    done = {}
    for r in df.mapInArrow(join, "source_id int, path string, records long, digest string").collect():
        Place(spark, r["path"]).rename(places[r["source_id"]])
        done[r["source_id"]] = r["records"], r["digest"], None
    return done


def _batch(lines: list[str], told: str | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([None] * (len(lines) - 1) + [told], pa.string())], ["line", "told"])


def _read_files(spark: SparkSession, files: dict[int, str]) -> dict[int, tuple[int, str]]:
    """(lines, digest) of each file that has any, a task per file."""
    names = spark.sparkContext.broadcast({file_of(path): i for i, path in files.items()})

    def digest(batches):
        file, sums, records, done = None, None, 0, []
        for batch in batches:
            for line, its in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if its != file:
                    if file is not None:
                        done.append((names.value[same_file(file)], records, sums.hexdigest()))
                    file, sums, records = its, sha256(), 0
                sums.update(line + b"\n")
                records += 1
        if file is not None:
            done.append((names.value[same_file(file)], records, sums.hexdigest()))
        if done:
            columns = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(next(columns), pa.int32()), pa.array(next(columns), pa.int64()), pa.array(next(columns))], ["source_id", "records", "digest"])

    found = whole_files(spark, list(files.values())).mapInArrow(digest, "source_id int, records long, digest string").collect()
    return {r["source_id"]: (r["records"], r["digest"]) for r in found}


def whole_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(line, file, begin) of files of which none is cut."""
    return lines(reading(spark, UNCUT, UNCUT), paths, lineSep="\n")


def read_back(folder: Place, manifest: list[dict]):
    """The lines of all files, in manifest order."""
    for entry in manifest:
        for row in whole_files(folder.spark, [str(folder / entry["file"])]).toLocalIterator():
            yield row["line"].decode() + "\n"


def population(occurrences: DataFrame, resources: DataFrame) -> DataFrame:
    """(resource_id, source_id, locator): where each root first occurs."""
    firsts = occurrences.groupBy("resource_id").agg(F.min_by(F.struct("source_id", "locator"), "id").alias("o"))
    roots = resources.filter("NOT contained").select("id")
    return firsts.join(roots, F.col("resource_id") == F.col("id"), "left_semi").select("resource_id", "o.source_id", "o.locator")
