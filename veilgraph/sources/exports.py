"""Health-record exports as a table of JSON documents: .json, .ndjson, .jsonl, each optionally .gz."""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError
from ..functions.columns import listed
from .files import Entry, Place, escaped, file_of, lines, of_session, reading, same_file
from .layout import MEMBER

ENDINGS = tuple(f"{e}{z}" for e in (".json", ".ndjson", ".jsonl") for z in ("", ".gz"))
#: Characters of text in a batch; bytes that a task reads; bytes up to which a file goes to its task as one value.
BATCH, PART, WHOLE = 4 << 20, 64 << 20, 64 << 20
#: Bytes from which on a compressed file is looked into for members that tell of their size.
CUT = 1 << 20
DOCUMENTS = "source_id int, ordinal long, locator string, text string"


def is_export(path: str) -> bool:
    return path.lower().endswith(ENDINGS)


def discover(spark: SparkSession, inputs, output) -> tuple[list[Entry], Place]:
    """Sorted distinct source files, and the output folder, which must be new and outside the inputs."""
    target = Place(spark, output)
    if target.exists():
        raise InputError("There is something at the output's place already; name a new folder.")
    found: dict[str, int] = {}
    for given in [inputs] if isinstance(inputs, (str, bytes)) or hasattr(inputs, "__fspath__") else inputs:
        place = Place(spark, given)
        if place.is_link():
            raise InputError("An input is a symbolic link; name what it points to.")
        real = place.resolved()
        if real.is_folder():
            if target.resolved().within(real):
                raise InputError("The output may not lie in an input folder.")
            for path, size, link in real.walk():
                if link:
                    raise InputError("There is a symbolic link among the inputs; links are not followed.")
                if is_export(path):
                    found[path] = size
        elif real.exists() and is_export(real.name):
            found[str(real)] = real.size()
        else:
            raise InputError("An input is neither a folder nor a .json, .ndjson or .jsonl file, plain or .gz.")
    if not found:
        raise InputError("There are no .json, .ndjson or .jsonl files, plain or .gz, in the inputs.")
    if any(path.rsplit("/", 1)[-1].startswith(("_", ".")) for path in found):
        raise InputError("A source file's name begins with a dot or a low line, which Spark takes for no data; rename it.")
    return [Entry(path, found[path]) for path in sorted(found)], target


def normalize_base_url(value: str | None) -> str | None:
    """A server's base url without the final slash; None stays None."""
    if value is None:
        return None
    try:
        url = urlsplit(value)
        fine = url.scheme in ("http", "https") and url.hostname and not (url.username or url.password or url.query or url.fragment)
    except ValueError:
        fine = False
    if not fine or any(c.isspace() for c in value):
        raise InputError("The base url is http or https, with a host, and without user, query, fragment or blanks.")
    return value.rstrip("/")


def has_lines(path: str) -> bool:
    return path.lower().removesuffix(".gz").endswith((".ndjson", ".jsonl"))


def packed(path: str) -> bool:
    return path.lower().endswith(".gz")


def documents_of(path: str, content: bytes, number: int = 0) -> Iterator[tuple[int, str, str | None]]:
    """(ordinal, locator, text) of each document of a whole file, or of what follows its first `number` lines; a text of None stands for a file that broke off there."""
    try:
        raw = gzip.GzipFile(fileobj=io.BytesIO(content)) if packed(path) else io.BytesIO(content)
        if not has_lines(path):
            yield 1, "$", io.TextIOWrapper(raw, encoding="utf-8-sig").read()
            return
        for line in raw:
            # a return ends a line too, alone or before the feed
            for text in io.StringIO(line.decode("utf-8" if number else "utf-8-sig"), newline=None):
                number += 1
                if text.strip():
                    yield number, f"line:{number}", text
    except (OSError, EOFError, UnicodeError, zlib.error):
        yield number + 1, "", None


def scan(spark: SparkSession, files: list[Entry], part_bytes: int = PART) -> DataFrame:
    """(source_id, ordinal, locator, text), streamed in batches of bounded size. A null text marks a file that couldn't be read to its end.

    Spark's readers bring the bytes, so that files may be on any file system it reaches. Files of lines come as lines, large plain ones in parts of
    `part_bytes`, each by a task of its own; a first pass counts the lines of parts, so that every part knows its
    numbers, and nothing after a line that can't be read counts. Compressed files and single documents can't be split: they come whole, small
    ones packed together. Compressed files of lines beyond `WHOLE` are unpacked as a stream instead. Those that `layout` has put together from members, on a
    mounted file system, are read member by member, side by side.
    The driver plans a row a file and a row a part; texts never come near it.
    """
    ids = {path: i for i, (path, _) in enumerate(files, 1)}
    names = {file_of(path): i for path, i in ids.items()}
    cores = spark.sparkContext.defaultParallelism
    large, small, long, whole, joined = [], [], [], [], []
    for path, size in files:
        if has_lines(path) and packed(path) and size > CUT and (df := _members(spark, path, size, ids[path])) is not None:
            joined.append(df)
        elif has_lines(path):
            (large if size > part_bytes else small)[:0] = [] if packed(path) else [(path, size)]
            (long if size > WHOLE else whole).extend([(path, size)] if packed(path) else [])
        elif size:
            whole.append((path, size))
    # readers leave out empty files, which are documents that say nothing
    parts = [spark.createDataFrame([(ids[path], 1, "$", "") for path, size in files if not size and not has_lines(path)], DOCUMENTS), *joined]
    if large:
        df = lines(reading(spark, part_bytes), [p for p, _ in large])
        parts.append(_numbered(spark, df, names, _places(df, names)))
    if small:
        # parts no smaller than the largest file: none is cut
        most = max(max(size for _, size in small), min(part_bytes, sum(size for _, size in small) // cores), 1)
        parts.append(_numbered(spark, lines(reading(spark, most), [p for p, _ in small]), names))
    # what one task unpacks is dealt out for what follows, which costs more
    dealt = lambda df, size: df.repartition(max(cores, 8 * size // part_bytes), "source_id", "ordinal")
    for path, size in long:
        parts.append(dealt(_stream(spark, path, size, names), size))
    if whole:
        most = max(max(size for _, size in whole), min(part_bytes, sum(size for _, size in whole) // cores), 1)
        parts.append(dealt(_whole(spark, [p for p, _ in whole], most, ids, names), sum(size for _, size in whole)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def members(path: str, size: int) -> list[tuple[int, int]] | None:
    """(begin, bytes) of the members of a file of this machine's file system that `layout` has put together; None for any other."""
    scheme, _, local = file_of(path)
    out, at, head = [], 0, len(MEMBER)
    if scheme != "file":
        return None
    with open(local, "rb") as file:
        while at < size:
            file.seek(at)
            told = file.read(head + 8)
            if told[:head] != MEMBER or len(told) < head + 8:
                return None
            out.append((at, int.from_bytes(told[head:], "little")))
            at += max(out[-1][1], head + 8)
    return out if at == size and len(out) > 1 else None


def _members(spark: SparkSession, path: str, size: int, source: int) -> DataFrame | None:
    """Documents of a compressed file of lines by members, each by a task; a first pass counts their lines. None if it has no such members, or they are not whole lines that can be read."""
    found = members(path, size)
    if found is None:
        return None
    local = file_of(path)[2]

    def content(begin: int, n: int) -> bytes:
        with open(local, "rb") as file:
            file.seek(begin)
            return file.read(n)

    def count(batches):
        for batch in batches:
            for nth, begin, n in zip(*(c.to_pylist() for c in batch.columns)):
                lines, line = 0, b"\n"
                try:
                    for line in gzip.GzipFile(fileobj=io.BytesIO(content(begin, n))):
                        text = line.decode()
                        lines += 1 if "\r" not in text else sum(1 for _ in io.StringIO(text, newline=None))
                except (OSError, EOFError, UnicodeError, zlib.error):
                    line = b""
                yield pa.RecordBatch.from_arrays([pa.array([nth], pa.int32()), pa.array([lines], pa.int64()), pa.array([line.endswith(b"\n")])], ["nth", "lines", "fine"])

    dealt = lambda rows, schema: spark.createDataFrame(rows, schema).repartitionById(len(found), F.col("nth"))
    rows = [(nth, begin, n) for nth, (begin, n) in enumerate(found)]
    counted = sorted(dealt(rows, "nth int, begin long, bytes long").mapInArrow(count, "nth int, lines long, fine boolean").collect())
    if not all(r["fine"] for r in counted):
        return None
    before = [0]
    for r in counted:
        before.append(before[-1] + r["lines"])

    def run(batches):
        for batch in batches:
            for _, begin, n, number in zip(*(c.to_pylist() for c in batch.columns)):
                held, size = [], 0
                for row in documents_of(local, content(begin, n), number):
                    held.append((source, *row))
                    size += len(row[2] or "")
                    if size >= BATCH:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    return dealt([(*row, before[row[0]]) for row in rows], "nth int, begin long, bytes long, number long").mapInArrow(run, DOCUMENTS)


def _places(df: DataFrame, names: dict) -> dict[tuple[int, int], int]:
    """How many lines of its file come before each part; no entry for one behind a line that can't be read."""
    valid = F.is_valid_utf8(F.col("line").cast("string"))
    rows = df.groupBy("file", "begin").agg(F.count("*").alias("n"), F.count_if(~valid).alias("bad")).collect()
    out, at, broken = {}, {}, set()
    for source, begin, n, bad in sorted((names[same_file(r["file"])], r["begin"], r["n"], r["bad"]) for r in rows):
        if source not in broken:
            out[source, begin] = at.get(source, 0)
            at[source] = out[source, begin] + n
            if bad:
                broken.add(source)
    return out


def _numbered(spark: SparkSession, df: DataFrame, names: dict, before: dict | None = None) -> DataFrame:
    """Documents of lines (line, file, begin), which come part by part and in order. Without `before`, every file is one part."""
    shared = spark.sparkContext.broadcast((names, before))

    def run(batches):
        names, before = shared.value
        file = begin = source = number = None
        held, size = [], 0
        for batch in batches:
            for line, its, start in zip(*(listed(batch.column(i)) for i in range(3)), strict=True):
                if its != file or start != begin:
                    file, begin, source = its, start, names[same_file(its)]
                    number = 0 if before is None else before.get((source, begin))
                if number is None:  # behind what can't be read
                    continue
                number += 1
                try:
                    text = line.decode()
                except UnicodeDecodeError:
                    held.append((source, number, "", None))
                    number = None
                    continue
                if text.strip():
                    held.append((source, number, f"line:{number}", text))
                    size += len(text)
                    if size >= BATCH:
                        yield _batch(held)
                        held, size = [], 0
        if held:
            yield _batch(held)

    return of_session(spark, df.mapInArrow(run, DOCUMENTS), DOCUMENTS)


def _stream(spark: SparkSession, path: str, size: int, names: dict) -> DataFrame:
    """Documents of a compressed file of lines that is too large to go to its task as one value."""
    df = lines(reading(spark, size), [path])
    if _readable(df):
        return _numbered(spark, df, names)
    # what comes before the break, and a row for it
    df = lines(reading(spark, size), [path], ignoreCorruptFiles=True)
    source, n = names[file_of(path)], df.count()
    return _numbered(spark, df, names).unionByName(spark.createDataFrame([(source, n + 1, "", None)], DOCUMENTS))


def _readable(df: DataFrame) -> bool:
    try:
        df.count()
    except Exception as error:
        if "FAILED_READ_FILE" in str(error):
            return False
        raise
    return True


def _whole(spark: SparkSession, paths: list[str], most: int, ids: dict[str, int], names: dict) -> DataFrame:
    shared = spark.sparkContext.broadcast((names, {i: path for path, i in ids.items()}))
    df = reading(spark, most).read.format("binaryFile").load([escaped(p) for p in paths]).select("_metadata.file_path", "content")

    def run(batches):
        names, by_id = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                source = names[same_file(batch.column(0)[i].as_py())]
                held, size = [], 0
                for row in documents_of(by_id[source], batch.column(1)[i].as_py()):
                    held.append((source, *row))
                    size += len(row[2] or "")
                    if size >= BATCH:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    return of_session(spark, df.mapInArrow(run, DOCUMENTS), DOCUMENTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    source, ordinal, locator, text = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(source, pa.int32()), pa.array(ordinal, pa.int64()), pa.array(locator, pa.string()), pa.array(text, pa.string())], ["source_id", "ordinal", "locator", "text"])
