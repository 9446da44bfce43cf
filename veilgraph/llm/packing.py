"""Best-fit packing of documents into sequences of a fixed number of tokens, by exact complements.

Lengths of pieces are at most the sequence's, so a count for each length, a table of 2,048 rows however many documents there are,
says all that packing needs. From the longest on, a length's gap is looked up among single lengths, sums of two and sums of three that are still in stock, and as
many sequences are filled exactly as the stock allows; what has no complement goes best-fit, longest first. The plan is a list of
patterns, lengths and how often, and every piece finds its place in it by its rank among the pieces of its length: ranks come from counts of hash
buckets, so that no task meets all pieces of a length.

Texts fall apart where white space follows other characters, or a sign a letter, which no token crosses. Tasks encode distinct parts once and put ids together from them.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import words as W
from .common import bounded_batches, materialise, tidy

DEFAULT_FILE = "byte_bpe_50k.json"
#: Parts that a task remembers, the longest of them in bytes, and parts looked up at once.
REMEMBERED, LONGEST, AT_ONCE = 500_000, 64, 1 << 19
#: Bytes of text encoded at once, whole documents each.
TEXT_BYTES = 3 << 20
#: Pieces of one length and hash bucket that are ranked together, about.
RANKED = 2_000
BLANK = W._byte_table(b" \t\n\x0b\x0c\r")
PLAIN = W._byte_table(bytes(range(0x21, 0x7F)))
LETTER = W._byte_table(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]))
SIGN = PLAIN & ~LETTER & ~W._byte_table(b"0123456789")


def tokenizer_file(name: str = DEFAULT_FILE) -> str:
    """Where the installed file of that name is; a path stays one."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts, equal to the tokenizer's: it must split before white space that follows another character and between letters and signs, as byte-level BPE with its usual pattern does."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(file)
        self.encode = tokenizer.encode_batch_fast
        # special tokens' strings stay whole, as the tokenizer knows them in texts
        self.sign = SIGN & ~W._byte_table("".join(t.content for t in tokenizer.get_added_tokens_decoder().values()).encode())
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.sizes, self.used = np.zeros(1 << 20, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def _slots(self, parts: list[str]) -> np.ndarray:
        """Where the ids of each part are."""
        if len(self.known) + len(parts) > REMEMBERED:
            self._forget()
        known = self.known
        new = [p for p in parts if p not in known]
        if new:
            found = [e.ids for e in self.encode(new, add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(found), np.uint32)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            n, slot = self.used + len(ids), len(known)
            self.ids, self.starts, self.sizes = self._room(self.ids, n), self._room(self.starts, slot + len(new)), self._room(self.sizes, slot + len(new))
            self.ids[self.used : n] = ids
            self.starts[slot : slot + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.sizes[slot : slot + len(new)] = sizes
            self.used = n
            known.update(zip(new, range(slot, slot + len(new))))
        return np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each text data[offsets[k]:offsets[k + 1]], in order."""
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            # after ASCII, or a letter of two bytes but for those from U+0080 on that begin with 0xC2, some of which are blanks
            other = PLAIN[data[:-1]]
            other[1:] |= (data[1:-1] >= 0x80) & (data[1:-1] < 0xC0) & (data[:-2] >= 0xC3) & (data[:-2] < 0xE0)
            cut[1:-1] = (BLANK[data[1:]] & other) | (LETTER[data[:-1]] & self.sign[data[1:]])
        cut[offsets] = True
        bounds = np.flatnonzero(cut)
        firsts = np.searchsorted(bounds, offsets)  # text k has parts firsts[k]:firsts[k + 1]
        held: list[np.ndarray] = []
        k = 0
        for at in range(0, len(bounds) - 1, AT_ONCE):
            stop = min(at + AT_ONCE, len(bounds) - 1)
            part = bounds[at : stop + 1]
            ids, before = self._ids(data[part[0] : part[-1]], part - part[0])
            while firsts[k + 1] <= stop:  # texts that end here
                a, b = before[max(firsts[k] - at, 0)], before[firsts[k + 1] - at]
                yield np.concatenate([*held, ids[a:b]]) if held else ids[a:b]
                held, k = [], k + 1
                if k == len(offsets) - 1:
                    return
            held.append(ids[before[max(firsts[k] - at, 0)] :])
        for _ in range(k, len(offsets) - 1):
            yield np.zeros(0, np.uint32)

    def _ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, and how many come before each."""
        encoded = W.strings(data, bounds).dictionary_encode()
        parts, index = encoded.dictionary.to_pylist(), encoded.indices.to_numpy()
        long = [i for i, p in enumerate(parts) if len(p) > LONGEST]
        own = {i: np.array(self.encode([parts[i]], add_special_tokens=False)[0].ids, np.uint32) for i in long}
        for i in long:
            parts[i] = ""
        slots = self._slots(parts)
        starts, sizes, ids = self.starts[slots], self.sizes[slots], self.ids
        if own:
            sizes[long] = [len(own[i]) for i in long]
            starts[long] = self.used + np.concatenate([[0], np.cumsum(sizes[long])[:-1]])
            ids = np.concatenate([ids[: self.used], *own.values()])
        sizes, starts = sizes[index], starts[index]
        before = np.concatenate([[0], np.cumsum(sizes)])
        return ids[np.repeat(starts - before[:-1], sizes) + np.arange(before[-1])], before


@lru_cache(maxsize=1)
def encoder_of(file: str) -> Encoder:
    """One for all tasks of a Python worker, with what it remembers."""
    return Encoder(file)


class Pattern(NamedTuple):
    lengths: tuple[int, ...]
    times: int


class Sums:
    """Which sums of one, two or three lengths in stock there are: an index that follows the stock."""

    def __init__(self, stock: list[int]):
        self.stock = stock
        self.singles = sum(1 << x for x in range(1, len(stock)) if stock[x])
        self._index()

    def _index(self) -> None:
        lengths = [x for x in range(1, len(self.stock)) if self.singles >> x & 1]
        every = (1 << len(self.stock)) - 1
        self.pairs = self.triples = 0
        for x in lengths:
            self.pairs |= self.singles << x & every
        for x in lengths:
            self.triples |= self.pairs << x & every
        self.fresh = True

    def take(self, need: Counter, times: int) -> None:
        for x, n in need.items():
            self.stock[x] -= n * times
            if not self.stock[x]:
                self.singles &= ~(1 << x)
                self.fresh = False

    def of(self, total: int) -> Iterator[tuple[int, ...]]:
        """One, two or three lengths in stock with this sum, the largest first."""
        if not self.fresh:
            self._index()
        one, two = self.singles, self.pairs
        if one >> total & 1:
            yield (total,)
        if two >> total & 1:
            for a in range(total - 1, (total - 1) // 2, -1):
                if one >> a & 1 and one >> (total - a) & 1:
                    yield a, total - a
        if self.triples >> total & 1:
            for a in range(total - 2, (total - 1) // 3, -1):
                if one >> a & 1 and two >> (total - a) & 1:
                    for b in range(min(a, total - a - 1), (total - a - 1) // 2, -1):
                        if one >> b & 1 and one >> (total - a - b) & 1:
                            yield a, b, total - a - b

    def highest(self, most: int) -> int:
        """The highest sum up to `most`, or 0."""
        if not self.fresh:
            self._index()
        return ((self.singles | self.pairs | self.triples) & ((2 << most) - 1) & ~1).bit_length() - 1 if most > 0 else 0


def exact(stock: list[int], size: int) -> list[Pattern]:
    """Patterns of up to four lengths that fill a sequence exactly; stock[l], the pieces of length l, goes down by what they take."""
    sums, out = Sums(stock), []
    for length in range(size, 0, -1):
        while stock[length]:
            for rest in sums.of(size - length) if length < size else [()]:
                need = Counter((length, *rest))
                times = min(stock[x] // n for x, n in need.items())
                if times:
                    break
            else:
                break
            out.append(Pattern((length, *rest), times))
            sums.take(need, times)
    return out


def fullest(stock: list[int], size: int) -> list[Pattern]:
    """All of stock, each sequence begun with the longest piece and filled by the highest sums that fit."""
    sums, out = Sums(stock), []
    for length in range(size, 0, -1):
        while stock[length]:
            need, room = Counter((length,)), size - length
            total = sums.highest(room)
            while total > 0:
                for rest in sums.of(total):
                    more = need + Counter(rest)
                    if all(stock[x] >= n for x, n in more.items()):
                        need, room = more, room - total
                        total = room + 1
                        break
                total = sums.highest(min(total - 1, room))
            times = min(stock[x] // n for x, n in need.items())
            out.append(Pattern(tuple(sorted(need.elements(), reverse=True)), times))
            sums.take(need, times)
    return out


def best_fit(stock: list[int], size: int) -> list[Pattern]:
    """All of stock, longest first, each piece into the fullest sequence that has room for it."""
    open_: dict[int, list[Pattern]] = {}  # by room left
    for length in range(size, 0, -1):
        left = stock[length]
        while left:
            room = next((g for g in range(length, size) if open_.get(g)), None)
            if room is None:
                each = size // length
                for n, times in ((each, left // each), (left % each, 1)):
                    if n and times:
                        open_.setdefault(size - n * length, []).append(Pattern((length,) * n, times))
                break
            lengths, times = open_[room].pop()
            used = min(left, times)
            if used < times:
                open_[room].append(Pattern(lengths, times - used))
            open_.setdefault(room - length, []).append(Pattern((*lengths, length), used))
            left -= used
    return [p for parts in open_.values() for p in parts]


def plan(counts: dict[int, int], size: int) -> list[Pattern]:
    """Patterns that hold counts[l] pieces of each length l, in as few sequences as found: exact complements, and for the rest best fit or the highest sums, or either alone where that is better."""
    stock = [counts.get(x, 0) for x in range(size + 1)]
    first = exact(rest := list(stock), size)
    found = [first + best_fit(rest, size), first + fullest(list(rest), size), best_fit(stock, size)]
    least = -(-sum(x * n for x, n in enumerate(stock)) // size)
    if min(sum(p.times for p in patterns) for patterns in found) > least:
        found.append(fullest(list(stock), size))
    return min(found, key=lambda patterns: sum(p.times for p in patterns))


def slots_of(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For runs of equal lengths in patterns: which ranks of the length stand there, how many in each sequence, from which sequence and offset on; by length and rank."""
    next_rank: Counter = Counter()
    sequence, rows = 0, []
    for lengths, times in patterns:
        offset = 0
        for length, each in Counter(lengths).items():  # equal ones stand together
            rows.append((length, next_rank[length], each, sequence, offset))
            next_rank[length] += each * times
            offset += each * length
        sequence += times
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "offset"), columns.T, strict=True))


def pieces(docs: DataFrame, size: int, file: str, key: str, text: str, end: int | None, keep_ids: bool) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of each document's tokens, with ids if asked for."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("piece", T.IntegerType()), *[T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32")]])
    if keep_ids:
        schema.add("ids", T.ArrayType(T.IntegerType(), False))
    tail = np.array([] if end is None else [end], "<u4")

    def run(batches):
        encoder = encoder_of(tokenizer_file(file))
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(text))
            row, n = 0, len(offsets) - 1
            while row < n:
                stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + TEXT_BYTES, side="right")) - 1)
                doc, places, starts, sums, ids = [], [], [], [], []
                part = data[offsets[row] : offsets[stop]]
                for k, found in enumerate(encoder.texts(part, offsets[row : stop + 1] - offsets[row])):
                    all_ids = np.concatenate([found.astype("<u4"), tail])
                    first = len(all_ids) % size or min(len(all_ids), size)
                    cuts = [0, *range(first, len(all_ids) + 1, size)]
                    for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        if a == b:
                            continue
                        doc.append(row + k)
                        places.append(p)
                        starts.append((a, b - a))
                        sums.append(zlib.crc32(all_ids[a:b].tobytes()))
                        if keep_ids:
                            ids.append(all_ids[a:b].astype(np.int32))
                at = np.array(starts, np.int64).reshape(-1, 2)
                columns = [batch.column(key).take(pa.array(doc, pa.int64())), pa.array(places, pa.int32()), pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(sums, pa.int64())]
                if keep_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())
                row = stop

    return bounded_batches(docs.select(key, text)).mapInArrow(tidy(run), schema)


def pack(docs: DataFrame, size: int = 2048, file: str = DEFAULT_FILE, end: int | None = 0, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32, sequence_id, offset): where the tokens of each document stand, in sequences of `size` tokens at most; with `keep_ids` also the ids.

    A document is its text's ids and then `end`, if that isn't None. One that is longer than a sequence is cut so that all pieces but the first are full. Sequences and the places
    in them are numbered from 0, without gaps; ids_crc32 is that of the ids as little-endian 32-bit numbers.

    Null and empty texts are just `end` (no piece without it); texts of any length are encoded whole; documents of one length stand in the order of a hash,
    so reruns agree, but for rows equal in key and text, whose places are interchangeable; null and repeated keys are ordinary;
    an empty table gives no rows; other columns, whatever their names, play no part.
    """
    rows = materialise(pieces(docs, size, file, key, text, end, keep_ids))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `size` rows at most
    patterns = plan(counts, size)
    # a length's pieces fall into as many buckets as there are many of them
    buckets = F.element_at(F.array(*[F.lit(-(-counts.get(x, 1) // RANKED)) for x in range(1, size + 1)]), F.col("_length").cast("int"))
    kept = [F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in rows.columns if c != key]]
    rows = rows.select(*kept).withColumn("_hash", F.xxhash64("_key", "_piece", "_ids_crc32")).withColumn("_bucket", F.pmod("_hash", buckets))
    sums = rows.groupBy("_length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_length", "_bucket").orderBy("_hash", "_key", "_piece", "_ids_crc32")
    rows = rows.withColumn("_rank", F.row_number().over(within)).join(sums, ["_length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before") - 1)
    rows = rows.select("_key", "_piece", "_start", "_length", "_ids_crc32", *(["_ids"] if keep_ids else []), F.lit(0).cast("long").alias("_sequence_id"), F.col("_rank").cast("long").alias("_offset"))
    slots = docs.sparkSession.sparkContext.broadcast(slots_of(patterns))  # grows with `size`, not with the data

    def place(batches):
        table = slots.value
        firsts = table["length"] << 44 | table["first"]
        for batch in batches:
            length, rank = batch.column("_length").to_numpy(), batch.column("_offset").to_numpy()
            at = np.searchsorted(firsts, length << 44 | rank, side="right") - 1
            nth = rank - table["first"][at]
            sequence = table["sequence"][at] + nth // table["each"][at]
            offset = table["offset"][at] + nth % table["each"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sequence), pa.array(offset)], batch.schema.names)

    return rows.mapInArrow(tidy(place), rows.schema).select(F.col("_key").alias(key), *[F.col(c).alias(c[1:]) for c in rows.columns[1:]])
