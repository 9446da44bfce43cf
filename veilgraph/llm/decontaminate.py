"""Benchmark decontamination with SimHash over item-sized windows.

A window of a document has as many words as a benchmark item and a SimHash
fingerprint of its word shingles.  A multi-index cuts fingerprints into blocks:
if two differ in at most `RADIUS` bits, they differ in at most
RADIUS // BLOCKS bits in one block, so looking up each block among the values that
close finds every item within the radius.  Candidates are verified by their exact
weighted shingle similarity (shingles weigh as often as they occur).

A window can only be similar to an item if it has a shingle of it, so just those
windows are fingerprinted.  That prunes nothing that verification would keep.

A document shorter than an item is one window, whole.  At a similarity of 0.8 the radius is
five standard deviations above the mean distance of fingerprints; a test states what it misses.

The benchmark goes to the tasks in slices whose indexes are of bounded size; a larger one takes more passes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import bounded_batches, tidy

BITS, BLOCKS, RADIUS = 64, 8, 24
#: Bytes of index sent to the tasks at once (about), and what an item and a character of it take.
SLICE_BYTES, ITEM_BYTES, CHAR_BYTES = 64 << 20, 4096, 16
_SIEVE = 1 << 21


def fingerprints(values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the `size` shingles from each of some places; ties of a bit's votes count as set."""
    at, place = np.unique(starts, return_inverse=True)
    if not len(at):
        return np.zeros(0, W.U64)
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    votes = 2 * (sums[at + size] - sums[at]) >= size
    return np.packbits(votes, axis=1, bitorder="little").view(W.U64).ravel()[place]


class Item(NamedTuple):
    id: object
    words: int
    width: int  # of a shingle
    weights: Counter
    fingerprint: int


class Index(NamedTuple):
    items: list[Item]
    tables: np.ndarray  # for each block and value, which items are that close in it
    shingles: np.ndarray  # sorted shingle hashes of all items
    owners: np.ndarray  # with the item of each
    sieve: np.ndarray  # by the low bits of a hash, whether a shingle has them


def build(rows: list[tuple[object, str]], width: int) -> Index:
    items, shingles, owners = [], [], []
    for key, text in rows:
        h = W.split(*W.text_bytes(pa.array([text], pa.large_string())), lower=True).hashes()
        if len(h):
            w = min(width, len(h))
            values = W.window_hashes(h, w)
            fingerprint = fingerprints(values, np.zeros(1, np.int64), len(values))[0]
            shingles.append(np.unique(values))
            owners.append(np.full(len(shingles[-1]), len(items)))
            items.append(Item(key, len(h), w, Counter(values.tolist()), int(fingerprint)))
    near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None]) <= RADIUS // BLOCKS
    own = np.array([i.fingerprint for i in items], W.U64).view(np.uint8).reshape(-1, BLOCKS)
    tables = np.stack([near[:, own[:, b]] for b in range(BLOCKS)])
    values, of = (np.concatenate([np.zeros(0, t), *x]) for t, x in ((W.U64, shingles), (np.int64, owners)))
    order = np.argsort(values, kind="stable")
    sieve = np.zeros(_SIEVE, bool)
    sieve[values & W.U64(_SIEVE - 1)] = True
    return Index(items, tables, values[order], of[order].astype(np.int64), sieve)


def _within_radius(index: Index, prints: np.ndarray, item: int) -> np.ndarray:
    """Which fingerprints the multi-index finds close to an item, then are."""
    parts = prints.view(np.uint8).reshape(-1, BLOCKS)
    found = np.zeros(len(prints), bool)
    for b in range(BLOCKS):
        found |= index.tables[b, parts[:, b], item]
    found[found] = np.bitwise_count(prints[found] ^ W.U64(index.items[item].fingerprint)) <= RADIUS
    return found


def _hits(words: W.Words, index: Index, similarity: Fraction) -> Iterator[tuple[int, int, int, int, float]]:
    """(document, item, first word, words, similarity) of the best window for each document and item."""
    h = words.hashes()
    p, q = similarity.numerator, similarity.denominator
    for width in sorted({i.width for i in index.items}):
        fits = W.window_fits(words, width)
        values = W.window_hashes(h, width)
        at = np.flatnonzero(index.sieve[values & W.U64(_SIEVE - 1)] & fits)
        lo = np.searchsorted(index.shingles, values[at])
        hi = np.searchsorted(index.shingles, values[at], side="right")
        at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        if not len(at):
            continue
        place = np.repeat(at, n)
        owner = index.owners[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        doc = np.searchsorted(words.first, place, side="right") - 1
        order = np.lexsort((place, owner, doc))
        place, owner, doc = place[order], owner[order], doc[order]
        cuts = np.flatnonzero((np.diff(owner) != 0) | (np.diff(doc) != 0)) + 1
        for a, b in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(place)]]).tolist()):
            item, d, spots = index.items[owner[a]], int(doc[a]), place[a:b]
            begin, end = int(words.first[d]), int(words.first[d + 1])
            length = min(item.words, end - begin)
            size, whole = length - width + 1, item.words - width + 1
            if item.width != width or size < 1:
                continue
            # windows that hold a hit
            reach = end - begin - length + 1
            near = W.covered(np.maximum(spots - begin - size + 1, 0), size, reach + size)[:reach] if size > 1 else np.isin(np.arange(reach), spots - begin)
            starts = np.flatnonzero(near) + begin
            # no more shingles in common than hits: a bound on the similarity
            hits = np.searchsorted(spots, starts + size) - np.searchsorted(spots, starts)
            starts = starts[q * hits >= p * (size + whole - hits)]
            if not len(starts):
                continue
            base = int(starts[0])
            prints = fingerprints(values[base : int(starts[-1]) + size], starts - base, size)
            best = None
            for s in starts[_within_radius(index, prints, int(owner[a]))].tolist():
                own = Counter(values[s : s + size].tolist())
                common = sum((own & item.weights).values())
                if q * common >= p * (size + whole - common) and (best is None or common > best[0]):
                    best = (common, s)
                    if common == whole:
                        break
            if best:
                yield d, int(owner[a]), best[1] - begin, length, best[0] / (size + whole - best[0])


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: Fraction = Fraction(8, 10), width: int = 5, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, start, n_words, similarity): the best window of each document for each item that it holds.

    Words are lower-cased in A-Z; items and windows of fewer than `width` words have
    all their words as one shingle; a document shorter than an item is compared whole. Null texts and items
    without words match nothing; the earliest of equally good windows counts; texts of any length are searched whole; repeated
    rows of docs are reported each, repeated items once; a null key comes back as null; empty tables give no rows; other columns are left out, whatever their names.
    """
    indexes = _indexes(benchmark, width, item_key, item_text)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("item_id", benchmark.schema[item_key].dataType), T.StructField("start", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("similarity", T.DoubleType())])
    found = [_scan(bounded_batches(docs).select(key, text), index, similarity, schema) for index in indexes]
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, benchmark: DataFrame, similarity: Fraction = Fraction(8, 10), width: int = 5, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item as `contaminated` finds them.

    Rows with a null or empty text stay; texts of any length are searched whole; repeated rows stay or go alike; ties don't matter; an
    empty benchmark keeps all rows; an empty table stays one; columns of any name pass through as they are.
    """
    for index in _indexes(benchmark, width, item_key, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches, shared=shared):
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for lo, _, words in W.pieces(batch.column(text), lower=True) if shared.value.items else ():
                    good[[lo + d for d, *_ in _hits(words, shared.value, similarity)]] = False
                yield batch.filter(pa.array(good))

        docs = bounded_batches(docs).mapInArrow(tidy(keep), docs.schema)
    return docs


def _indexes(benchmark: DataFrame, width: int, item_key: str, item_text: str) -> Iterator[Index]:
    """Indexes of slices of the benchmark, of bounded size each; one of nothing if it is empty."""
    items = benchmark.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text")).filter("text IS NOT NULL").distinct()
    n = -(-(items.agg(F.sum(F.length("text") * CHAR_BYTES + ITEM_BYTES)).first()[0] or 0) // SLICE_BYTES) or 1
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield build(sorted(((r["item_id"], r["text"]) for r in rows), key=str), width)


def _scan(docs: DataFrame, index: Index, similarity: Fraction, schema: T.StructType) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        index = shared.value
        for batch in batches:
            keys = batch.column(0)
            for lo, _, words in W.pieces(batch.column(1), lower=True) if index.items else ():
                if found := list(_hits(words, index, similarity)):
                    doc, item, start, length, score = zip(*found)
                    own = pa.array([index.items[i].id for i in item])
                    cols = [keys.take(pa.array([lo + d for d in doc])), own, pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(score)]
                    yield pa.RecordBatch.from_arrays(cols, schema.fieldNames())

    return docs.mapInArrow(tidy(run), schema)

