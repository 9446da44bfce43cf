"""Substring dedup with difference-cover anchors.

A window of `window` words is repeated if its word sequence also starts at any
other place of the corpus.  Hashing every window would move every word of the
corpus through a shuffle, so only anchors move at first: runs of words that
start at places whose remainder by the period lies in a difference cover.  For
any two places i and j some shift s below the period makes both i + s and j + s
cover places; with anchors of `window - period + 1` words both anchors lie
within the two windows and are equal if these are.  So a window that is repeated
holds an anchor that is repeated, and the second round extends just the
repeated anchors: it hashes (96 bits) the windows that hold one and keeps those
that occur twice.  The third round cuts the covered words.

Rounds exchange (hash, block) rows, distinct in each block of documents, so a
passage that a third of all documents share is a row for each block, never a
group in one task.  The three rounds read one shuffle of the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import blocks_for, bounded_batches, fresh, give_back, pack, passing, tidy, unpacked

#: Perfect difference sets: every remainder by the period is a difference of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
#: Documents of a block, and their characters, at most (about).
ROWS_PER_BLOCK, CHARS_PER_BLOCK = 2048, 4 << 20


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """Period and cover for a window: the largest period that leaves anchors of ten words or a third of the window."""
    fitting = [p for p in COVERS if window - p + 1 >= min(10, max(1, window // 3))]
    period = max(fitting, default=1)
    return period, COVERS.get(period, (0,))


def _repeated_in_order(batches: Iterator[pa.RecordBatch], keys: list[str], back: list[str]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by `keys`, those whose keys occur at least twice; `n` counts how often a row occurs.

    Holds one batch and one row: whether a row repeats shows in its neighbours.
    """
    held = None  # the last row, whose next neighbour isn't known yet
    held_twin = False
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in dict.fromkeys([*keys, *back, "n"])}
        if held is not None:
            cols = {c: np.concatenate([np.array([held[c]], v.dtype), v]) for c, v in cols.items()}
        same = np.ones(len(cols["n"]) - 1, bool)
        for k in keys:
            same &= cols[k][1:] == cols[k][:-1]
        twin = cols["n"] > 1
        twin[1:] |= same
        twin[:-1] |= same
        if held is not None:
            twin[0] |= held_twin
        held, held_twin = {c: v[-1] for c, v in cols.items()}, bool(twin[-1])
        at = np.flatnonzero(twin[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(cols[c][at]) for c in back], back)
    if held is not None and held_twin:
        yield pa.RecordBatch.from_arrays([pa.array(np.array([held[c]])) for c in back], back)


def repeated_rows(rows: DataFrame, keys: list[str], back: list[str]) -> DataFrame:
    """The columns `back` of rows whose keys occur twice or more, by one shuffle and a sort that can spill."""
    schema = T.StructType([rows.schema[c] for c in back])
    dealt = rows.repartition(F.col(keys[0])).sortWithinPartitions(*keys)
    return dealt.mapInArrow(tidy(lambda it: _repeated_in_order(it, keys, back)), schema)


def _anchors(texts: pa.Array, window: int) -> np.ndarray:
    """Hashes of all anchors of a block that can lie in a window."""
    found = [h for _, _, h in _anchor_places(texts, window)]
    return np.concatenate(found) if found else np.zeros(0, W.U64)


def _anchor_places(texts: pa.Array, window: int) -> Iterator[tuple[tuple[int, int, W.Words, np.ndarray], np.ndarray, np.ndarray]]:
    period, cover = cover_for(window)
    width = window - period + 1
    mask = np.zeros(period, bool)
    mask[list(cover)] = True
    for lo, hi, words in W.pieces(texts):
        h = words.hashes()
        fits = W.window_fits(words, width)
        n = len(fits)
        long_enough = np.repeat(words.counts() >= window, words.counts())[:n]
        at = np.flatnonzero(fits & long_enough & mask[words.places()[:n] % period])
        yield (lo, hi, words, h), at, W.window_hashes(h, width)[at]


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct row first stands, in order, and how often it occurs, 2 standing for more."""
    if not len(columns[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)
    begins = np.flatnonzero(new)
    count = np.minimum(np.diff(np.append(begins, len(order))), 2)
    first = order[begins]
    back = np.argsort(first)
    return first[back], count[back]


def _in_sorted(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in `known`, which is sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _both(h: np.ndarray, window: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 further bits of hash of the windows at some places."""
    return W.window_hashes(h, window)[at], (W.window_hashes(h, window, W.WORD_BASE_2)[at] >> W.U64(32)).astype(np.uint32)


def _candidate_windows(texts: pa.Array, window: int, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and place in the block of every window that holds a repeated anchor."""
    period, _ = cover_for(window)
    hits, base, out = np.sort(hits), 0, [(np.zeros(0, W.U64), np.zeros(0, np.uint32), np.zeros(0, np.int64))]
    for (_, _, words, h), at, anchors in _anchor_places(texts, window):
        good = at[_in_sorted(anchors, hits)]
        fits = W.window_fits(words, window)
        if len(good) and len(fits):
            # a window that starts up to period - 1 words before the anchor holds it
            near = W.covered(np.maximum(good - (period - 1), 0), period, len(fits) + period)[: len(fits)]
            starts = np.flatnonzero(near & fits)
            out.append((*_both(h, window, starts), starts + base))
        base += len(words.starts)
    return tuple(np.concatenate(x) for x in zip(*out))


def _cut(words: W.Words, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the documents without the words in `gone`, words joined by one space."""
    data = words.data.copy()
    keep = np.zeros(len(data) + 1, np.int8)
    kept = np.flatnonzero(~gone)
    np.add.at(keep, words.starts[kept], 1)
    np.add.at(keep, words.ends[kept], -1)
    keep = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
    # the byte before any word but a document's first is a separator
    doc = words.docs()[kept]
    joins = kept[1:][doc[1:] == doc[:-1]]
    data[words.starts[joins] - 1] = 32
    keep[words.starts[joins] - 1] = True
    sums = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], sums[words.offsets]


def _cut_block(texts: pa.Array, window: int, bad: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Kept text, word count and removed words of each document of a block; `bad` has a place of each repeated window."""
    pieces, base = list(W.pieces(texts)), 0
    known = [(np.zeros(0, W.U64), np.zeros(0, np.uint32))]
    hashes = [words.hashes() if len(bad) else None for _, _, words in pieces]
    for (_, _, words), h in zip(pieces, hashes):
        own = bad[(bad >= base) & (bad < base + len(words.starts))] - base
        if len(own):
            known.append(_both(h, window, own))
        base += len(words.starts)
    first, second = (np.concatenate(x) for x in zip(*known))
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    out, n_words, n_gone = [], [], []
    for (_, _, words), h in zip(pieces, hashes):
        fits = W.window_fits(words, window)
        gone = np.zeros(len(words.starts), bool)
        if len(fits) and len(first):
            at = np.flatnonzero(fits & _in_sorted(W.window_hashes(h, window), first))
            if len(at):
                one, other = _both(h, window, at)
                lo, hi = np.searchsorted(first, one), np.searchsorted(first, one, side="right")
                same = second[lo] == other
                for k in np.flatnonzero(~same & (hi - lo > 1)):  # two windows share their first hash
                    same[k] = other[k] in second[lo[k] : hi[k]]
                gone = W.covered(at[same], window, len(gone))
        out.append(W.strings(*_cut(words, gone)))
        n_words.append(words.counts())
        sums = np.concatenate([[0], np.cumsum(gone)])
        n_gone.append(np.diff(sums[words.first]))
    return pa.concat_arrays(out), np.concatenate(n_words), np.concatenate(n_gone)


def remove_repeats(docs: DataFrame, window: int = 35, text: str = "text", rows_per_block: int = ROWS_PER_BLOCK, key: str | None = None) -> DataFrame:
    """docs with `text` cut, and the columns n_words, n_removed and kept_sha256.

    Every word covered by a repeated window goes; what is left is joined by one
    space. Windows are judged on the input. Words are runs of bytes other than
    blank and \\t\\n\\v\\f\\r, unchanged.

    Null texts count as without words and give an empty text; documents
    of fewer words than the window stay whole (white space collapsed); texts of any length count whole; of
    repeated rows every copy is cut, as each is another place of the others; an
    empty table gives no rows; columns of any other name pass through, and columns
    named as the three new ones are replaced, the text too. `key`: a column that helps to
    deal rows out evenly; any values do, null too.
    """
    new = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_sha256": T.StringType()}
    keep = passing(bounded_batches(docs), new)
    block, body = fresh([*docs.columns, *new], "block", "body")
    dealt = docs.select(*[c for c in keep if c != text], F.col(text).alias(body), F.xxhash64(*dict.fromkeys([key or text, text])).alias(block))
    sizes = docs.agg(F.count("*").alias("rows"), F.sum(F.length(text)).alias("chars")).first()
    n = max(blocks_for(sizes["rows"], rows_per_block), blocks_for(sizes["chars"] or 0, CHARS_PER_BLOCK))
    dealt = pack(dealt.withColumn(block, F.pmod(F.col(block), F.lit(n))), body)
    out_schema = T.StructType([T.StructField(c, docs.schema[c].dataType, True) for c in keep] + [T.StructField(k, v) for k, v in new.items()])
    names = out_schema.fieldNames()

    def settled(group):
        """The rows in an order that depends on their texts only: shuffles deliver a block in any order, and places count words through it."""
        packed = group.column(body).to_pylist()
        return group.take(pa.array(sorted(range(len(packed)), key=lambda i: packed[i] or b""), pa.int64()))

    def anchors(key, group):
        h = _anchors(unpacked(group.column(body)), window)
        at, n = _distinct(h)
        return pa.table({"h": h[at].view(np.int64), "block": np.full(len(at), key[0].as_py()), "n": n})

    def windows(key, group, hits):
        h, g, place = _candidate_windows(unpacked(settled(group).column(body)), window, hits.column("h").to_numpy().view(W.U64))
        at, n = _distinct(h, g)
        return pa.table({"h": h[at].view(np.int64), "g": g[at].view(np.int32), "block": np.full(len(at), key[0].as_py()), "place": place[at], "n": n})

    def cut(key, group, bad):
        group = settled(group)
        texts = unpacked(group.column(body))
        if group.num_rows:
            kept, n_words, n_removed = _cut_block(texts, window, bad.column("place").to_numpy())
        else:
            kept, n_words, n_removed = pa.array([], pa.string()), [], []
        data, offsets = W.text_bytes(kept)
        raw = memoryview(data.tobytes())
        sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        made = {text: kept, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        give_back()
        return pa.table([made[c] if c in made else group.column(c) for c in names], names)

    group = lambda: dealt.select(*dealt.columns).groupBy(block)
    found = group().applyInArrow(anchors, "h long, block long, n long")
    hits = repeated_rows(found, ["h"], ["h", "block"])
    found = group().cogroup(hits.groupBy("block")).applyInArrow(windows, "h long, g int, block long, place long, n long")
    bad = repeated_rows(found, ["h", "g"], ["block", "place"])
    return group().cogroup(bad.groupBy("block")).applyInArrow(cut, out_schema)
