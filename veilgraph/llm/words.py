"""Vectorised word kernels over Arrow text buffers.

Everything here works on the UTF-8 bytes of whole batches of documents with
numpy, so that Python touches no single word.  Words are the maximal runs of
bytes that are not separators; a word is represented by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multipliers of the byte polynomial and of two word polynomials.
BYTE_BASE, WORD_BASE, WORD_BASE_2 = (
    0x9E3779B97F4A7C15,
    0xD1342543DE82EF95,
    0xAF251AF3B0F025B5,
)
#: Texts are handled in pieces of about this many bytes, whole documents each.
PIECE_BYTES = 1 << 18
#: Bytes, or words, that a hash's sums run over at once: the tables of powers stay small however long a text is.
STRETCH = 1 << 15


def _byte_table(of: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(of)] = True
    return table


#: [\x20\x09-\x0D]
SPACE = _byte_table(b" \t\n\x0b\x0c\r")
#: [\x00-\x2F\x3A-\x60\x7B-\x7F]: all of ASCII that is not a digit or a-z (texts are lower-cased before).
NOT_ALNUM = _byte_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; x is changed in place."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.ones(n, U64)
        filled, step = 1, b
        while filled < n:
            more = min(filled, n - filled)
            np.multiply(p[:more], U64(step), out=p[filled : filled + more])
            filled, step = filled + more, step * step % (1 << 64)
        out.append(p)
    return out[0], out[1]


@lru_cache(maxsize=4)
def _kept_powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, 2 * STRETCH)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; only short tables are kept, so a worker holds 1 MB a base."""
    p, q = _kept_powers(base) if n <= 2 * STRETCH else _powers(base, n)
    return p[:n], q[:n]


def polynomial(values: np.ndarray, base: int) -> int:
    """The sum of values[i] * base**i modulo 2**64, a stretch at a time."""
    p, _ = powers(base, STRETCH)
    total = 0
    for a in range(0, len(values), STRETCH):
        part = values[a : a + STRETCH].astype(U64)
        total += int((part * p[: len(part)]).sum()) * pow(base, a, 1 << 64)
    return total % (1 << 64)


class Words(NamedTuple):
    """The words of a piece of a batch."""

    data: np.ndarray  # bytes of the documents, one after another (lower-cased if asked)
    offsets: np.ndarray  # document k has bytes offsets[k]:offsets[k + 1]
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    first: np.ndarray  # document k has words first[k]:first[k + 1]

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, U64)
        out = np.empty(len(self.starts), U64)
        at = 0
        while at < len(out):
            lo = int(self.starts[at])
            stop = int(np.searchsorted(self.ends, lo + STRETCH, side="right"))
            if stop <= at:  # one very long word
                out[at] = U64(polynomial(self.data[lo : self.ends[at]].astype(np.uint16) + np.uint16(1), BYTE_BASE))
                at += 1
                continue
            hi = int(self.ends[stop - 1])
            p, inverse = powers(BYTE_BASE, hi - lo)
            sums = np.zeros(hi - lo + 1, U64)
            np.cumsum((self.data[lo:hi].astype(U64) + U64(1)) * p, out=sums[1:])
            starts, ends = self.starts[at:stop] - lo, self.ends[at:stop] - lo
            out[at:stop] = (sums[ends] - sums[starts]) * inverse[starts]
            at = stop
        return mix(out)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def places(self) -> np.ndarray:
        """The place of each word in its document."""
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.counts())

    def text(self, k: int) -> str:
        return self.data[self.starts[k] : self.ends[k]].tobytes().decode("utf-8", "replace")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, off, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, lower: bool = False) -> Words:
    """Words of documents data[offsets[k]:offsets[k + 1]]."""
    if lower:
        data = LOWER[data]
    word = ~separators[data]
    lo, hi = offsets[:-1], offsets[1:]
    full = hi > lo
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    begins[lo[full]] = word[lo[full]]
    stops[hi[full] - 1] = word[hi[full] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def pieces(column: pa.Array | pa.ChunkedArray, separators: np.ndarray = SPACE, lower: bool = False, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) for pieces of whole documents of about `size` bytes."""
    data, offsets = text_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, stop, split(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], separators, lower)
        row = stop


def window_hashes(words: np.ndarray, width: int, base: int = WORD_BASE) -> np.ndarray:
    """Hash of every `width` consecutive entries of `words`; entry i covers words[i:i + width]."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, step = np.empty(n, U64), max(STRETCH, width)
    p, inverse = powers(base, step + width - 1)
    for a in range(0, n, step):
        part = words[a : a + step + width - 1]
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(part * p[: len(part)], out=sums[1:])
        k = len(part) - width + 1
        out[a : a + k] = (sums[width:] - sums[:-width]) * inverse[:k]
    return mix(out)


def window_fits(words: Words, width: int) -> np.ndarray:
    """For every place a window of `width` words could start at: does it end in the same document?"""
    n = len(words.starts) - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    left = np.repeat(words.first[1:], words.counts())[:n] - np.arange(n)
    return left >= width


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of `width` from one of `starts`."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + width, n), minlength=n + 1)
    return np.cumsum(change[:-1]) > 0


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column from its bytes and offsets."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """data[starts[i]:ends[i]], which don't overlap and are in order, as a string column."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    change = np.zeros(len(data) + 1, np.int8)
    change[starts] += 1
    change[ends] -= 1
    return strings(data[np.cumsum(change[:-1]).astype(bool)], offsets)
