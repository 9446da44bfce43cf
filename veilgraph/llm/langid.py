"""Language ID with interpolated Kneser-Ney character language models.

For each language of a bounded sample of labelled documents a model of order
`ORDER` is estimated: discounted counts at the highest order, continuation
counts below, all interpolated.  N-grams are 64-bit hashes in sorted arrays, with
the log probability and the back-off weight of each.  A text gets the language
of the lowest cross-entropy per character.  It is rejected if that is above the
language's bound for its length, which is set by texts the model hasn't seen.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import bounded_batches, give_back, passing, tidy
from .sampling import bounded_sample, fold

ORDER = 4
SPACE = 32
#: Documents and characters of each language to learn from, at most (about), and characters of all languages.
SAMPLE, LANGUAGE_CHARS, SAMPLE_CHARS = 800, 1 << 20, 16 << 20
#: Distinct languages, at most: the models of all are sent to every task.
LANGUAGES = 512
_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
#: Bytes of the cache of n-gram scores that each task keeps.
CACHE_BYTES = 12 << 20
#: Lengths in characters that have a bound of their own. Longer texts get that of the last: they differ by topic and quotations, not by chance.
LENGTHS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 50, 70, 100])
#: A bound lies `REACH` times as far above the median as this quantile; rows of another language may be as many as it leaves out.
QUANTILE, REACH = 0.95, 5.0
#: It lies this much above the median at least, over the root of the length, and more if the texts are few: these tell little about the others.
LEAST = 5.0
#: Pieces of a length that a bound takes, at least; with fewer, the one before goes on, its margin falling with the root of the length.
PIECES = 20
#: Texts that set the bounds, at least, if a language has so many.
UNSEEN = 100


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: the lower-case letter, or a space if it is no letter or mark."""
    table = np.full(sys.maxunicode + 1, SPACE, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha() or (i > 127 and unicodedata.category(c) in ("Mn", "Mc")):
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


@lru_cache(maxsize=1)
def _marks() -> np.ndarray:
    """Code points that go on letters, but are none."""
    return np.array([i for i in range(128, sys.maxunicode + 1) if unicodedata.category(chr(i)) in ("Mn", "Mc")], np.uint32)


class Chars(NamedTuple):
    codes: np.ndarray  # letters in lower case, runs of all else as one space, ORDER - 1 spaces before each document
    first: np.ndarray  # document k has codes first[k]:first[k + 1], the spaces before it included
    real: np.ndarray  # which codes are to be scored
    letters: np.ndarray  # letters in each document


def characters(data: np.ndarray, offsets: np.ndarray) -> Chars:
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]  # no continuation bytes
    codes = _letters()[codes]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(begins))
    blank = codes == SPACE
    drop = np.zeros(len(codes), bool)
    drop[1:] = blank[1:] & blank[:-1] & (doc[1:] == doc[:-1])
    drop[begins[:-1][np.diff(begins) > 0]] |= blank[begins[:-1][np.diff(begins) > 0]]
    keep = np.flatnonzero(~drop)
    codes, doc = codes[keep], doc[keep]
    counts = np.bincount(doc, minlength=len(offsets) - 1) if len(doc) else np.zeros(len(offsets) - 1, np.int64)
    # a space ends each document, ORDER - 1 stand before it
    at = np.arange(len(codes)) + ORDER * doc + ORDER - 1
    first = np.concatenate([[0], np.cumsum(counts + ORDER)])
    out = np.full(first[-1], SPACE, np.uint32)
    out[at] = codes
    real = np.ones(len(out), bool)
    for k in range(ORDER - 1):
        real[first[:-1] + k] = False
    letters = np.bincount(doc[(codes != SPACE) & ~np.isin(codes, _marks())], minlength=len(offsets) - 1) if len(doc) else np.zeros(len(offsets) - 1, np.int64)
    return Chars(out, first, real, letters)


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the `order` codes that end at each place; places without so many are 0."""
    h = np.full(len(codes), order, W.U64)
    for k in range(order):
        if len(codes) > k:
            h[k:] += (codes[: len(codes) - k].astype(W.U64) + W.U64(1)) * _MULTIPLIERS[k]
    return W.mix(h)


class Model(NamedTuple):
    """Of one language; for each order n from 1 sorted n-gram hashes and their log probabilities; from 2 sorted hashes of contexts and their back-off weights."""

    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    base: float  # log probability of an unseen character

    def scores(self, grams: list[np.ndarray]) -> np.ndarray:
        """Log probability of each gram's last code; grams[n - 1] has the hashes of order n."""
        out = np.full(len(grams[0]), self.base)
        todo = np.arange(len(out))
        weight = np.zeros(len(out))
        for n in range(len(self.keys), 0, -1):
            at, found = _find(self.keys[n - 1], grams[n - 1][todo])
            hit = todo[found]
            out[hit] = weight[hit] + self.logp[n - 1][at[found]]
            todo = todo[~found]
            if not len(todo):
                return out
            if n > 1:  # the context: the n - 1 codes before the last
                at, found = _find(self.contexts[n - 2], grams[-1 + ORDER + n - 1][todo])
                weight[todo[found]] += self.backoff[n - 2][at[found]]
        out[todo] = weight[todo] + self.base
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def all_grams(codes: np.ndarray) -> list[np.ndarray]:
    """Hashes of orders 1 to ORDER that end at each place, then those of orders 1 to ORDER - 1 that end before it."""
    own = [gram_hashes(codes, n) for n in range(1, ORDER + 1)]
    return own + [np.concatenate([np.zeros(1, W.U64), g[:-1]]) for g in own[:-1]]


def estimate(chars: Chars) -> Model:
    """Interpolated Kneser-Ney from the documents of one language."""
    real = chars.real
    grams = all_grams(chars.codes)
    # distinct n-grams of each order with the hash of their context, of their suffix, and the count
    table: list[dict] = []
    for n in range(1, ORDER + 1):
        key, at, count = np.unique(grams[n - 1][real], return_index=True, return_counts=True)
        place = np.flatnonzero(real)[at]
        table.append({"key": key, "count": count.astype(float), "context": grams[ORDER + n - 2][place] if n > 1 else np.zeros(len(key), W.U64), "suffix": grams[n - 2][place] if n > 1 else None})
    for n in range(1, ORDER):  # below the highest order: by how many different codes they are preceded
        at, found = _find(table[n - 1]["key"], table[n]["suffix"])
        kinds = np.bincount(at[found], minlength=len(table[n - 1]["key"])).astype(float)
        table[n - 1]["count"] = np.maximum(kinds, 1.0)
    vocabulary = len(table[0]["key"]) + 1
    lower = np.full(len(table[0]["key"]), 1.0 / vocabulary)
    keys, logp, before, backoff = [], [], [], []
    for n in range(1, ORDER + 1):
        t = table[n - 1]
        ones, twos = (t["count"] == 1).sum(), (t["count"] == 2).sum()
        discount = min(0.95, max(0.1, ones / (ones + 2.0 * twos) if ones else 0.5))
        contexts, group = np.unique(t["context"], return_inverse=True)
        total = np.bincount(group, t["count"])
        kinds = np.bincount(group)
        left = discount * kinds / total
        p = np.maximum(t["count"] - discount, 0) / total[group] + left[group] * (lower if n == 1 else np.exp(logp[n - 2][_find(keys[n - 2], t["suffix"])[0]]))
        keys.append(t["key"])
        logp.append(np.log(p))
        if n == 1:
            base = float(np.log(left[0] / vocabulary))
        else:
            before.append(contexts)
            backoff.append(np.log(left))
    return Model(keys, logp, before, backoff, base)


class Identifier(NamedTuple):
    languages: list[str]
    models: list[Model]
    bounds: np.ndarray  # highest cross-entropy that is accepted, of each language (rows) for each of `LENGTHS`

    def entropies(self, chars: Chars, cache: dict) -> np.ndarray:
        """Cross-entropy per character of each document (rows) under each language (columns)."""
        full = gram_hashes(chars.codes, ORDER)
        if not cache:
            slots = 1 << (max(1, CACHE_BYTES // (8 + 4 * len(self.models))).bit_length() - 1)
            cache |= {"keys": np.zeros(slots, W.U64), "scores": np.zeros((slots, len(self.models)), np.float32)}
        keys, scores = cache["keys"], cache["scores"]
        slot = (full & W.U64(len(keys) - 1)).astype(np.int64)
        missing = np.flatnonzero((keys[slot] != full) & chars.real)
        each = scores[slot]  # before slots are taken over: their n-grams may stand in this piece too
        if len(missing):
            _, first, same = np.unique(full[missing], return_index=True, return_inverse=True)
            places = missing[first]
            near = np.stack([chars.codes[np.maximum(places - k, 0)] for k in range(ORDER)])  # the last code first
            own = []
            for back in (0, 1):
                for n in range(1, ORDER + 1 - back):
                    h = np.full(len(places), n, W.U64)
                    for k in range(n):
                        h += (near[k + back].astype(W.U64) + W.U64(1)) * _MULTIPLIERS[k]
                    own.append(W.mix(h))
            found = np.stack([m.scores(own) for m in self.models], axis=1).astype(np.float32)
            keys[slot[places]] = full[places]
            held = keys[slot[places]] == full[places]  # of those of this piece that share a slot, one
            scores[slot[places[held]]] = found[held]
            each[missing] = found[same]
        each = np.where(chars.real[:, None], each, np.float32(0))
        n = np.diff(chars.first) - (ORDER - 1)
        sums = np.add.reduceat(each.astype(np.float64), chars.first[:-1], axis=0) if len(n) else np.zeros((0, len(self.models)))
        return -sums / np.maximum(n, 1)[:, None]


def held_out(texts: set[str]) -> list[np.ndarray]:
    """The scores of the codes of texts under a model that hasn't seen them: of a fifth of the texts, and of more fifths until `UNSEEN` are judged; a single text is judged by halves."""
    rows = sorted(texts, key=lambda t: (hash_of(t), t))
    if len(rows) == 1:
        rows = [rows[0][: len(rows[0]) // 2], rows[0][len(rows[0]) // 2 :]]
    part = lambda some: characters(*W.text_bytes(pa.array(some, pa.string())))
    out: list[np.ndarray] = []
    folds = min(5, len(rows))
    for k in range(folds):
        if len(out) < UNSEEN:
            own = part(rows[k::folds])
            scores = estimate(part([t for i, t in enumerate(rows) if i % folds != k])).scores(all_grams(own.codes))
            out += [scores[a + ORDER - 1 : b] for a, b in zip(own.first, own.first[1:])]
    return out if len(texts) > 1 else [np.concatenate(out)]


def bounds(texts: list[np.ndarray]) -> np.ndarray:
    """For each of `LENGTHS` the highest cross-entropy to accept, from the scores of the codes of unseen texts, in pieces of that length."""
    out, middle, width = [], 0.0, np.inf  # width: the margin for one character
    for length in LENGTHS:
        runs = [t[: len(t) // length * length] for t in texts]
        values = -np.concatenate([np.zeros(0), *runs]).reshape(-1, length).mean(axis=1)
        if len(values) >= PIECES or len(values) and not out:
            middle, high = np.quantile(values, [0.5, QUANTILE])
            width = max(REACH * (high - middle) * np.sqrt(length), LEAST * (1 + 1 / len(texts)))
        out.append(middle + width / np.sqrt(length))
    return np.array(out)


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Identifier:
    """Models from about `sample` documents of each language of `docs`, whole texts of `LANGUAGE_CHARS` characters each and `SAMPLE_CHARS` in all at most.

    The sample is bounded in documents, characters and languages, so are the models and what a task holds; a
    language without letters in its texts gets none. Rows with a null language or text, and empty texts, are left out; a
    null or repeated key is no matter, repeated rows count once; documents of 65,536 characters or more are
    left to languages that have no shorter ones; ties of the sampling hash don't matter; an empty table gives no models; other columns aren't read.
    """
    rows = bounded_batches(docs).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text <> '' AND lang IS NOT NULL")
    picked = bounded_sample(rows, "lang", sample, LANGUAGES, "text", SAMPLE_CHARS, LANGUAGE_CHARS)

    def fit(key, group):
        data, offsets = W.text_bytes(group.column("text"))
        chars = characters(data, offsets)
        if not chars.letters.sum():
            return pa.table({"lang": pa.array([], pa.string()), "model": pa.array([], pa.binary())})
        import pickle

        limits = bounds(held_out({t for t, c in zip(group.column("text").to_pylist(), chars.letters) if c}))
        model = pickle.dumps((estimate(chars), limits))
        give_back()
        return pa.table({"lang": [key[0].as_py()], "model": [model]})

    import pickle

    found = sorted((r["lang"], r["model"]) for r in picked.groupBy("lang").applyInArrow(fit, "lang string, model binary").collect())
    parts = [pickle.loads(bytes(m)) for _, m in found]
    return Identifier([x for x, _ in found], [m for m, _ in parts], np.array([x for _, x in parts]))


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode()) << 32 | len(text)


def identify(docs: DataFrame, model: Identifier, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred, score and rejected.

    lang_pred is the language of the lowest cross-entropy per character, ties to
    the first by name; score its share in 0 to 1. rejected is set if there is no
    letter, or if the cross-entropy exceeds the language's bound for texts of this length,
    which pieces of held-out texts of the language set (`bounds`).

    Null and empty texts and texts without a letter (marks are none) get `und`, score 0, and are
    rejected; with no model at all every text does. Very long texts are judged whole. Repeated rows are judged alike;
    an empty table gives no rows; other columns pass through and those named as new ones are replaced, the text too.
    """
    new = {"lang_pred": T.StringType(), "score": T.DoubleType(), "rejected": T.BooleanType()}
    keep = passing(docs, new, None if keep_text else text)
    docs = docs.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(k, v) for k, v in new.items()])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, "und"], object)
        for batch, best, score, far in _judged(batches, shared.value, text):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(far)], schema.fieldNames())

    return bounded_batches(docs).mapInArrow(tidy(judge), schema)


def accepted(docs: DataFrame, model: Identifier, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that `identify` doesn't reject.

    Null and empty texts, texts without a letter, and with no model at all every row, go; very long texts are judged whole; of repeated rows all stay or all
    go; ties are settled as there; an empty table stays one; columns of any name pass through as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for batch, _, _, far in _judged(batches, shared.value, text):
            yield batch.filter(pa.array(~far))

    return bounded_batches(docs).mapInArrow(tidy(keep), docs.schema)


def _judged(batches: Iterator[pa.RecordBatch], model: Identifier, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Each batch with the number of the language (one past the last: none), the score, and whether it is rejected."""
    cache: dict = {}
    for batch in batches:
        data, offsets = W.text_bytes(batch.column(text))
        lo, found = 0, []
        while lo < len(offsets) - 1:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + W.PIECE_BYTES, side="right")) - 1)
            chars = characters(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            n = (np.diff(chars.first) - (ORDER - 1)).astype(float)
            if model.models:
                h = model.entropies(chars, cache)
                best = np.argmin(h, axis=1)
                low = h[np.arange(len(h)), best]
                # the share of the likeliest language, were the text of up to 40 characters
                score = 1 / np.exp((low[:, None] - h) * np.minimum(n, 40)[:, None]).sum(axis=1)
                far = low > model.bounds[best, np.maximum(np.searchsorted(LENGTHS, n, side="right") - 1, 0)]
            else:
                best, score, far = np.zeros(hi - lo, int), np.zeros(hi - lo), np.ones(hi - lo, bool)
            no = (chars.letters == 0) | (not model.models)
            found.append((np.where(no, len(model.languages), best), np.where(no, 0.0, score), far | no))
            lo = hi
        best, score, far = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0), np.zeros(0, bool))
        yield batch, best, score, far


def training_rows(docs: DataFrame, folds: int = 4, held_out: int = 2, key: str = "doc_id") -> DataFrame:
    return docs.filter(fold(key, folds) != held_out)
