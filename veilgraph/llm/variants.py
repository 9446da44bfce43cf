"""Spelling variants: words that differ by one letter, and the more frequent form that each stands for.

Two words of one length differ by one replaced letter if they are equal without it, at the same place; a word is another with one letter
less if it equals the other without that letter. So every word posts a key for itself and one for each deletion: a polynomial hash of what stays, put together
from a prefix and a suffix hash of the word for all places of a batch at once. Keys are dealt to tasks by their leading digits and sorted; those that
meet no other are dropped, and for the rest the strings themselves are compared. A deletion has as many sources as there are letters to put
back, so that no group grows with the data, and a group gives a row for each member, never pairs.

Words beyond `LONG` letters don't go with each of their deletions: ids do, with two hashes, and strings are joined to the pairs so found.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import spread
from . import words as W
from .common import bounded_batches, materialise, tidy
from .shards import dealt, runs

U64 = np.uint64
#: Bytes of text, and words in memory before a task hands on their counts; rows of keys compared at once.
TEXT_BYTES, COUNTED, KEYS = 1 << 20, 600_000, 300_000
#: Letters up to which a word goes along with each of its keys.
LONG = 64
#: Digits of a key by which it is dealt out.
RADIX_BITS = 24
LETTERS = np.zeros(256, bool)
LETTERS[97:123] = True
#: The first of the two bytes of U+00C0 to U+00FF; there is no other use for it.
LEAD = 0xC3
FLAGS = np.array([True, False])  # of a byte: separator, part of a word
COUNTS_SCHEMA = "word string, n long"
KEYS_SCHEMA = "key long, place int, word string, n long"
NEAR_SCHEMA = "word string, near long, best_n long, best string"


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()


def checksums(states: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of data[starts[i]:ends[i]], after a text whose crc32 is states[i]: all words a byte further at each step."""
    sizes = ends - starts
    out = states.astype(np.uint32)
    for i in np.flatnonzero(sizes > LONG):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(out[i]))
    order = np.argsort(-np.where(sizes > LONG, 0, sizes), kind="stable")
    sizes, at = sizes[order], starts[order]
    state = ~out[order]
    first_long = np.where(sizes > LONG, 0, sizes)
    for k in range(int(first_long[0]) if len(first_long) else 0):
        n = int(np.searchsorted(-first_long, -k, side="left"))
        state[:n] = CRC[(state[:n] ^ data[at[:n] + k]) & np.uint32(0xFF)] ^ (state[:n] >> np.uint32(8))
    out[order] = ~state
    return out


def runs_of(column: pa.Array) -> Iterator[tuple[int, int, W.Words]]:
    """(first row, row after the last, lower-cased runs of letters) of pieces of whole documents."""
    data, offsets = W.text_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + TEXT_BYTES, side="right")) - 1)
        part = W.LOWER[data[offsets[row] : offsets[stop]]]
        word, lead = LETTERS[part], part == LEAD
        word |= lead
        word[1:] |= lead[:-1]
        yield row, stop, W.split(word.astype(np.uint8), offsets[row : stop + 1] - offsets[row], FLAGS)._replace(data=part)
        row = stop


def count_words(docs: DataFrame, shortest: int, every: int) -> DataFrame:
    """docs (key string, text) as rows (word, n), several for a word: runs of letters, one letter of some deleted, of `shortest` letters at least."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches):
        held, rows = [], 0

        def summed():
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            keys = batch.column("key").to_pylist()
            for row, stop, words in runs_of(batch.column("text")):
                if not len(words.starts):
                    continue
                states = np.array([zlib.crc32(f"{k or ''}:".encode()) for k in keys[row:stop]], np.uint32)[words.docs()]
                sums = checksums(states, words.data, words.starts, words.ends)
                leads = np.concatenate([[0], np.cumsum(words.data == LEAD)])
                letters = (words.ends - words.starts) - (leads[words.ends] - leads[words.starts])
                cut = sums % np.uint32(every) == 0
                whole = ~cut & (letters >= shortest)
                found = [W.spans(words.data, words.starts[whole], words.ends[whole])]
                less = []
                for i in np.flatnonzero(cut & (letters > shortest)):
                    run, at = words.text(i), int(sums[i]) % int(letters[i])
                    less.append(run[:at] + run[at + 1 :])
                counted = pc.value_counts(pa.concat_arrays([*found, pa.array(less, pa.string())]))
                held.append(pa.table({"word": counted.field("values"), "n": counted.field("counts")}))
                rows += len(counted)
                if rows >= COUNTED:
                    held = [summed()]
                    rows = held[0].num_rows
                    if rows >= COUNTED // 2:
                        yield from held[0].cast(schema).to_batches(max_chunksize=50_000)
                        held, rows = [], 0
        if held:
            yield from summed().cast(schema).to_batches(max_chunksize=50_000)

    return bounded_batches(docs).mapInArrow(tidy(count), COUNTS_SCHEMA)


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of words, a byte each, and where each word begins; column has no nulls."""
    data, offsets = W.text_bytes(column)
    lead = data == LEAD
    letters = data.copy()
    letters[1:][lead[:-1]] += 0x40
    before = np.concatenate([[0], np.cumsum(~lead)])
    return letters[~lead], before[offsets]


def deletion_keys(letters: np.ndarray, offsets: np.ndarray, base: int = W.WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and of the words without one letter, for each letter in order.

    The hash of letters c is the sum of (c[k] + 1) * base**k modulo 2**64: without the letter at k, it is the prefix's hash plus the suffix's divided by base.
    """
    sizes = np.diff(offsets)
    powers, inverse = W.powers(base, int(sizes.max(initial=0)) + 1)
    place = np.arange(len(letters)) - np.repeat(offsets[:-1], sizes)
    sums = np.zeros(len(letters) + 1, U64)
    np.cumsum((letters.astype(U64) + U64(1)) * powers[place], out=sums[1:])
    first, last = sums[offsets[:-1]], sums[offsets[1:]]
    less = (sums[:-1] - np.repeat(first, sizes)) + (np.repeat(last, sizes) - sums[1:]) * inverse[1]
    return W.mix(last - first), W.mix(less)


def _places(letters: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each letter: its word and place, and whether it differs from the one before it."""
    sizes = np.diff(offsets)
    word = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(letters)) - np.repeat(offsets[:-1], sizes)
    new = np.ones(len(letters), bool)
    new[1:] = (letters[1:] != letters[:-1]) | (place[1:] == 0)
    return word, place, new


def short_keys(words: DataFrame) -> DataFrame:
    """Rows of `KEYS_SCHEMA`: for each word its own key at place -1, and one for each place of a letter to delete."""
    schema = pa.schema([("key", pa.int64()), ("place", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def post(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                part = batch.slice(at, 10_000)
                letters, offsets = code_points(part.column("word"))
                whole, less = deletion_keys(letters, offsets)
                word, place, _ = _places(letters, offsets)
                own = pa.array(np.concatenate([np.arange(part.num_rows), word]))
                keys = np.concatenate([whole, less]).view(np.int64)
                places = np.concatenate([np.full(part.num_rows, -1), place]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(places), part.column("word").take(own), part.column("n").take(own)], schema=schema)

    return words.mapInArrow(tidy(post), KEYS_SCHEMA)


def near_in(table: pa.Table) -> pa.Table:
    """For rows of keys in which each key is whole: what its group tells each word of its near words, as rows of `NEAR_SCHEMA`."""
    keys = table.column("key").combine_chunks().to_numpy(zero_copy_only=False)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    table = table.take(pa.array(order[shared]))
    words, places = table.column("word").to_pylist(), table.column("place").to_numpy()
    # equal strings decide, not equal hashes
    stays = pa.array([w if p < 0 else w[:p] + w[p + 1 :] for w, p in zip(words, places.tolist(), strict=True)], pa.string())
    first = np.array([p <= 0 or w[p] != w[p - 1] for w, p in zip(words, places.tolist(), strict=True)], bool)
    rows = pa.table({"group": stays.dictionary_encode().indices, "place": pa.array(places), "n": table.column("n"), "word": table.column("word").combine_chunks(), "first": pa.array(first)})

    def ordered(part: pa.Table, by: list[str]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """part by groups, in each by n and then by word; the rows at which groups begin, and the rows of each."""
        part = part.take(pc.sort_indices(part, sort_keys=[*[(b, "ascending") for b in by], ("n", "descending"), ("word", "ascending")]))
        new = np.ones(part.num_rows, bool)
        if part.num_rows:
            new[1:] = np.any([part.column(b).to_numpy()[1:] != part.column(b).to_numpy()[:-1] for b in by], axis=0)
        starts = np.flatnonzero(new)
        return part, starts, np.diff(np.append(starts, part.num_rows))

    def told(to: pa.Table, near: np.ndarray, best: pa.Table) -> pa.Table:
        return pa.table({"word": to.column("word"), "near": pa.array(near, pa.int64()), "best_n": best.column("n"), "best": best.column("word")})

    # one letter replaced: all of a group of one place, for each the first of the others
    part, starts, sizes = ordered(rows.filter(pc.greater_equal(rows.column("place"), 0)), ["group", "place"])
    begin, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    some = np.flatnonzero(size > 1)
    is_first = some == begin[some]
    out = [told(part.take(pa.array(some)), size[some] - 1, part.take(pa.array(begin[some] + is_first)))]

    # one letter more: the word that a group is about, and those that give it by a deletion
    about = rows.filter(pc.less(rows.column("place"), 0))
    part, starts, sizes = ordered(rows.filter(pc.and_(rows.column("first"), pc.greater_equal(rows.column("place"), 0))), ["group"])
    at = np.full(int(pc.max(rows.column("group")).as_py() or 0) + 1, -1)
    at[about.column("group").to_numpy()] = np.arange(about.num_rows)
    groups = part.column("group").to_numpy()
    known = np.flatnonzero(at[groups] >= 0)
    out.append(told(part.take(pa.array(known)), np.ones(len(known), np.int64), about.take(pa.array(at[groups[known]]))))
    heads = np.flatnonzero(at[groups[starts]] >= 0)
    out.append(told(about.take(pa.array(at[groups[starts[heads]]])), sizes[heads], part.take(pa.array(starts[heads]))))
    return pa.concat_tables(out)


def short_near(words: DataFrame) -> DataFrame:
    def meet(batches):
        for table in runs(batches, "shard", KEYS):
            found = near_in(table.drop_columns(["shard"]))
            yield from found.to_batches(max_chunksize=50_000)

    keys = short_keys(words)
    return dealt(keys, F.shiftrightunsigned("key", 64 - RADIX_BITS)).mapInArrow(tidy(meet), NEAR_SCHEMA)


def differ_by_one(a: str, b: str) -> bool:
    """Do the words differ by exactly one inserted, deleted or replaced code point?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    low, high = 0, len(a)
    while low < high:  # the common prefix's length, by halves
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


def long_near(words: DataFrame) -> DataFrame:
    """Near words of which one at least has more than `LONG` letters; words has all of `LONG` letters and more."""
    schema = pa.schema([("key", pa.int64()), ("key2", pa.int64()), ("place", pa.int32()), ("new", pa.bool_()), ("id", pa.string())])

    def post(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                letters, offsets = code_points(batch.column("word").slice(i, 1))
                (whole, less), (whole2, less2) = deletion_keys(letters, offsets), deletion_keys(letters, offsets, W.WORD_BASE_2)
                _, place, new = _places(letters, offsets)
                if len(letters) <= LONG:
                    less, less2, place, new = less[:0], less2[:0], place[:0], new[:0]
                columns = [np.append(less, whole).view(np.int64), np.append(less2, whole2).view(np.int64), np.append(place, -1).astype(np.int32), np.append(new, True)]
                out = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.repeat(batch.column("id")[i], len(place) + 1)], schema=schema)
                for at in range(0, out.num_rows, 50_000):
                    yield out.slice(at, 50_000)

    words = words.withColumn("id", F.sha2("word", 256))
    keys = materialise(words.mapInArrow(tidy(post), "key long, key2 long, place int, new boolean, id string"))
    less, whole = keys.filter("place >= 0"), keys.filter("place < 0").select("key", "key2", F.col("id").alias("other"))
    replaced = less.join(less.select("key", "key2", "place", F.col("id").alias("other")), ["key", "key2", "place"]).filter("id <> other").select("id", "other")
    inserted = less.filter("new").join(whole, ["key", "key2"]).select("id", "other")
    pairs = replaced.unionByName(inserted).unionByName(inserted.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()
    pairs = pairs.join(words, "id").join(words.select(F.col("id").alias("other"), F.col("word").alias("best"), F.col("n").alias("best_n")), "other")

    def verify(batches):
        for batch in batches:
            true = [differ_by_one(batch.column("word")[i].as_py(), batch.column("best")[i].as_py()) for i in range(batch.num_rows)]
            yield batch.filter(pa.array(true, pa.bool_()))

    return pairs.select("word", F.lit(1).cast("long").alias("near"), "best_n", "best").mapInArrow(tidy(verify), NEAR_SCHEMA)


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) with `root`, where a chain of forms ends: pointers are doubled until none moves, six rounds for counts of 64 bits."""
    forms = materialise(forms.withColumn("root", F.col("form")))
    while True:
        ends = forms.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialise(forms.join(ends, "root", "left").select("word", "form", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        forms = moved.drop("moved")
        if moved.filter("moved").limit(1).count() == 0:
            return forms


def group_variants(docs: DataFrame, shortest: int = 5, least: int = 3, times: int = 2, every: int = 97, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one for each word of the texts that occurs `least` times.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of `shortest` letters at least. For words to be told from slips, a run whose
    crc32 after its document's key is divisible by `every` loses a letter first. Near words differ by one inserted, deleted or replaced letter; n_near counts them.
    A word's form is its near word of largest n (of equal ones the smallest), where that n is `times` the word's own at least; root is where forms lead.

    Null and empty texts have no words; texts and runs of any length count whole; a null key is an empty one; repeated rows count as often as they stand;
    an empty table gives no rows; other columns, whatever their names, play no part.
    """
    if times < 2:
        raise ValueError("forms could lead around: times must be 2 or more")
    docs = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    words = count_words(docs, shortest, every).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    words = materialise(words)
    near = short_near(spread(words.filter(F.length("word") <= LONG)))
    long = words.filter(F.length("word") >= LONG)
    if long.filter(F.length("word") > LONG).limit(1).count():
        near = near.unionByName(long_near(long))
    near = near.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("top"))
    far = (-F.col("top.m")) >= F.col("n") * times
    known = words.join(near, "word", "left").select("word", F.when(far, F.col("top.best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, -F.col("top.m")).alias("form_n"))
    known = materialise(known)
    ends = roots(known.filter("form is not null").select("word", "form")).select("word", "root")
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
