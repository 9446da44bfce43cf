"""Toxicity with a weighted grammar of finite-state patterns.

Words become symbols: insult, threat, target, negation, reported speech, or
nothing.  Insults are a lexicon of word beginnings, some given, most learned: a
beginning enters if it stands in toxic documents of a bounded labelled sample
more often than chance allows among all beginnings tried.  Three transducers are
composed into one, which reads a document's symbols clause by clause:

    negation   marks what follows a negation within three words
    reporting  marks what follows a verb of reporting, up to the clause's end
    verdict    turns insults and threats with their marks into patterns; whether a
               clause is aimed at somebody shows at its end, where it emits what is pending

Each pattern weighs what the sample shows: the share of toxic documents among
those that have it.  A document's score is the noisy-or of its patterns' weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import bounded_batches, materialise, passing, tidy
from .neardup import shingles
from .sampling import bounded_sample

#: Labelled documents to learn from, at most (about): toxic and other ones.
TOXIC_SAMPLE, OTHER_SAMPLE = 2500, 10000
#: Characters of either, at most (about). With the number of documents this bounds the lexicon too: an entry stands in a dozen of them.
SAMPLE_CHARS = 16 << 20
#: Lengths of beginnings in bytes. Longer words that start alike count as one.
SHORTEST, LONGEST = 3, 12
NONE, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
#: Words that a negation reaches.
SCOPE = 3
#: Words of the grammar, in the languages of the corpus.
SEEDS = {
    THREAT: "kill hurt destroy beat crush strangle shoot stab burn toeten verletzen zerstoeren tuer frapper detruire matar golpear destruir",
    TARGET: "you your yours yourself he him his she her they them their these those this that du dich dir euch ihr sie ihm tu te toi vous votre il elle ils elles usted ustedes ellos ellas ti vosotros",
    NEGATION: "not never no nobody none neither nor nicht nie niemals kein keine keinen pas jamais aucun aucune nunca jamas ningun ninguna",
    REPORT: "said says say called told claims claimed wrote quoted reported sagte sagt schrieb nannte dit disait raconte dijo dice escribio llamo",
}
INSULTS = "idiot moron stupid imbecile scum dumbass asshole bastard"
#: Patterns: what the grammar can find in a clause.
PATTERNS = ("insult", "aimed insult", "negated insult", "reported insult", "threat", "aimed threat", "negated threat", "reported threat")
#: Share of toxic documents among those with a pattern, before any is seen, and how many documents that counts for.
PRIOR = np.array([0.8, 0.9, 0.6, 0.6, 0.1, 0.2, 0.05, 0.05])
PRIOR_COUNT, NONE_PRIOR = 4.0, 0.05
_CLAUSE = W._byte_table(b".!?;:\n\r")


def _word_hash(word: str) -> np.uint64:
    return W.split(*W.text_bytes(pa.array([word])), W.NOT_ALNUM, True).hashes()[0]


class Lexicon(NamedTuple):
    whole: np.ndarray  # sorted hashes of whole words
    symbol: np.ndarray  # with the symbol of each
    lengths: tuple[int, ...]  # of beginnings
    begins: tuple[np.ndarray, ...]  # sorted hashes of the beginnings of each length


def beginnings(words: W.Words, lengths: Iterable[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length in bytes, ascending, the words of at least so many and the hash of what comes before the cut; words are cut between characters only."""
    size = words.ends - words.starts
    p, _ = W.powers(W.BYTE_BASE, LONGEST)
    sums, wanted = np.zeros(len(size), W.U64), set(lengths)
    for length in range(1, max(wanted, default=0) + 1):
        at = np.flatnonzero(size >= length)
        sums[at] += (words.data[words.starts[at] + length - 1].astype(W.U64) + W.U64(1)) * p[length - 1]
        if length in wanted:
            cut = words.starts[at] + length
            inside = cut < words.ends[at]
            fine = ~inside
            fine[inside] = (words.data[cut[inside]] & 0xC0) != 0x80
            yield length, at[fine], W.mix(sums[at[fine]] + W.U64(length))


def _find(sorted_keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    # most values are ruled out by their low bits
    sieve = np.zeros(1 << 16, bool)
    sieve[sorted_keys & W.U64(0xFFFF)] = True
    found = sieve[values & W.U64(0xFFFF)]
    at = np.zeros(len(values), np.int64)
    some = np.flatnonzero(found)
    at[some] = np.minimum(np.searchsorted(sorted_keys, values[some]), len(sorted_keys) - 1)
    found[some] = sorted_keys[at[some]] == values[some]
    return at, found


def symbols(words: W.Words, lexicon: Lexicon) -> np.ndarray:
    """The symbol of each word; given words come before learned beginnings."""
    out = np.zeros(len(words.starts), np.int8)
    known = dict(zip(lexicon.lengths, lexicon.begins))
    for length, at, h in beginnings(words, known):
        out[at[_find(known[length], h)[1]]] = INSULT
    at, found = _find(lexicon.whole, words.hashes())
    out[found] = lexicon.symbol[at[found]]
    return out


def given(lengths: tuple[int, ...] = (), begins: tuple[np.ndarray, ...] = ()) -> Lexicon:
    words = {_word_hash(w): s for s, text in {**SEEDS, INSULT: INSULTS}.items() for w in text.split()}
    keys = np.array(sorted(words), W.U64)
    return Lexicon(keys, np.array([words[k] for k in keys], np.int8), lengths, begins)


class Transducer(NamedTuple):
    """Deterministic: by state (rows) and input (columns) the next state and the output. It starts in state 0."""

    next: np.ndarray
    out: np.ndarray

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one puts out, the other reads."""
        n = len(other.next)
        state = np.arange(len(self.next) * n)
        mine, theirs = state // n, state % n
        read = self.out[mine]
        return Transducer(self.next[mine] * n + other.next[theirs[:, None], read], other.out[theirs[:, None], read])


def _machine(states: int, inputs: int, step: Callable[[int, int], tuple[int, int]]) -> Transducer:
    cells = np.array([[step(s, x) for x in range(inputs)] for s in range(states)])
    return Transducer(cells[..., 0], cells[..., 1])


def negation() -> Transducer:
    """Symbols to symbols, 8 more if negated; the state counts the words that a negation still reaches."""

    def step(state: int, x: int) -> tuple[int, int]:
        return (0 if x == END else SCOPE if x == NEGATION else max(state - 1, 0)), x + 8 * (state > 0)

    return _machine(SCOPE + 1, END + 1, step)


def reporting() -> Transducer:
    """Marked symbols to marked symbols, 16 more if reported."""

    def step(state: int, x: int) -> tuple[int, int]:
        symbol = x % 8
        return (0 if symbol == END else int(state or symbol == REPORT)), x + 16 * state

    return _machine(2, 16, step)


def verdict() -> Transducer:
    """Marked symbols to sets of patterns, a bit each. State bits: aimed at somebody, an insult pending, a threat pending."""

    def step(state: int, x: int) -> tuple[int, int]:
        symbol, found = x % 8, 0
        if symbol == END:
            for k in range(2):
                if state & 2 << k:
                    found |= 1 << 4 * k + (state & 1)
            return 0, found
        if symbol in (INSULT, THREAT):
            k = int(symbol == THREAT)
            if x & 8:
                return state, 1 << 4 * k + 2
            if x & 16:
                return state, 1 << 4 * k + 3
            return state | 2 << k, 0
        return state | (symbol == TARGET), 0

    return _machine(8, 32, step)


@lru_cache(maxsize=1)
def grammar_machine() -> tuple[list[list[int]], list[list[int]]]:
    """Next states and outputs of the three transducers, composed."""
    whole = negation().then(reporting()).then(verdict())
    return whole.next.tolist(), whole.out.tolist()


def patterns(words: W.Words, lexicon: Lexicon) -> list[tuple[int, tuple[int, ...]]]:
    """(document, patterns found) for each document with any."""
    symbol = symbols(words, lexicon)
    doc = words.docs()
    hot = np.unique(doc[(symbol == INSULT) | (symbol == THREAT)])
    if not len(hot):
        return []
    clauses = np.concatenate([[0], np.cumsum(_CLAUSE[words.data])])
    step, emit = grammar_machine()
    out = []
    for d in hot.tolist():
        a, b = words.first[d], words.first[d + 1]
        at = np.flatnonzero(symbol[a:b]) + a
        found, state, clause, before = 0, 0, None, 0
        for place, sym, number in zip(at.tolist(), symbol[at].tolist(), clauses[words.starts[at]].tolist()):
            # words without a symbol between two others; more than a negation reaches make no difference
            reads = [END] if number != clause else [NONE] * min(place - before - 1, SCOPE)
            for x in (*reads, sym):
                found |= emit[state][x]
                state = step[state][x]
            clause, before = number, place
        found |= emit[state][END]
        if found:
            out.append((d, tuple(k for k in range(len(PATTERNS)) if found >> k & 1)))
    return out


class Grammar(NamedTuple):
    lexicon: Lexicon
    share: np.ndarray  # of each pattern
    none: float  # of a document without any

    def score(self, found: tuple[int, ...]) -> float:
        return float(1 - (1 - self.none) * np.prod(1 - self.share[list(found)]))


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(text, toxic) of a bounded sample; of texts of one label that share two of six min-hashes in a row one stays, so copies count once."""
    rows = labels.filter(F.col(label).isNotNull()).select(F.col(key).alias("key"), (F.col(label) == 1).alias("toxic"))
    picked = bounded_sample(rows.filter("toxic"), "toxic", TOXIC_SAMPLE, 1).unionByName(bounded_sample(rows.filter("NOT toxic"), "toxic", OTHER_SAMPLE, 1))
    # bounded by the sample, so it may be sent to every task
    found = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).filter("text IS NOT NULL").join(F.broadcast(picked), F.col("doc") == F.col("key"))
    # few rows of many partitions: put together, they are few files
    found = bounded_sample(materialise(found.select("text", "toxic").hint("rebalance")), "toxic", TOXIC_SAMPLE + OTHER_SAMPLE, 2, "text", 2 * SAMPLE_CHARS, SAMPLE_CHARS)
    bands = ["a", "b", "c"]

    def mark(batches):
        for batch in batches:
            for lo, hi, words in W.pieces(batch.column(0), lower=True):
                doc, value = shingles(words, 5)
                low = np.zeros((6, hi - lo), np.uint64)
                at = np.flatnonzero(np.diff(doc, prepend=-1)) if len(doc) else np.zeros(0, np.int64)
                for k in range(6):
                    if len(at):
                        low[k, doc[at]] = np.minimum.reduceat(W.mix(value + W.U64(k)), at)
                both = W.mix(low[::2] * W.U64(W.WORD_BASE) + low[1::2])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *[pa.array(x.view(np.int64)) for x in both]], ["text", "toxic", *bands])

    marked = found.select("text", "toxic").mapInArrow(tidy(mark), "text string, toxic boolean, a long, b long, c long")
    for name in bands:  # the smallest text of each, so that reruns agree
        marked = marked.groupBy(name, "toxic").agg(F.min(F.struct("text", *[c for c in bands if c != name])).alias("one")).select("one.*", name, "toxic")
    return marked.select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Grammar:
    """Lexicon and weights from a bounded sample of labelled documents, whole texts. Without labels the given words and priors stay.

    Rows with a null key, label or text are left out; repeated labels count once, documents with one key each; texts of 65,536 characters or more
    are left to labels that have no shorter ones; of near copies the smallest text counts; empty tables leave what is given; other columns aren't read.
    """
    bounded_batches(docs)
    sample = materialise(_sample(docs, labels, key, text, label))
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, other = totals.get(True, 0), totals.get(False, 0)

    def count(batches):
        for batch in batches:
            flags = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, _, words in W.pieces(batch.column(0), W.NOT_ALNUM, lower=True):
                doc = words.docs()
                for length, at, h in beginnings(words, range(SHORTEST, LONGEST + 1)):
                    order = np.lexsort((doc[at], h))
                    h, d = h[order], doc[at][order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                    h, d = h[new], d[new]
                    keys, of = np.unique(h, return_inverse=True)
                    bad = np.bincount(of, flags[lo + d], minlength=len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), length)), pa.array(keys.view(np.int64)), pa.array(bad), pa.array(np.bincount(of, minlength=len(keys)).astype(np.int64))], ["length", "h", "bad", "n"])

    counted = sample.mapInArrow(tidy(count), "length long, h long, bad long, n long").groupBy("length", "h").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    counted = materialise(counted)
    lengths: dict[int, list[int]] = {}
    if toxic and other:
        tried, base = counted.count(), toxic / (toxic + other)
        share = F.col("bad") / F.col("n")
        rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
        # n times the divergence of the share from the base rate bounds the log of the chance
        sure = F.col("n") * (share * F.log(share / base) + rest) > float(np.log(tried) + 4)
        best = counted.filter(((F.col("bad") + 1) / (F.col("n") + 1) > 0.95) & sure)
        for r in best.collect():
            lengths.setdefault(r["length"], []).append(r["h"])
    found = sorted(lengths)
    lexicon = given(tuple(found), tuple(np.sort(np.array(lengths[n], np.int64).view(W.U64)) for n in found))
    return _weigh(sample, lexicon, toxic, other)


def _weigh(sample: DataFrame, lexicon: Lexicon, toxic: int, other: int) -> Grammar:
    """Share of toxic documents for each pattern, counting a document for the pattern that tells most by the priors."""
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for batch in batches:
            flags = batch.column(1).to_pylist()
            rows = []
            for lo, _, words in W.pieces(batch.column(0), W.NOT_ALNUM, lower=True):
                rows += [(max(found, key=lambda p: PRIOR[p]), int(flags[lo + d])) for d, found in patterns(words, shared.value)]
            if rows:
                pattern, bad = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(pattern, pa.int64()), pa.array(bad, pa.int64())], ["pattern", "bad"])

    share, with_any = PRIOR * PRIOR_COUNT, np.zeros(2)
    total = np.full(len(PATTERNS), PRIOR_COUNT)
    for r in sample.mapInArrow(tidy(run), "pattern long, bad long").groupBy("pattern").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect():
        share[r["pattern"]] += r["bad"]
        total[r["pattern"]] += r["n"]
        with_any += r["bad"], r["n"]
    none = (toxic - with_any[0] + NONE_PRIOR * PRIOR_COUNT) / (toxic + other - with_any[1] + PRIOR_COUNT)
    return Grammar(lexicon, share / total, min(float(none), 0.4))


def score(docs: DataFrame, grammar: Grammar, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with score (0 to 1), predicted (1 if it is 0.5 or more) and the names of the patterns found.

    Null and empty texts have no pattern and get the score of a document without
    any. Texts of any length are read whole; repeated rows are scored alike; an empty table gives no rows; other columns
    pass through and those named as new ones are replaced, the text too.
    """
    new = {"score": T.DoubleType(), "predicted": T.IntegerType(), "patterns": T.ArrayType(T.StringType())}
    keep = passing(docs, new, None if keep_text else text)
    docs = docs.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(k, v) for k, v in new.items()])
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches):
        grammar = shared.value
        for batch in batches:
            values, names = np.full(batch.num_rows, grammar.none), [[] for _ in range(batch.num_rows)]
            for lo, _, words in W.pieces(batch.column(text), W.NOT_ALNUM, lower=True):
                for d, found in patterns(words, grammar.lexicon):
                    values[lo + d], names[lo + d] = grammar.score(found), [PATTERNS[p] for p in found]
            made = [pa.array(values), pa.array((values >= 0.5).astype(np.int32)), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], schema.fieldNames())

    return bounded_batches(docs).mapInArrow(tidy(run), schema)
