"""Token counts with a unigram vocabulary: Viterbi that carries just the best score and its piece count.

An Aho-Corasick automaton over the vocabulary enumerates, place by place, all
pieces that end there.  Of the segmentations up to a place the one with the highest score
stays; of equal ones the one whose last piece is longest, as the tokenizers decide
it: they extend from each start in order and replace on strictly higher scores only.
A character that is no piece itself counts as unknown at a penalty below the lowest
score, or as its UTF-8 bytes where the vocabulary falls back to bytes.

Where no piece has a space after another character, texts fall apart into
chunks (spaces and what follows) that are segmented one by one; each task remembers
the counts of a bounded number of chunks.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches, passing, tidy

SPACE = "▁"
#: Below the lowest score, for an unknown character.
UNKNOWN_PENALTY = 10.0
#: Chunks that a task remembers, and the longest of them.
REMEMBERED, LONGEST = 400_000, 48
DEFAULT_FILE = "/opt/tokenizers/piece_bpe_32k.model"


class Vocabulary(NamedTuple):
    pieces: tuple[tuple[str, float], ...]
    byte_fallback: bool
    prefix: bool = True  # texts begin with a space


def vocabulary_from_file(path: str = DEFAULT_FILE) -> Vocabulary:
    """Pieces and scores of a piece file; control, unknown, unused and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    return Vocabulary(tuple((model.id_to_piece(i), float(model.get_score(i))) for i in ids), any(model.is_byte(i) for i in range(model.get_piece_size())))


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.byte_fallback, self.prefix = vocabulary.byte_fallback, vocabulary.prefix
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.usable = len(self.automaton) > 0
        if self.usable:
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in vocabulary.pieces)
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$").findall
        self.known: dict[str, int] = {}

    def best(self, text: str) -> int:
        """Pieces of the best segmentation."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        matches = self.automaton.iter(text) if self.usable else iter(())
        end, value = next(matches, (n, None))
        unknown, single = self.unknown, False
        for i in range(n):
            top, pieces, single = None, 0, False
            while end == i:
                length, s = value
                start = i + 1 - length
                s += score[start]
                single |= length == 1
                # longest first: a later one must be better to count
                if top is None or s > top:
                    top, pieces = s, count[start] + 1
                end, value = next(matches, (n, None))
            if not single:
                s = score[i] + unknown
                if top is None or s > top:
                    top, pieces = s, count[i] + (len(text[i].encode("utf-8", "replace")) if self.byte_fallback else 1)
            score[i + 1], count[i + 1] = top, pieces
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        if self.prefix:
            text = SPACE + text
        if not self.apart:
            return self.best(text)
        known, total = self.known, 0
        for chunk in self.chunks(text):
            n = known.get(chunk)
            if n is None:
                n = self.best(chunk)
                if len(chunk) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[chunk] = n
            total += n
        return total


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with n_tokens, the pieces of each whole text.

    Null and empty texts have 0; unknown characters count one each, or their bytes
    with byte fallback; texts of any length count whole; ties go as the module says; repeated rows count alike; an empty table gives no rows; other
    columns pass through and one named n_tokens is replaced, the text too.
    """
    keep = passing(docs, ["n_tokens"], None if keep_text else text)
    docs = docs.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType())])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        counter = Counter(shared.value)
        for batch in batches:
            column = batch.column(text)
            n = pa.array((counter.count(column[i].as_py()) for i in range(len(column))), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], n], schema.fieldNames())

    return bounded_batches(docs).mapInArrow(tidy(run), schema)


def vocabulary(pieces: Sequence[tuple[str, float]], byte_fallback: bool = False, prefix: bool = True) -> Vocabulary:
    return Vocabulary(tuple(pieces), byte_fallback, prefix)
