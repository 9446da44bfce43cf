"""License scan by diagonal voting.

Every document's rolling word k-grams are hashed and joined to the places of
the same k-grams in the templates.  A hit votes for the diagonal (document place minus
template place) that it lies on; votes are summed by diagonal, neighbouring
diagonals, which a word put in or left out makes, are merged, and the span that a
merged group covers is verified: its words are compared with the template's, in order.

Templates are few and given: `TEMPLATE_WORDS` bounds them, so their side of the join
is broadcast.  Of the documents' k-grams only those that pass a sieve of the
templates' hashes enter the join, which drops none that could join.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import words as W
from .common import bounded_batches, materialise, tidy

#: Words of all templates, at most.
TEMPLATE_WORDS = 200_000
#: Longest k-gram; shorter templates are one k-gram less a word, at least two words.
GRAM = 3
#: How far apart diagonals are merged, and the share of a template's k-grams that a span must hold.
NEAR, COVER = 3, 0.6
_SIEVE = 1 << 20


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    exact: bool  # only whole and consecutive counts

    @classmethod
    def of(cls, label: str, text: str, exact: bool = False) -> Template:
        words = W.split(*W.text_bytes(pa.array([text])), W.NOT_ALNUM, True)
        return cls(label, tuple(words.text(k) for k in range(len(words.starts))), exact)


#: The base phrases.
BASE = (Template.of("cc-by", "cc by", True), Template.of("gpl", "general public license", True), Template.of("reserved", "all rights reserved", True))
#: Wordings of public licenses and notices.
NOTICES = (
    Template.of("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template.of("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE 2.0"),
    Template.of("mit", "Released under the MIT License"),
    Template.of("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    Template.of("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template.of("gpl-notice", "This work is licensed under the GNU General Public License, version 3"),
    Template.of("gpl-notice", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template.of("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template.of("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template.of("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template.of("public-domain", "This is free and unencumbered software released into the public domain"),
)


def _width(template: Template) -> int:
    return max(1, min(GRAM, len(template.words) - 1 if len(template.words) > 2 else len(template.words)))


def _hashes(template: Template) -> np.ndarray:
    data = pa.array([" ".join(template.words)])
    return W.window_hashes(W.split(*W.text_bytes(data), W.NOT_ALNUM, True).hashes(), _width(template)) + W.U64(_width(template))


def _places(templates: Sequence[Template]) -> list[tuple[int, int, int]]:
    return [(int(h), i, place) for i, t in enumerate(templates) for place, h in enumerate(_hashes(t).view(np.int64))]


def hits(docs: DataFrame, templates: Sequence[Template], key: str, text: str) -> DataFrame:
    """(row, key, n_words, hits, packed) for each row of docs: its k-grams that pass the sieve, with their first word's place; the text, compressed, if there are any."""
    known = np.unique(np.array([h for h, _, _ in _places(templates)], np.int64).view(W.U64))
    sieve = np.zeros(_SIEVE, bool)
    sieve[known & W.U64(_SIEVE - 1)] = True
    widths = sorted({_width(t) for t in templates})
    shared = docs.sparkSession.sparkContext.broadcast(sieve)
    found = T.ArrayType(T.StructType([T.StructField("gram", T.LongType()), T.StructField("at", T.LongType())]))
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("hits", found), T.StructField("packed", T.BinaryType())])

    def grams(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for lo, hi, words in W.pieces(batch.column(1), W.NOT_ALNUM, lower=True):
                h, at_doc, at_word, found = words.hashes(), words.docs(), words.places(), []
                for width in widths:
                    values = W.window_hashes(h, width) + W.U64(width)
                    at = np.flatnonzero(shared.value[values & W.U64(_SIEVE - 1)] & W.window_fits(words, width))
                    found.append((at_doc[at], values[at].view(np.int64), at_word[at]))
                doc, gram, at = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(doc, kind="stable")
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=hi - lo))]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(gram[order]), pa.array(at[order])], ["gram", "at"])
                packed = [squeeze(words.data[a:b].tobytes()) if n else None for a, b, n in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), np.diff(offsets).tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(words.counts(), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pairs), pa.array(packed, pa.binary())], schema.fieldNames())

    return bounded_batches(docs).select(key, text).mapInArrow(tidy(grams), schema).withColumn("row", F.monotonically_increasing_id())


def spans(found: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(row, template, start, length, votes, grams, words, share): spans that hold enough of a template, `template` its number, by votes.

    Per row and template, diagonals no more than `NEAR` apart make one span: its start
    is the lowest diagonal, its votes are the template places voted for. An exact
    template has a span for each diagonal that all its k-grams vote for. A span is as long as
    the template, and more by as much as its diagonals lie apart.
    """
    if sum(len(t.words) for t in templates) > TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {TEMPLATE_WORDS} words")
    spark = found.sparkSession
    places = spark.createDataFrame(_places(templates), "gram long, template int, place long")
    facts = spark.createDataFrame([(i, len(t.words) - _width(t) + 1, len(t.words), t.exact) for i, t in enumerate(templates)], "number int, grams long, words long, exact boolean")
    # both sides are bounded by TEMPLATE_WORDS
    joined = found.select("row", F.explode("hits").alias("hit")).select("row", "hit.gram", "hit.at").join(F.broadcast(places), "gram")
    lines = joined.groupBy("row", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"))
    lines = lines.join(F.broadcast(facts), F.col("template") == F.col("number")).drop("number")
    exact = lines.filter(F.col("exact") & (F.size("places") == F.col("grams"))).select("row", "template", F.col("diagonal").alias("start"), F.col("words").alias("length"), F.col("grams").alias("votes"), "grams", "words")
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    loose = lines.filter(~F.col("exact")).withColumn("new", (F.col("diagonal") - F.lag("diagonal", 1, -(1 << 60)).over(order) > NEAR).cast("int"))
    loose = loose.withColumn("group", F.sum("new").over(order)).groupBy("row", "template", "group")
    loose = loose.agg(F.min("diagonal").alias("start"), F.max("diagonal").alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("votes"), F.first("grams").alias("grams"), F.first("words").alias("words"))
    loose = loose.select("row", "template", F.greatest("start", F.lit(0)).alias("start"), (F.col("words") + F.col("end") - F.greatest("start", F.lit(0))).alias("length"), "votes", "grams", "words")
    return exact.unionByName(loose).withColumn("share", F.col("votes") / F.col("grams")).filter(F.col("share") >= COVER)


def in_order(span: np.ndarray, template: np.ndarray) -> int:
    """The most words of the template that stand in the span in order: the length of a longest common subsequence."""
    best = np.zeros(len(span) + 1, np.int64)
    for word in template:
        best[1:] = np.maximum.accumulate(np.where(span == word, best[:-1] + 1, best[1:]))
    return int(best[-1])


def verified(found: DataFrame, spanned: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(row, template, start, length, share) of the spans whose words, compared one by one, hold enough of the template in order, all of an exact one.

    Only the texts with spans move; a text's spans are together, of which there are few a template.
    """
    own = spanned.groupBy("row").agg(F.collect_list(F.struct("template", "start", "length")).alias("spans"))
    rows = found.select("row", "packed").join(own, "row")
    schema = "row long, template int, start long, length long, share double"

    def run(batches):
        restore, words_of = zstandard.ZstdDecompressor().decompress, [np.array(t.words, object) for t in templates]
        for batch in batches:
            out = []
            for row, packed, spans in zip(*(batch.column(c) for c in ("row", "packed", "spans"))):
                words = W.split(*W.text_bytes(pa.array([restore(packed.as_py())], pa.large_binary()).cast(pa.large_string())), W.NOT_ALNUM, True)
                for s in spans.as_py():
                    span = np.array([words.text(k) for k in range(s["start"], min(s["start"] + s["length"], len(words.starts)))], object)
                    share = in_order(span, words_of[s["template"]]) / len(words_of[s["template"]])
                    if share >= (1 if templates[s["template"]].exact else COVER):
                        out.append((row.as_py(), s["template"], s["start"], s["length"], share))
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()))], ["row", "template", "start", "length", "share"])

    return rows.mapInArrow(tidy(run), schema)


def scan(docs: DataFrame, base: Sequence[Template] = BASE, notices: Sequence[Template] = NOTICES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs its key, n_words, n_base, first_word, last_word, base_labels, labels and score.

    n_base counts the places of base phrases, first_word and last_word are their smallest
    and largest start (else null); labels are distinct, sorted and comma-joined,
    base_labels those of base phrases only; score is the largest share of a template's words found in order, else 0.

    Words are runs of digits, letters and non-ASCII characters, lower-cased in A-Z. Null and
    empty texts have no words; texts of any length are scanned whole; rows without a find come back with 0 and empty labels; repeated rows
    and null keys are told apart by a row number; ties don't matter; an empty table gives no rows; other columns are left out, whatever their names.
    """
    templates = [*base, *notices]
    rows = materialise(hits(docs, templates, key, text))
    labels = F.array(*[F.lit(t.label) for t in templates])
    own = verified(rows, spans(rows, templates), templates).withColumn("label", labels[F.col("template")]).withColumn("base", F.col("template") < len(base))
    in_base = lambda c: F.when(F.col("base"), F.col(c))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    own = own.groupBy("row").agg(F.sum(F.col("base").cast("long")).alias("n_base"), F.min(in_base("start")).alias("first_word"), F.max(in_base("start")).alias("last_word"), joined(in_base("label")).alias("base_labels"), joined("label").alias("labels"), F.max("share").alias("score"))
    out = rows.select("row", "key", "n_words").join(own.withColumnRenamed("row", "of"), F.col("row") == F.col("of"), "left")
    return out.select(F.col("key").alias(key), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
