"""Bounded samples of labelled rows, and the held-out folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo `folds`; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


#: Texts below 2**SHORT characters are sampled; longer ones only where a label has no others.
SHORT = 16


def bounded_sample(rows: DataFrame, label: str, most: int, labels: int, text: str | None = None, chars: int = 0, each: int = 0) -> DataFrame:
    """About `most` rows of each label at most, repeated rows once; with `text`, of `each` characters a label and `chars` in all at most.

    Rows are chosen by a hash of all their columns: reruns agree, no label is gathered in a task, and
    neither a null nor a repeated key lets more in, as equal rows count once. Every label has a row at least. More than `labels` labels are an error.
    """
    # rows by label and order of length: one pass, a few dozen rows a label
    size = F.floor(F.log2(F.greatest(F.length(text), F.lit(1)))) if text else F.lit(0)
    sized = rows.withColumn("size", size.cast("int"))
    unit = F.pmod(F.xxhash64(F.lit("sample"), *rows.columns), F.lit(1 << 40)) / F.lit(float(1 << 40))
    found = sized.groupBy(label, "size").agg(F.count("*").alias("n"), F.min(unit).alias("least")).limit(32 * labels + 1).collect()
    names = sorted({r[label] for r in found})
    if len(names) > labels:
        raise ValueError(f"more than {labels} labels")
    parts = []
    for name in names:
        own = sorted((r["size"], r["n"], r["least"]) for r in found if r[label] == name)
        own = [x for x in own if x[0] < SHORT] or own[:1]
        n, long = sum(n for _, n, _ in own), sum(n << (s + 1) for s, n, _ in own)
        part = min(most / n, min(each, chars / len(names)) / long if text else 1.0)
        parts.append((name, own[-1][0], max(part, min(x for *_, x in own) + 2.0**-40)))  # one row at least
    # a row for each label, `labels` at most
    parts = rows.sparkSession.createDataFrame(parts, f"of_label {rows.schema[label].dataType.simpleString()}, top int, part double")
    picked = sized.join(F.broadcast(parts), F.col(label) == F.col("of_label")).filter((F.col("size") <= F.col("top")) & (unit < F.col("part")))
    return picked.select(*rows.columns).distinct()
