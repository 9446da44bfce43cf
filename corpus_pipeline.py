"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and reread before the next.  All but the last return the columns of documents.

All stages read whole texts of any length; an empty table stays one; extra columns pass through, whatever
their names; ties don't matter, so reruns agree.  What nulls and repeated rows give is said with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm import decontaminate, langid, mixing, neardup, substrings
from veilgraph.llm.common import fresh, materialise, table

#: SQL can express neither the language models nor the near-dedup; tests compare with brute force.
ORACLE_SQL = None


def put_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with new names for columns that have one of the names (without regard to case), and the new names."""
    clashing = [c for c in docs.columns if c.lower() in names]
    back = dict(zip(clashing, fresh([*docs.columns, *names], *[f"_{c}" for c in clashing])))
    return docs.withColumnsRenamed(back), back


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that are rejected go.

    Null and empty texts, and texts without a letter, go; a null language or key is no matter, such rows are judged like others;
    of repeated rows all stay or all go.
    """
    return langid.accepted(docs, langid.learn(langid.training_rows(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: similarity of five-word shingles of 0.8 or more.

    The smallest key stays; rows with a null key all stay, and so do documents without words; of rows with one key and text one stays.
    """
    return neardup.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows of 35 that stand elsewhere too; n_chars follows.

    Null texts become empty; white space collapses; of repeated rows every copy is cut.
    """
    aside, back = put_aside(docs, "n_words", "n_removed", "kept_sha256")
    cut = substrings.remove_repeats(aside, window=35, key="doc_id").select(*aside.columns)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return cut.select(*[F.col(back.get(c, c)).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Documents with a null or empty text stay; null items count for nothing; repeated rows stay or go alike.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: documents with size, source_size, target and taken (words, repeats counted).

    Documents without words are never taken; a null source is a source; null keys are ordinary; repeated rows take places of their own;
    columns of docs that have one of the four names pass through with a low line before it.
    """
    aside, _ = put_aside(docs, "size", "source_size", "target", "taken")
    return mixing.mix(aside, weights=(1, 2, 3), repeats=3, keep_text=True).filter("taken > 0")


STAGES = [
    ("language ID", identify_languages),
    ("near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
