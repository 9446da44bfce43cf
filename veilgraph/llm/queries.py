"""The registered queries of this subpackage; SQL equivalents are in `oracles`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, window=35, key="doc_id").select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import Rule, judge

    rules = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fractions import Fraction

    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), Fraction(85, 100))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens, vocabulary_from_file

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, vocabulary_from_file(), keep_text=False).select("doc_id", "n_tokens")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity
    from .sampling import fold

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grammar = toxicity.learn(docs, labels.filter(fold("doc_id", 5) != 0))
    rows = docs.select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out"))
    return toxicity.score(rows, grammar, keep_text=False).select("doc_id", "held_out", "score", "predicted")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid
    from .sampling import fold

    docs = table(spark, sf_dir, "documents")
    model = langid.learn(langid.training_rows(docs, folds=4, held_out=2))
    rows = docs.select("doc_id", "text", (fold("doc_id", 4) == 2).alias("held_out"))
    return langid.identify(rows, model, keep_text=False).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, weights=(1, 2, 3), repeats=3).select("doc_id", "size", "source_size", "target", "taken")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import top_k

    return top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, size=2048, file="byte_bpe_50k.json", end=0).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .variants import group_variants

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return group_variants(docs, shortest=5, least=3, times=2, every=97)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"), least=3, top=200, scale=1_000_000_000)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_url_filter, op3_minhash_near_dedup, op4_token_counts, op5_decontamination, op6_toxicity, op7_language_id, op8_license_scan, op9_mixing, op10_exact_top_k, op11_best_fit_packing, op12_spelling_variants, op13_source_divergence)}
