"""Audits: choosing examples, and comparing diagnostics of two states of one population."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import json_array_col, json_string_col

#: Kinds that are always taken whole, kinds that only define others, the beginnings of ids of diagnostics that say a profile is not known.
WHOLE_KINDS = ("Bundle", "Patient", "Observation")
DEFINING_KINDS = ("CodeSystem", "ValueSet", "ConceptMap", "StructureDefinition", "SearchParameter", "OperationDefinition")
UNKNOWN_PROFILE = "VALIDATION_VAL_PROFILE_UNKNOWN"
SERIOUS = ("error", "fatal")


def multiset_difference(post: DataFrame, pre: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and n: how often a row of `post` occurs more often than in `pre`. Both shrink to counts before they meet; nulls are equal."""
    counts = lambda df, sign: df.groupBy(*keys).agg((sign * F.count("*")).alias("n"))
    return counts(post, F.lit(1)).unionByName(counts(pre, F.lit(-1))).groupBy(*keys).agg(F.sum("n").alias("n")).filter("n > 0")


def scrubbed(path: Column) -> Column:
    """A path of a diagnostic without the ids of contained resources that stand in its comments."""
    return F.regexp_replace(path, r"/\*([A-Z][A-Za-z0-9]*)/[A-Za-z0-9.\-]+\*/", r"/*$1*/")


def issue_key(severity: Column, code: Column, paths: Column, ids: Column, text: Column) -> Column:
    """What makes diagnostics alike, as canonical JSON: severity, code, paths without changing ids, and the message's ids or else its text."""
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, json_string_col), ","), F.lit("]"))
    orphan = lambda c: F.coalesce(json_string_col(c), F.lit("null"))
    message = F.when(F.size(ids) > 0, listed(ids)).otherwise(json_string_col(F.coalesce(text, F.lit(""))))
    return json_array_col(orphan(severity), orphan(code), listed(F.transform(F.coalesce(paths, F.array().cast("array<string>")), scrubbed)), message)


def compare(before: DataFrame, after: DataFrame, unit: str = "file", severity: str = "severity", key: str = "key") -> DataFrame:
    """(unit, before_errors, after_errors, new_errors, before_warnings, after_warnings) of diagnostics (unit, severity, key), new_errors counting those of `after` beyond `before`'s, repeats too."""
    serious = lambda df: df.filter(F.col(severity).isin(*SERIOUS))
    new = multiset_difference(serious(after), serious(before), [unit, key]).groupBy(unit).agg(F.sum("n").alias("new_errors"))
    count = lambda df, name: df.groupBy(unit).agg(F.count_if(F.col(severity).isin(*SERIOUS)).alias(f"{name}_errors"), F.count_if(F.col(severity) == "warning").alias(f"{name}_warnings"))
    both = count(before, "before").join(count(after, "after"), unit, "full").join(new, unit, "left")
    return both.select(unit, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("before_errors", "after_errors", "new_errors", "before_warnings", "after_warnings")])


def select_examples(examples: DataFrame, name: str = "name", kind: str = "kind", preferred: Column | None = None, whole: Sequence[str] = WHOLE_KINDS) -> DataFrame:
    """Examples chosen before anything is known of them: all of some kinds, of each other kind the preferred one or else the first by name.

    By default `package/<kind>-example.json` is preferred.
    """
    preferred = F.col(name) == F.concat(F.lit("package/"), kind, F.lit("-example.json")) if preferred is None else preferred
    rank = F.struct((~preferred).alias("other"), F.col(name).alias(name))
    others = examples.filter(~F.col(kind).isin(*whole)).groupBy(kind).agg(F.min(rank)[name].alias(name))
    return examples.filter(F.col(kind).isin(*whole)).select(kind, name).unionByName(others)


def sample_for_validation(roots: DataFrame, case: str = "case", name: str = "name", kind: str = "kind") -> DataFrame:
    """All roots but those of defining kinds, of which each case has its first by name."""
    first = roots.filter(F.col(kind).isin(*DEFINING_KINDS)).groupBy(case, kind).agg(F.min(name).alias(name))
    return roots.filter(~F.col(kind).isin(*DEFINING_KINDS)).select(case, kind, name).unionByName(first)


def invalid_id(own: Column) -> Column:
    """Is an id, where there is one, not a valid one?"""
    return own.isNotNull() & ~own.rlike(r"\A[A-Za-z0-9.\-]{1,64}\z")


def patient_id(literal: Column) -> Column:
    """The id in an exact relative reference to a patient, else null."""
    return F.when(literal.startswith("Patient/") & (F.length(F.regexp_replace(literal, "[^/]", "")) == 1), F.substring(literal, 9, 1 << 30))


def unknown_profile(ids: Column) -> Column:
    """Does a diagnostic say that a profile wasn't there to check against?"""
    return F.exists(ids, lambda x: x.startswith(UNKNOWN_PROFILE))
