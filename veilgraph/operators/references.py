"""Resolution of scoped references by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise
from . import hot


def resolve_relative(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """(status, target, n_targets) and their other columns for edges (..., alias, context, version) against aliases (alias, context, version, resource).

    An alias of the edge's own context wins over others, whatever its version: where the
    context knows the alias at all, other contexts are not searched. Of what is
    searched, one distinct resource of the wanted version (any, if null) resolves the
    edge, none leaves it unresolved, several make it ambiguous.

    Aliases are counted first by what they can be asked for: in their context and in all, in their
    version and in any. So each question meets one row by equality, and an alias that stands in
    very many contexts is a count, never pairs.
    """
    own = F.struct(F.col("context").alias("within"), F.col("version").alias("of"))
    anywhere = lambda kind: F.lit(None).cast(kind)
    kinds = aliases.schema["context"].dataType, aliases.schema["version"].dataType
    asked = [own, F.struct(F.col("context").alias("within"), anywhere(kinds[1]).alias("of")), F.struct(anywhere(kinds[0]).alias("within"), F.col("version").alias("of")), F.struct(anywhere(kinds[0]).alias("within"), anywhere(kinds[1]).alias("of"))]
    # rows without a version answer questions for any only, once
    as_asked = F.when(F.col("version").isNull(), F.array(asked[1], asked[3])).otherwise(F.array(*asked))
    answers = aliases.select("alias", "resource", F.explode(as_asked).alias("q")).select("alias", "q.within", "q.of", "resource").distinct()
    answers = materialise(answers.groupBy("alias", "within", "of").agg(F.count("*").alias("n"), F.min("resource").alias("low")))  # it is read twice

    def meet(questions: DataFrame, within: str, of: str, *keep: str) -> DataFrame:
        a = answers.select(F.col("alias").alias("a_alias"), F.col("within").alias("a_within"), F.col("of").alias("a_of"), *keep)
        same = (F.col("alias") == F.col("a_alias")) & F.col(within).eqNullSafe(F.col("a_within")) & F.col(of).eqNullSafe(F.col("a_of"))
        return questions.join(a, same, "left").drop("a_alias", "a_within", "a_of")

    # distinct literals meet the answers, however often they are used: is the alias known in its own context?
    wanted = edges.select("alias", "context", "version").distinct().withColumn("any", anywhere(kinds[1]))
    wanted = meet(wanted, "context", "any", F.col("n").alias("local")).withColumn("scope", F.when(F.col("local").isNotNull(), F.col("context")))
    found = meet(wanted, "scope", "version", "n", "low").select(F.col("alias").alias("fa"), F.col("context").alias("fc"), F.col("version").alias("fv"), F.coalesce("n", F.lit(0).cast("long")).alias("n_targets"), "low")
    status = F.when(F.col("n_targets") == 1, "resolved").when(F.col("n_targets") == 0, "unresolved").otherwise("ambiguous")
    # one literal may stand in most of the edges
    met = hot.join(edges, found, [("alias", "fa"), ("context", "fc"), ("version", "fv")], unique=True)
    return met.select(*[c for c in edges.columns if c not in ("alias", "context", "version")], status.alias("status"), F.when(F.col("n_targets") == 1, F.col("low")).alias("target"), "n_targets")
