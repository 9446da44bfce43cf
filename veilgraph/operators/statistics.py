"""Exact weighted order statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import materialise

PERCENTS = (5, 25, 50, 75, 95)


def nearest_rank(frequencies: DataFrame, group: Sequence[str], order: Sequence[str], value: str, count: str, percents: Sequence[int] = PERCENTS, summed: bool = False) -> DataFrame:
    """Per group the count, minimum, maximum and nearest-rank quantiles of (value, count) rows.

    Ranks are ceilings in integers, (percent * n + 99) // 100. Frequencies are summed first, with map-side combining; then
    distinct values are cut into ranges, whose sums, a row each, tell what comes before, so that a group of very many
    values is no window of its own. summed: a table with one row for each value of a group.
    """
    columns = [*group, *dict.fromkeys([*order, value])]
    rows = frequencies.select(*columns, F.col(count).alias("_n")) if summed else materialise(frequencies.groupBy(*columns).agg(F.sum(count).alias("_n")))
    last = [F.col(c).asc_nulls_last() for c in order]  # what has no value counts, and has the highest ranks
    parted = materialise(rows.repartitionByRange(*group, *last).withColumn("_part", F.spark_partition_id()))
    sums, by = parted.groupBy(*group, "_part").agg(F.sum("_n").alias("_sum")), Window.partitionBy(*group)
    before = F.coalesce(F.sum("_sum").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(c).alias(f"_of_{c}") for c in group], F.col("_part").alias("_p"), before.alias("_before"), F.sum("_sum").over(by).alias("_all"))
    same = (F.col("_part") == F.col("_p")) & reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group))
    upto = F.sum("_n").over(Window.partitionBy(*group, "_part").orderBy(*last).rowsBetween(Window.unboundedPreceding, 0))
    running = parted.withColumn("_upto", upto).join(sums, same).withColumn("_upto", F.col("_upto") + F.col("_before"))
    alone = list(order) == [value]  # least and most of plain values need no sort, as those of structs do
    key = F.col(value) if alone else F.struct(*dict.fromkeys([*order, value]))
    told = lambda found: found if alone else found[value]
    picks = [told(F.min(F.when(F.col("_upto") >= F.floor((F.col("_all") * p + 99) / 100), key))).alias(f"p{p:02d}") for p in percents]
    return running.groupBy(*group).agg(F.first("_all").alias("n"), told(F.min(key)).alias("minimum"), told(F.max(key)).alias("maximum"), *picks)
