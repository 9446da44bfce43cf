"""Consecutive numbers in a global order, without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import materialise


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the 1-based place of each row by `order`, as column `name`.

    Rows are range-partitioned and sorted; counts per partition, a row each, give where each begins.
    """
    part, place = f"_{name}_part", f"_{name}_place"
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialise(rows.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = rows.groupBy(part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(part).alias("_part"), before.alias("_before"))
    return rows.join(F.broadcast(starts), F.col(part) == F.col("_part")).withColumn(name, F.col("_before") + F.col(place) + 1).drop(part, place, "_part", "_before")
