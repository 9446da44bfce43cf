"""Mixing sources to target weights by weighted fair queueing.

Each source sends its documents in a shuffled order, up to `repeats` times over.
A document's virtual finish time is what its source has sent up to its end,
divided by the source's target; the queue serves by virtual finish time and
stops at the total budget.  All ordering is distributed: a source's order is cut
into hash buckets whose sums are added up first, so no source needs to fit in a
task, and the range sort over finish times adds up buckets of time and orders
just the one bucket in which the budget ends.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.ranks import numbered
from . import words as W
from .common import bounded_batches, fresh, materialise, passing, tidy, unpack

#: Buckets of virtual time for each unit of it, and the last unit that is told apart.
TIME_BUCKETS, TIME_END = 4096, 4
#: The bucket in which the budget ends is parted further, at most so often, until it has no more rows than one task orders well.
DEEPEST, EDGE_ROWS = 4, 100_000


def with_sizes(docs: DataFrame, size: str, text: str, packed: bool) -> DataFrame:
    """docs with the number of words of `text` as column `size` (null: 0), and the text compressed or left out."""
    keep = [f for f in docs.schema if packed or f.name != text]
    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == text else f.dataType, f.nullable) for f in keep] + [T.StructField(size, T.LongType())])

    def count(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = batch.column(text)
            found = [w.counts() for _, _, w in W.pieces(texts)]
            n = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())
            small = pa.array((None if x is None else squeeze(x.encode()) for x in texts.to_pylist()), pa.binary()) if packed else None
            yield pa.RecordBatch.from_arrays([*[small if f.name == text else batch.column(f.name) for f in keep], n], schema.fieldNames())

    return bounded_batches(docs).mapInArrow(tidy(count), schema)


def _targets(sizes: DataFrame, key: str, source: str, weights: Sequence[float], cap: float) -> DataFrame:
    """A row for each source, (key, source_size, target).

    Targets are min(cap * size, share * weight), with one share for all such that they sum to the total. The
    share is found by filling up: what capped sources leave over is shared out again, until none is above its cap.
    Each round is one aggregate, so that there may be as many sources as hosts.
    """
    place, absent = fresh([key, source, "total"], "place", "absent")
    rows = numbered(sizes.withColumn(absent, F.col(source).isNull()), [absent, source], place)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = materialise(rows.select(key, F.col("total").alias("source_size"), weight.alias("weight"), (F.col("total") * F.lit(float(cap))).alias("most")))
    total, capped, share = rows.agg(F.sum("source_size")).first()[0] or 0, -1, 0.0
    while True:
        open_ = F.col("most") >= F.lit(share) * F.col("weight")
        r = rows.agg(F.sum(F.when(~open_, F.col("most"))).alias("full"), F.sum(F.when(open_, F.col("weight"))).alias("weight"), F.count_if(~open_).alias("capped")).first()
        if r["capped"] == capped or not r["weight"]:
            break
        capped, share = r["capped"], (total - (r["full"] or 0.0)) / r["weight"]
    return rows.select(key, "source_size", F.least("most", F.lit(share) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), repeats: int = 3, seed: int = 0, source: str = "source", text: str = "text", key: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """docs with size, source_size, target and taken: how many of its words the mix takes, repeats counted.

    Sources, ordered by code point and null last, weigh `weights`, repeating; they
    share the words of all documents, each up to `repeats` times its own. Reruns agree.

    Null or empty texts have size 0 and are never taken; a null source is a source; texts of any length count whole;
    documents are shuffled by a hash of key and text, so null and repeated keys are spread like others;
    rows equal in key and text take distinct places; an empty table
    gives no rows; other columns pass through, whatever their names, and those named as new ones are replaced, inputs too.
    """
    new = ("size", "source_size", "target", "taken")
    keep = passing(docs, new, None if keep_text else text)
    names = [*docs.columns, *new, "turn", "slot", "time", "n"]
    src, own, body, h, b, upto, start, to, of, bucket = fresh(names, "src", "own", "body", "h", "b", "upto", "start", "to", "of", "bucket")
    packed = text in keep
    label = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    tie = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    name = F.col(source)
    sized = docs.select(*[F.col(c) for c in keep if c != text], F.col(text).alias(body), label.alias(src), name.alias(own), F.substring(F.md5(tie), 1, 16).alias(h), F.col(key).cast("string").alias(of))
    sized = materialise(with_sizes(sized, "size", body, packed))
    rows = sized.count()
    n = max(1, int(rows**0.5))
    sized = sized.withColumn(b, F.floor(F.conv(F.substring(h, 1, 8), 16, 10).cast("double") * (n / 2**32)))

    sizes = materialise(sized.groupBy(src, own).agg(F.sum("size").alias("total")))
    targets = materialise(_targets(sizes, src, own, weights, repeats)).withColumnRenamed(src, to)
    sums = sized.groupBy(src, b).agg(F.sum("size").alias("n"))
    order = Window.partitionBy(src).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(src).alias(to), F.col(b).alias(bucket), F.coalesce(F.sum("n").over(order), F.lit(0)).alias(start))
    sums = sums.join(targets, to)

    within = Window.partitionBy(src, b).orderBy(h, of, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn(upto, F.sum("size").over(within))
    placed = placed.join(sums, (F.col(src) == F.col(to)) & (F.col(b) == F.col(bucket))).withColumn(upto, F.col(upto) + F.col(start))

    def finish(turn: Column) -> Column:
        return F.when(F.col("target") > 0, (turn * F.col("source_size") + F.col(upto)) / F.col("target"))

    def slot(time: Column, depth: int) -> Column:
        return F.floor(F.least(time, F.lit(float(TIME_END))) * float(TIME_BUCKETS**depth))

    # where the budget ends: the bucket of time, finer and finer, then the place within it
    ties = (src, h, of, "size")
    items = placed.filter(F.col("size") > 0).select(*ties, upto, "source_size", "target", F.explode(F.array(*[F.lit(i).cast("long") for i in range(repeats)])).alias("turn"))
    items = items.select(*ties, "turn", finish(F.col("turn")).alias("time"))
    # targets are sums of doubles: a hair's breadth must not cost the last document
    limit = (targets.agg(F.sum("target")).first()[0] or 0.0) * (1 + 1e-12)
    before, edge, depth = 0, None, 0
    while depth < DEEPEST:
        inside = items if edge is None else items.filter(slot(F.col("time"), depth) == edge["slot"])
        slots = inside.withColumn("slot", slot(F.col("time"), depth + 1)).groupBy("slot").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        slots = slots.select("slot", "n", "rows", F.sum("n").over(Window.orderBy("slot")).alias("upto"))
        found = slots.filter(F.col("upto") + before > limit).orderBy("slot").first()
        if found is None:
            break
        edge, depth, before = found, depth + 1, before + found["upto"] - found["n"]
        if found["rows"] <= EDGE_ROWS:
            break
    if edge is None:
        takes = lambda i: F.col("target") > 0
    else:
        place = ["time", *ties, "turn"]
        inside = items.filter(slot(F.col("time"), depth) == edge["slot"]).withColumn("n", F.sum("size").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        last = inside.filter(F.col("n") + before <= limit).orderBy(*[F.col(c).desc() for c in place]).select(*place).first()
        last_place = F.struct(*[F.lit(last[c]).cast(inside.schema[c].dataType).alias(c) for c in place]) if last else None

        def takes(i: int) -> Column:
            time = finish(F.lit(i))
            early = slot(time, depth) < edge["slot"]
            if last_place is None:
                return early
            mine = F.struct(time.alias("time"), *[F.col(c) for c in ties], F.lit(i).cast("long").alias("turn"))
            return early | ((slot(time, depth) == edge["slot"]) & (mine <= last_place))

    taken = sum((F.when(takes(i), F.col("size")).otherwise(F.lit(0)) for i in range(repeats)), F.lit(0)).cast("long")
    columns = [F.col(body).alias(c) if c == text else F.col(c) for c in keep]
    out = placed.select(*columns, "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), taken.alias("taken"))
    return unpack(out, text) if packed else out
