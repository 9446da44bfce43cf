"""Joins of which one key has most of the rows, without adaptive execution."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgraph.operators import graph, hot, references

MILLION = 1_000_000


@pytest.fixture
def plain(spark, monkeypatch):
    """No adaptive execution, no broadcast by size, and no table that counts as small."""
    monkeypatch.setattr(hot, "SMALL", 0)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def per_task(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def even(df):
    sizes = per_task(df)
    assert sizes[-1] < 2 * sizes[len(sizes) // 2], sizes


def test_sketches():
    for seed in range(30):
        draw = random.Random(seed)
        keys = [draw.choice([1, 1, 1, 2, draw.randrange(1000)]) for _ in range(3000)]
        most, counts = draw.choice([1, 3, 10, 5000]), Counter(keys)
        parts = [hot.Sketch(most) for _ in range(3)]
        for k, part in enumerate(parts):
            for at in range(k * 1000, k * 1000 + 1000, 170):
                part.add(np.array(keys[at : min(at + 170, k * 1000 + 1000)], np.int64))
        whole = hot.Sketch(most)
        for part in parts:
            whole.merge(part.keys, part.counts)
        found = dict(zip(whole.keys.tolist(), whole.counts.tolist()))
        assert len(found) <= most
        for key, n in counts.items():
            assert n - 3000 / (most + 1) <= found.get(key, 0) <= n


def test_hot_keys_are_found(plain):
    df = plain.range(MILLION).select(F.when(F.col("id") % 10 < 9, F.lit("Organization/1")).otherwise(F.concat(F.lit("Patient/"), "id")).alias("k"))
    (one,) = hot.hot_keys(df, F.xxhash64("k"), 8)
    assert one[0] == df.filter("k = 'Organization/1'").select(F.xxhash64("k")).first()[0] and 800_000 <= one[1] <= 900_000
    assert hot.hot_keys(plain.range(1000), F.xxhash64("id"), 8) == [] and hot.hot_keys(plain.range(0), F.xxhash64("id"), 8) == []


@pytest.mark.parametrize("unique", [True, False])
def test_one_key_in_nine_of_ten_rows(plain, tmp_path, unique):
    many = plain.range(MILLION).select("id", F.when(F.col("id") % 10 < 9, F.lit(-1)).when(F.col("id") % 100 == 99, F.lit(None)).otherwise(F.col("id")).alias("k"))
    few = plain.range(MILLION).filter("id % 10 = 9").select(F.when(F.col("id") == 9, F.lit(-1)).when(F.col("id") == 99, F.lit(None)).otherwise(F.col("id")).alias("own"), F.col("id").alias("value"))
    joined = hot.join(many, few, [("k", "own")], "left", unique=unique, by=["id"])
    assert joined.columns == ["id", "k", "value"] and joined.count() == MILLION
    expected = many.join(few, F.col("k").eqNullSafe(F.col("own")), "left").drop("own")
    key = lambda df: df.agg(F.count("value"), F.sum(F.xxhash64("id", "k", "value").cast("decimal(30,0)"))).first()
    assert tuple(key(joined)) == tuple(key(expected))
    if unique:  # what is hot stays in the tasks that have read it, the rest is shuffled: each even in itself
        even(joined.filter("k = -1"))
        even(joined.filter("k <> -1"))
        assert max(per_task(joined)) < 2 * MILLION / 8
    else:
        even(joined)


def test_one_literal_in_nine_of_ten_edges(plain):
    edges = plain.range(MILLION).select(F.col("id").alias("edge"), F.when(F.col("id") % 10 < 9, F.lit("Organization/1")).otherwise(F.concat(F.lit("Patient/p"), F.col("id") % 1000)).alias("alias"), F.lit("source:1").alias("context"), F.lit(None).cast("string").alias("version"))
    known = plain.range(1000).select(F.concat(F.lit("Patient/p"), "id").alias("alias"), F.lit("source:1").alias("context"), F.lit(None).cast("string").alias("version"), F.col("id").alias("resource"))
    known = known.unionByName(plain.createDataFrame([("Organization/1", "source:2", None, 5000)], known.schema))
    found = references.resolve_relative(edges, known)
    assert {tuple(r) for r in found.groupBy("status", F.col("target") == 5000, "n_targets").count().collect()} == {("resolved", True, 1, 900_000), ("resolved", False, 1, 100_000)}
    even(found.filter("target = 5000"))
    even(found.filter("target <> 5000"))


def test_an_owner_of_nearly_all(plain):
    seeds = plain.createDataFrame([(0, 1), (0, 2), (7, 3)], "node long, owner long")
    edges = plain.range(10, 200_010).select(F.when(F.col("id") % 10 < 9, F.lit(0)).otherwise(F.lit(7)).cast("long").alias("provider"), F.col("id").alias("dependent"))
    owned = graph.unique_owner(graph.ownership(seeds, edges))
    assert {tuple(r) for r in owned.groupBy("owners", "owner").count().collect()} == {(2, None, 180_001), (1, 3, 20_001)}
