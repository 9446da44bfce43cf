"""Iterative graph operators: ownership by fixpoint, and peeling of hierarchies.

Each round writes its frontier to the shared folder and reads it back, so plans
stay short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise
from . import hot


def ownership(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """All (node, owner) that follow from seeds (node, owner) along edges (provider, dependent).

    Owners spread until no set grows; cycles end because a pair is only followed once.
    """
    edges = materialise(edges.select("provider", "dependent").distinct())
    spread = hot.joiner(edges, [("provider", "node")], unique=False, by=["dependent"])  # a provider may have most of the dependents
    known = materialise(seeds.select("node", "owner").distinct())
    frontier, rounds = known, [known]
    while True:
        reached = spread(frontier).select(F.col("dependent").alias("node"), "owner").distinct()
        frontier = materialise(reached.join(known, ["node", "owner"], "left_anti"))
        if frontier.limit(1).isEmpty():
            return known
        rounds.append(frontier)
        known = rounds[0]
        for part in rounds[1:]:
            known = known.unionByName(part)
        if len(rounds) >= 8:
            known = materialise(known)
            rounds = [known]


def unique_owner(owned: DataFrame) -> DataFrame:
    """(node, owners, owner): how many owners a node has, and which, if it is one."""
    return owned.groupBy("node").agg(F.count("*").alias("owners"), F.min("owner").alias("low")).select("node", "owners", F.when(F.col("owners") == 1, F.col("low")).alias("owner"))


def tangled(parents: DataFrame) -> DataFrame:
    """(node) that lie in a cycle of (child, parent) or below one.

    Nodes of one parent are taken past by doubling: each points to its parent, then to what that points to, and so on, until it points to
    a node of no parent or of several, or has gone further than there are nodes, and so around. A chain of n takes about log2(n) rounds. What is left,
    nodes of several parents, is peeled level by level. No side of a join is broadcast, as every round would send it through the driver.
    """
    if parents.isEmpty():
        return parents.select(F.col("child").alias("node"))
    parents = materialise(parents.select("child", "parent").distinct())
    counted = materialise(parents.groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("to")))
    single = counted.filter("n = 1").select(F.col("child").alias("node"), "to")
    pointers, n = materialise(single), single.count()
    for _ in range(n.bit_length()):
        further = pointers.select(F.col("node").alias("own"), F.col("to").alias("next"))
        pointers = materialise(hot.join(pointers, further, [("to", "own")], "left", unique=True, shuffled=True).select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        moving = not pointers.filter("moved").limit(1).isEmpty()
        pointers = pointers.drop("moved")
        if not moving:
            break
    ends = hot.join(pointers, single.select(F.col("node").alias("own"), F.lit(True).alias("around")), [("to", "own")], "left", unique=True, shuffled=True)
    ends = materialise(ends.select("node", "to", F.coalesce("around", F.lit(False)).alias("around")))
    around = ends.filter("around").select("node")
    several = counted.filter("n > 1").select("child")
    if several.limit(1).isEmpty():
        return around
    # what nodes of several parents come to; one that comes to a cycle stays its own parent for good
    led = hot.join(parents.join(several.hint("merge"), "child", "left_semi"), ends.select(F.col("node").alias("own"), "to", "around"), [("parent", "own")], "left", unique=True, shuffled=True)
    led = led.select("child", F.when(F.col("around"), F.col("child")).otherwise(F.coalesce("to", "parent")).alias("parent"))
    stuck = materialise(_peeled(led))
    below = ends.filter("NOT around").join(stuck.select(F.col("node").alias("own")).hint("merge"), F.col("to") == F.col("own"), "left_semi").select("node")
    return around.unionByName(stuck).unionByName(below)


def _peeled(parents: DataFrame) -> DataFrame:
    """(node) of what is left when nodes without parents are peeled off, level by level."""
    parents = materialise(parents.distinct())
    nodes = parents.select(F.col("child").alias("node")).unionByName(parents.select(F.col("parent").alias("node"))).distinct()
    frontier = materialise(nodes.join(parents.hint("merge"), F.col("node") == F.col("child"), "left_anti"))
    left, gone = parents, frontier
    while not frontier.limit(1).isEmpty():
        off = left.join(frontier.hint("merge"), F.col("parent") == F.col("node"), "left_semi")
        left = materialise(left.join(frontier.hint("merge"), F.col("parent") == F.col("node"), "left_anti"))
        frontier = materialise(off.select(F.col("child").alias("node")).distinct().join(left.hint("merge"), F.col("node") == F.col("child"), "left_anti"))
        gone = materialise(gone.unionByName(frontier).distinct())
    return nodes.join(gone.hint("merge"), "node", "left_anti")
