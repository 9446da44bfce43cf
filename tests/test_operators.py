from decimal import Decimal

from veilgraph.functions.quantities import order_key
from veilgraph.operators import graph, ranks, references, statistics


def test_ownership_spreads_and_ends_in_cycles(spark):
    seeds = spark.createDataFrame([(1, 10), (2, 20)], "node long, owner long")
    edges = spark.createDataFrame([(1, 3), (3, 4), (4, 3), (2, 5), (1, 5)], "provider long, dependent long")
    out = {r["node"]: (r["owners"], r["owner"]) for r in graph.unique_owner(graph.ownership(seeds, edges)).collect()}
    assert out == {1: (1, 10), 2: (1, 20), 3: (1, 10), 4: (1, 10), 5: (2, None)}


def test_tangled_hierarchies(spark):
    parents = spark.createDataFrame([(2, 1), (3, 2), (5, 6), (6, 5), (7, 6), (7, 1)], "child long, parent long")
    assert sorted(r[0] for r in graph.tangled(parents).collect()) == [5, 6, 7]


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 AS x")
    rows = ranks.numbered(df, ["x"], "place").collect()
    assert sorted((r["place"], r["x"]) for r in rows) == [(i + 1, i) for i in range(1000)]


def test_relative_references(spark):
    aliases = spark.createDataFrame([("A/1", "x", None, 1), ("A/1", "y", "v", 2), ("A/2", "y", None, 3), ("A/2", "z", None, 3)], "alias string, context string, version string, resource long")
    edges = spark.createDataFrame([(1, "A/1", "x", None), (2, "A/1", "q", None), (3, "A/1", "x", "v"), (4, "A/1", "q", "v"), (5, "A/2", "q", None), (6, "A/9", "q", None)], "edge long, alias string, context string, version string")
    out = {r["edge"]: (r["status"], r["target"]) for r in references.resolve_relative(edges, aliases).collect()}
    # a local name of another version does not fall through to other contexts
    assert out == {1: ("resolved", 1), 2: ("ambiguous", None), 3: ("unresolved", None), 4: ("resolved", 2), 5: ("resolved", 3), 6: ("unresolved", None)}


def test_an_alias_in_many_contexts(spark):
    """`Patient/1` stands in each of 2,000 bundles: questions meet counts by equality, so nothing grows with their product."""
    aliases = spark.range(2000).selectExpr("'A/1' AS alias", "concat('c', id) AS context", "CAST(NULL AS STRING) AS version", "id AS resource")
    edges = spark.range(4000).selectExpr("id AS edge", "'A/1' AS alias", "concat('c', id) AS context", "CAST(NULL AS STRING) AS version")
    out = references.resolve_relative(edges, aliases)
    found = {r["edge"]: (r["status"], r["target"], r["n_targets"]) for r in out.collect()}
    assert found[7] == ("resolved", 7, 1) and found[1999] == ("resolved", 1999, 1) and found[2000] == ("ambiguous", None, 2000) and len(found) == 4000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 3 and all(" OR " not in line and "<=>" in line for line in joins)


def test_rows_without_a_partner(spark):
    from veilgraph.plans.registry import without

    left, right = spark.createDataFrame([(1,), (2,), (None,)], "a long"), spark.createDataFrame([(2,), (None,), (3,)], "b long")
    assert sorted(map(str, (r["a"] for r in without(left, right, "a", "b").collect()))) == ["1", "None"]


def test_weighted_quantiles_are_exact(spark):
    precise = "1.00000000000000000001"
    rows = [("g", v, order_key(v), n) for v, n in ((precise, 3), ("2", 2), ("10", 1), ("10E-1", 1))]
    df = spark.createDataFrame(rows, "g string, value string, sort_key string, n long")
    r = statistics.nearest_rank(df, ["g"], ["sort_key", "value"], "value", "n").first()
    assert (r["n"], r["p05"], r["p25"], r["p50"], r["p75"], r["p95"]) == (7, "10E-1", precise, precise, "2", "10")
    assert Decimal(r["minimum"]) == 1 and r["maximum"] == "10"


def test_scopes_of_two_threads(spark):
    """Each deletes its own tables only, and jobs side by side belong to the scope that starts them."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Event

    from veilgraph.plans.storage import materialise, plain, scope, together

    inside, ended, folders = Event(), Event(), []

    def first():
        with scope(spark):
            table = materialise(spark.range(3))
            folders.append(table.inputFiles()[0])
            inside.set()
            assert ended.wait(60)
            return table.count(), together(spark, lambda: materialise(spark.range(5)).inputFiles()[0])

    def second():
        assert inside.wait(60)
        with scope(spark):
            materialise(spark.range(4))
        ended.set()

    with ThreadPoolExecutor(2) as pool:
        a, b = pool.submit(first), pool.submit(second)
        b.result()
        count, (other,) = a.result()
    assert count == 3 and not plain(folders[0]).exists() and not plain(other).exists()


def plain_tangled(edges):
    left = {(c, p) for c, p in edges if c is not None}
    while True:
        have = {c for c, _ in left}
        off = {(c, p) for c, p in left if p not in have}
        if not off:
            return have
        left -= off


def test_tangled_hierarchies(spark, monkeypatch):
    import random

    from veilgraph.operators import graph

    chain = [(i, i + 1) for i in range(10_000)]
    cases = [chain, [*chain[:200], (200, 100)], [(1, 1), (2, 1), (3, 4)], [(1, 2), (1, 3), (3, 1), (4, 1), (5, 4), (5, 9)]]
    for seed in range(6):
        draw = random.Random(seed)
        cases.append([(draw.randrange(30), draw.randrange(40)) for _ in range(draw.choice([20, 30, 45]))])
    inner, written = graph.materialise, []
    monkeypatch.setattr(graph, "materialise", lambda df: written.append(1) or inner(df))
    for k, edges in enumerate(cases):
        written.clear()
        found = graph.tangled(spark.createDataFrame(edges, "child long, parent long")).collect()
        assert {r["node"] for r in found} == plain_tangled(edges) and len(found) == len({r["node"] for r in found})
        if k == 0:
            assert len(written) < 20  # about 14 rounds for a chain of 10,000
