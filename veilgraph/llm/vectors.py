"""Exact top-k inner product search with a pivot-distance index.

Vectors are keyed by their nearest pivot and the distance to it.  The cell of a
pivot is cut into slabs of bounded size, which go to different tasks, and a
slab, sorted by distance, into annuli.  For a query q, a vector v and a pivot p

    q.v = (|q|^2 + |v|^2 - |q - v|^2) / 2   and   |q - v| >= | |q - p| - |v - p| |

so an annulus with distances lo to hi and norms up to m holds no score above
(|q|^2 + m^2 - max(0, |q - p| - hi, lo - |q - p|)^2) / 2.  A query first searches
its own slab, which gives a lower bound for its k-th score; then it goes to every other
slab whose bound reaches it, and expands the annuli there outwards from its own
distance until their bounds fall below the k-th score so far.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialise, tidy

#: Vectors that pivots and slab limits are fitted to, at most (about).
SAMPLE = 4096
PIVOTS, SLAB, ANNULUS = 16, 4096, 512
#: Queries handled together, and slabs whose bounds they are held against at once.
QUERIES, SHELF = 512, 4096
_EXACT = float(1 << 52)
#: Components are held within this, scores within a long.
LARGEST = 1 << 62


class Index(NamedTuple):
    pivots: np.ndarray
    limits: list[np.ndarray]  # of each cell: distances that part its slabs


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), np.int64).reshape(len(cells), -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def prepared(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, dim, v): components scaled and floored, held within `LARGEST`, as bytes; vectors that are null, empty or hold null or non-finite components are left out."""
    rows = vectors.filter(F.col(vector).isNotNull() & F.col(key).isNotNull() & (F.size(vector) > 0)).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x"))

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes nan
            good = np.logical_and.reduceat(np.isfinite(x), np.concatenate([[0], np.cumsum(lengths)[:-1]])) if len(lengths) else np.zeros(0, bool)
            v = np.clip(np.floor(np.where(np.isfinite(x), x, 0) * scale), -float(LARGEST), float(LARGEST)).astype(np.int64)
            ends = np.cumsum(lengths)
            cells = [v[e - n : e].tobytes() for e, n in zip(ends, lengths)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(lengths, pa.int32()), pa.array(cells, pa.binary())], ["id", "dim", "v"]).filter(pa.array(good))

    return rows.mapInArrow(tidy(run), "id long, dim int, v binary")


def fit(rows: DataFrame) -> dict[int, Index]:
    """An index for each number of dimensions, from a bounded sample: pivots chosen farthest first, slab limits by quantiles."""
    counts = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}
    total, out = sum(counts.values()), {}
    unit = F.pmod(F.xxhash64("id", "v", F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # repeated rows count once, so the sample is bounded whatever their number
    picked = rows.filter(unit * total < SAMPLE).select("dim", "v").distinct().collect() if total else []
    for dim, n in counts.items():
        cells = sorted({bytes(r["v"]) for r in picked if r["dim"] == dim})
        x = np.frombuffer(b"".join(cells), np.int64).reshape(-1, dim).astype(float) if cells else np.zeros((1, dim))
        chosen, near = [0], np.full(len(x), np.inf)
        while len(chosen) < min(PIVOTS, len(x)):
            near = np.minimum(near, _distances(x, x[chosen[-1:]])[:, 0])
            chosen.append(int(np.argmax(near)))
        pivots = x[chosen]
        d = _distances(x, pivots)
        cell, low = d.argmin(axis=1), d.min(axis=1)
        parts = [max(1, round(n * (cell == c).mean() / SLAB)) for c in range(len(pivots))]
        out[dim] = Index(pivots, [np.quantile(low[cell == c], np.arange(1, p) / p) if p > 1 else np.zeros(0) for c, p in enumerate(parts)])
    return out


def _placed(rows: DataFrame, indexes: dict[int, Index]) -> DataFrame:
    """rows with their cell, slab and distance to the pivot."""
    shared = rows.sparkSession.sparkContext.broadcast(indexes)

    def run(batches):
        for batch in batches:
            for dim in np.unique(batch.column(1).to_numpy()):
                some = batch.filter(pa.array(batch.column(1).to_numpy() == dim))
                index = shared.value[int(dim)]
                d = _distances(_matrix(some.column(2)).astype(float), index.pivots)
                cell = d.argmin(axis=1)
                low = d[np.arange(len(d)), cell]
                slab = np.zeros(len(d), np.int64)
                for c in np.unique(cell):
                    slab[cell == c] = np.searchsorted(index.limits[c], low[cell == c])
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell), pa.array(slab), pa.array(low)], ["id", "dim", "v", "cell", "slab", "far"])

    return rows.mapInArrow(tidy(run), "id long, dim int, v binary, cell long, slab long, far double")


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products, exact: in floating point where no sum can pass 2**52, else in Python's integers, held within a long."""
    if q.size == 0 or v.size == 0 or np.abs(q).astype(float).sum(axis=1).max() * np.abs(v).astype(float).max() < _EXACT:
        return (q.astype(float) @ v.astype(float).T).astype(np.int64)
    exact = q.astype(object) @ v.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _search(qid: np.ndarray, q: np.ndarray, floor: np.ndarray, pivot: np.ndarray, vid: np.ndarray, v: np.ndarray, far: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(place among the queries, vector, score) of what a slab adds to the best k of queries, expanding annuli outwards from each query's distance."""
    order = np.argsort(far, kind="stable")
    vid, v, far = vid[order], v[order], far[order]
    own = _distances(q.astype(float), pivot[None].astype(float))[:, 0]
    norms, squares = (v.astype(float) ** 2).sum(axis=1), (q.astype(float) ** 2).sum(axis=1)
    cuts = list(range(0, len(v), ANNULUS))
    bounds = np.empty((len(q), len(cuts)))
    for i, a in enumerate(cuts):
        lo, hi, most = far[a], far[min(a + ANNULUS, len(far)) - 1], norms[a : a + ANNULUS].max()
        gap = np.maximum(0, np.maximum(own - hi, lo - own))
        # a hair wider than floating point may err
        bounds[:, i] = (squares + most - gap * gap) / 2 * (1 + 1e-9) + 1 + 1e-9 * (squares + most)
    turn = np.argsort(-bounds, axis=1, kind="stable")
    kth = floor.copy()
    best: list[list[tuple[int, int]]] = [[] for _ in range(len(q))]
    alive = np.arange(len(q))
    for step in range(len(cuts)):
        # bounds fall from turn to turn: who stops here has no more to find
        alive = alive[bounds[alive, turn[alive, step]] >= kth[alive]]
        for i in np.unique(turn[alive, step]):
            group = alive[turn[alive, step] == i]
            a, b = cuts[i], min(cuts[i] + ANNULUS, len(v))
            scores = _scores(q[group], v[a:b])
            for row, g in zip(scores, group):
                good = np.flatnonzero((row >= kth[g]) & (vid[a:b] != qid[g]))
                if len(good) > k:
                    good = good[np.lexsort((vid[a:b][good], -row[good]))[:k]]
                if len(good):
                    merged = sorted([*best[g], *((-int(row[j]), int(vid[a + j])) for j in good)])[:k]
                    best[g] = merged
                    if len(merged) == k:
                        kth[g] = max(kth[g], -merged[-1][0])
    return [(g, vec, -s) for g, found in enumerate(best) for s, vec in found]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by `every` its k highest inner products with other rows.

    Components are floor(scale * x), held within 2**62 either way, and scores within the range of a long; equal scores go to the smaller key; fewer than k other
    vectors give as many rows. Only vectors of a query's own number of dimensions are compared.

    Null keys and vectors, empty vectors and such with null, infinite or nan
    components take no part. All rows with the query's own key count as its own. Query rows that are equal in key and vector
    are one query; those with one key and different vectors are answered each, ranks from 1. Other
    rows that are equal each count; an empty table gives no rows; other columns are left out, whatever their names.
    """
    spark = vectors.sparkSession
    rows = materialise(prepared(vectors, key, vector, scale))
    indexes = fit(rows)
    # the slabs' limits come from a sample: one that holds more, such as of many equal vectors, is dealt out further
    placed = materialise(_placed(rows, indexes))
    slabs = placed.groupBy("dim", "cell", "slab").agg(F.count("*").alias("rows"))
    parts = F.ceil(F.col("rows") / SLAB)
    data = placed.join(slabs.select("dim", "cell", "slab", parts.alias("parts")), ["dim", "cell", "slab"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts")).drop("parts")
    data = materialise(data.withColumn("norm", _norm("v")))
    place = ["dim", "cell", "slab", "part"]
    edges = data.groupBy(*place).agg(F.min("far").alias("lo"), F.max("far").alias("hi"), F.max("norm").alias("most"))
    queries = data.filter(F.pmod("id", F.lit(every)) == 0).select("id", "v", *place).dropDuplicates(["id", "v"])
    shared = spark.sparkContext.broadcast(indexes)

    def search(key, group, asked):
        index = shared.value.get(key[0].as_py())
        out = []
        if group.num_rows and asked.num_rows:
            vid, v, far = group.column("id").to_numpy(), _matrix(group.column("v")), group.column("far").to_numpy()
            qid, q, floor = asked.column("id").to_numpy(), _matrix(asked.column("v")), asked.column("floor").to_numpy()
            for a in range(0, len(qid), QUERIES):
                found = _search(qid[a : a + QUERIES], q[a : a + QUERIES], floor[a : a + QUERIES], index.pivots[key[1].as_py()], vid, v, far, k)
                out += [(int(qid[a + g]), asked.column("mark")[a + g].as_py(), vec, s) for g, vec, s in found]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 4)], ["query_id", "mark", "vec_id", "score"])

    def searched(asked: DataFrame) -> DataFrame:
        return data.select(*place, "id", "v", "far").groupBy(*place).cogroup(asked.groupBy(*place)).applyInArrow(search, "query_id long, mark long, vec_id long, score long")

    lowest = F.lit(-float("inf"))
    queries = queries.withColumn("mark", F.xxhash64("v"))  # tells queries of one key apart
    first = materialise(searched(queries.withColumn("floor", lowest)))
    floors = first.groupBy("query_id", "mark").agg(F.when(F.count("*") == k, F.min("score").cast("double")).alias("floor"))
    # every other slab whose bound reaches the k-th score
    wanted = queries.join(floors, (F.col("id") == F.col("query_id")) & queries["mark"].eqNullSafe(floors["mark"]), "left").select("id", "v", queries["mark"], *place, F.coalesce("floor", lowest).alias("floor"))
    asked = _reached(materialise(wanted), edges, indexes, place)
    found = first.unionByName(searched(asked))
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _norm(column: str):
    @F.pandas_udf("double")
    def run(cells):
        import pandas as pd

        return pd.Series([float((np.frombuffer(c, np.int64).astype(float) ** 2).sum()) for c in cells])

    return run(F.col(column))


def _reached(wanted: DataFrame, edges: DataFrame, indexes: dict[int, Index], place: list[str]) -> DataFrame:
    """A row of `wanted` for each slab, but its own, that may hold one of its best k.

    Blocks of queries meet shelves of slabs, both of bounded size, each pair in a task of its own: no task sees all slabs or
    all queries of a number of dimensions.
    """
    spark = wanted.sparkSession
    shared = spark.sparkContext.broadcast(indexes)
    edges = materialise(edges)
    # a row for each number of dimensions
    asked, held = wanted.groupBy("dim").count(), edges.groupBy("dim").agg(F.count("*").alias("slabs"))
    parts = asked.join(held, "dim").select("dim", F.ceil(F.col("count") / QUERIES).alias("blocks"), F.ceil(F.col("slabs") / SHELF).alias("shelves"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    blocks = wanted.join(F.broadcast(parts), "dim").withColumn("block", F.pmod(F.xxhash64("id", "mark"), "blocks")).withColumn("shelf", each("shelves")).drop("blocks", "shelves")
    shelves = edges.join(F.broadcast(parts), "dim").withColumn("shelf", F.pmod(F.xxhash64(*place), "shelves")).withColumn("block", each("blocks")).drop("blocks", "shelves")

    def run(key, queries, slabs):
        out = {"id": [], "v": [], "mark": [], "floor": [], "cell": [], "slab": [], "part": []}
        if queries.num_rows and slabs.num_rows:
            index = shared.value[key[0].as_py()]
            q = _matrix(queries.column("v")).astype(float)
            d, squares = _distances(q, index.pivots), (q * q).sum(axis=1)
            floor = queries.column("floor").to_numpy()
            ids, marks, cells = (queries.column(c).to_pylist() for c in ("id", "mark", "v"))
            own = list(zip(*(queries.column(c).to_pylist() for c in place[1:])))
            for s in slabs.to_pylist():
                gap = np.maximum(0, np.maximum(d[:, s["cell"]] - s["hi"], s["lo"] - d[:, s["cell"]]))
                bound = (squares + s["most"] - gap * gap) / 2 * (1 + 1e-9) + 1 + 1e-9 * (squares + s["most"])
                for g in np.flatnonzero(bound >= floor).tolist():
                    if own[g] != (s["cell"], s["slab"], s["part"]):
                        for name, value in (("id", ids[g]), ("v", cells[g]), ("mark", marks[g]), ("floor", floor[g]), ("cell", s["cell"]), ("slab", s["slab"]), ("part", s["part"])):
                            out[name].append(value)
        n = len(out["id"])
        return pa.table({"id": pa.array(out["id"], pa.int64()), "v": pa.array(out["v"], pa.binary()), "mark": pa.array(out["mark"], pa.int64()), "dim": pa.array([key[0].as_py()] * n, pa.int32()), **{c: pa.array(out[c], pa.int64()) for c in place[1:]}, "floor": pa.array(out["floor"], pa.float64())})

    return blocks.groupBy("dim", "block", "shelf").cogroup(shelves.groupBy("dim", "block", "shelf")).applyInArrow(run, "id long, v binary, mark long, dim int, cell long, slab long, part long, floor double")
