"""MinHash near-dedup by an inverted join of signature coordinates.

A document's signature has `COORDINATES` coordinates, each the minimum of a
hash function over its shingles.  The document is posted under its
(coordinate, value) pairs.  Two documents whose sets have the wanted similarity
agree in many coordinates: `match` of them at least, but for a chance of about
1e-7 at the default threshold.  So

* pairs that no other document has are dropped, and documents left with
  fewer than `match` pairs with them;
* of s shared pairs only the s - match + 1 rarest are posted (prefix): two
  documents with `match` in common meet in one of these; and
* candidates must agree in `match` coordinates and in size (skip), and are
  confirmed on their full shingle sets.

Documents with equal sets are one node; nodes that share a key are linked.  A posting list is never expanded into
all its pairs: first each node is compared with the list's hub, the node whose
coordinates are the commonest; links found so make components.  All that meet in
a list are in the group of its hub.  Groups that still hold two components are
compared further, in blocks of bounded size, each pair of blocks dealt to a task by a hash of its own, across
components only, as a link within one changes nothing: first by signatures, which
tells the nodes that may have a link, then these by their full sets.  Both
rounds return rows per node, never pairs.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import bounded_batches, fresh, materialise, pack, salted, tidy, unpack, unpacked
from .components import components

COORDINATES = 48
#: Nodes of one posting list that are compared in one task at a time, at most and, where pairs of blocks are fewer than tasks, at least; and texts verified in one.
LIST_BLOCK, SMALL_BLOCK, TEXT_BLOCK = 256, 64, 64
_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def match_for(similarity: Fraction, coordinates: int = COORDINATES, miss: float = 1e-7) -> int:
    """The most coordinates such that a pair of this similarity agrees in fewer with a chance below `miss` only."""
    from math import comb

    p, below = float(similarity), 0.0
    for k in range(coordinates + 1):
        below += comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if below > miss:
            return max(1, k)
    return coordinates


def shingles(words: W.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, shingle hash) rows, sorted; a document of fewer words has its whole sequence as one."""
    h = words.hashes()
    fits = W.window_fits(words, width)
    docs = words.docs()
    at = np.flatnonzero(fits)
    doc, value = docs[at], W.window_hashes(h, width)[at]
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.array([int(W.mix(np.array([np.sum(W.window_hashes(h[words.first[k] : words.first[k + 1]], int(counts[k]))) + W.U64(counts[k])], W.U64))[0]) for k in short], W.U64)
        doc, value = np.concatenate([doc, short]), np.concatenate([value, extra])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def _sketch(words: W.Words, width: int) -> dict[str, np.ndarray]:
    """Set size, 128-bit digest of the set and signature of each document."""
    n = len(words.offsets) - 1
    doc, value = shingles(words, width)
    size = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
    full = np.flatnonzero(size)
    digest, signature = np.zeros((n, 2), W.U64), np.zeros((n, COORDINATES), np.uint32)
    if len(full):
        begins = np.concatenate([[0], np.cumsum(size[full])[:-1]])
        for k in range(2):
            digest[full, k] = np.add.reduceat(W.mix(value + W.U64(k + 1)), begins)
        for k in range(COORDINATES):
            signature[full, k] = (np.minimum.reduceat(value * _FACTORS[k] + _FACTORS[-1 - k], begins) >> W.U64(32)).astype(np.uint32)
    return {"size": size, "digest": digest, "signature": signature}


def _signatures(column) -> np.ndarray:
    """A binary column of signatures as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def sketches(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, h, n, d, e, sig) for each row: hash of the text, size of the shingle set, its digest and its signature."""
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in "hnde"), T.StructField("sig", T.BinaryType())])

    def run(batches):
        for batch in batches:
            keys, hashes = batch.column(0), batch.column(2)
            for lo, hi, words in W.pieces(batch.column(1), lower=True):
                s = _sketch(words, width)
                sig = [x.tobytes() if n else b"" for x, n in zip(s["signature"], s["size"])]
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), hashes.slice(lo, hi - lo), pa.array(s["size"], pa.int64()), pa.array(s["digest"][:, 0].view(np.int64)), pa.array(s["digest"][:, 1].view(np.int64)), pa.array(sig, pa.binary())], schema.fieldNames())

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("h")).mapInArrow(tidy(run), schema)


def _postings(nodes: DataFrame, match: int) -> DataFrame:
    """Nodes that can have a partner: (node, n, sig, score, prefix); score tells how common its coordinates are."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sig = _signatures(batch.column(1)).astype(W.U64)
                token = W.mix(sig * W.U64(COORDINATES) + np.arange(COORDINATES, dtype=W.U64)).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), COORDINATES)), pa.array(token)], ["node", "token"])

    posted = nodes.select("node", "sig").mapInArrow(tidy(run), "node long, token long")
    shared = posted.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    own = posted.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"), F.sum("df").alias("score"))
    own = own.filter(F.size("own") >= match).select("node", "score", F.slice("own.token", F.lit(1), F.size("own") - (match - 1)).alias("prefix"))
    return own.join(nodes.select("node", "n", "sig"), "node")


def _agree(pairs: DataFrame, nodes: DataFrame, match: int, similarity: Fraction) -> DataFrame:
    """Pairs (a, b) that agree in `match` coordinates and may in size."""
    one, two = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"sig{x}")) for x in "ab")
    p, q = similarity.numerator, similarity.denominator
    rows = pairs.join(one, "a").join(two, "b").filter(F.least("na", "nb") * q >= F.greatest("na", "nb") * p).select("a", "b", "siga", "sigb")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                good = (_signatures(batch.column(2)) == _signatures(batch.column(3))).sum(axis=1) >= match
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return rows.mapInArrow(tidy(run), "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: Fraction) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough; for each a, the b go to tasks in blocks of bounded size."""
    p, q = similarity.numerator, similarity.denominator
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / TEXT_BLOCK).alias("blocks")).filter("blocks > 1")
    dealt = salted(pairs, many, "a", "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), "blocks"), F.lit(0)).alias("part"))
    members = dealt.join(texts, F.col("b") == F.col("node")).select("a", "part", "node", "packed")
    heads = dealt.select("a", "part").distinct().join(texts, F.col("a") == F.col("node")).select("a", "part", "node", "packed")

    def run(key, group):
        head = key[0].as_py()
        nodes = group.column("node").to_numpy()
        order = np.argsort(nodes != head, kind="stable")  # the head comes first
        group, nodes = group.take(pa.array(order)), nodes[order]
        sizes, common, first = [], [], None
        for _, _, words in W.pieces(unpacked(group.column("packed")), lower=True):
            doc, value = shingles(words, width)
            n = len(words.offsets) - 1
            if first is None:
                first = value[doc == 0]
            sizes.append(np.bincount(doc, minlength=n))
            at = np.minimum(np.searchsorted(first, value), len(first) - 1)
            common.append(np.bincount(doc[first[at] == value], minlength=n))
        sizes, common = np.concatenate(sizes), np.concatenate(common)
        good = (q * common >= p * (sizes + len(first) - common)) & (nodes != head)
        return pa.table({"a": np.full(int(good.sum()), head), "b": nodes[good]})

    return members.unionByName(heads).groupBy("a", "part").applyInArrow(run, "a long, b long")


def _met(members: DataFrame) -> DataFrame:
    """members (hub, node, component, ..) of groups that hold two components, dealt out to meet in blocks of bounded size.

    Block k of a group meets the blocks up to k; a row goes to each such pair (i, j) of blocks, with its own block. Rows are
    dealt out by the pair, as column `task` tells, not by the hub alone.
    """
    groups = members.groupBy("hub").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("rows")).filter("low != high")
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # as many blocks that every task gets a pair of them, unless they become too small for that
    blocks = F.greatest(F.ceil(F.col("rows") / LIST_BLOCK), F.least(F.ceil(F.col("rows") / SMALL_BLOCK), F.lit(int((2 * tasks) ** 0.5) + 1)))
    rows = salted(members, groups.select("hub", blocks.alias("blocks")), "hub", "node").withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.greatest(x, F.col("own")).alias("i"), F.least(x, F.col("own")).alias("j")))
    rows = rows.withColumn("met", F.explode(met)).withColumn("i", F.col("met.i")).withColumn("j", F.col("met.j")).drop("met", "blocks")
    # pairs of a hub are numbered through and dealt in turn, so that no task gets many while others get none
    turn = F.xxhash64("hub") % tasks + F.shiftright(F.col("i") * (F.col("i") + 1), 1) + F.col("j")
    return rows.withColumn("task", F.pmod(turn, F.lit(tasks)).cast("int")).repartitionById(tasks, "task")


def _may_link(n: np.ndarray, sig: np.ndarray, part: np.ndarray, left: np.ndarray, right: np.ndarray, match: int, similarity: Fraction) -> np.ndarray:
    """For each row of `left` and `right`: are they of different components, alike in size, and agree in `match` coordinates?"""
    p, q = similarity.numerator, similarity.denominator
    out = np.zeros((len(left), len(right)), bool)
    sizes, theirs, parts = n[right], np.ascontiguousarray(sig[right].T), part[right]
    for row, k in enumerate(left):
        other = np.flatnonzero((parts != part[k]) & (np.minimum(sizes, n[k]) * q >= np.maximum(sizes, n[k]) * p))
        if len(other):
            agree = np.zeros(len(other), np.int16)
            for c in range(COORDINATES):
                agree += theirs[c, other] == sig[k, c]
            out[row, other[agree >= match]] = True
    return out


def _active(members: DataFrame, match: int, similarity: Fraction) -> DataFrame:
    """The (hub, node) that may have a link to another component within the hub's group: rows, not pairs."""

    def run(key, group):
        i, j = key[1].as_py(), key[2].as_py()
        own, node, n, part = (group.column(c).to_numpy() for c in ("own", "node", "n", "component"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        may = _may_link(n, _signatures(group.column("sig")), part, left, right, match, similarity)
        found = np.union1d(node[left[may.any(axis=1)]], node[right[may.any(axis=0)]])
        return pa.table({"hub": np.full(len(found), key[0].as_py()), "node": found})

    return _met(members).groupBy("hub", "i", "j", "task").applyInArrow(run, "hub long, node long").distinct()


def _common(values: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, rows: int) -> np.ndarray:
    """Shingles in common of each row of `left` and `right`, as products of 0/1 matrices."""
    _, code, count = np.unique(values, return_inverse=True, return_counts=True)
    kept = np.flatnonzero(count[code] > 1)
    _, code = np.unique(code[kept], return_inverse=True)
    doc, out = doc[kept], np.zeros((len(left), len(right)), np.float32)
    step = 2048
    for a in range(0, int(code.max()) + 1 if len(code) else 0, step):
        some = (code >= a) & (code < a + step)
        has = np.zeros((rows, step), np.float32)
        has[doc[some], code[some] - a] = 1
        out += has[left] @ has[right].T
    return out


def _merged(members: DataFrame, width: int, match: int, similarity: Fraction) -> DataFrame:
    """(a, b) of nodes that links, confirmed on full sets, put into one component: for each task and node the smallest node that it reaches there."""
    p, q = similarity.numerator, similarity.denominator

    def run(key, group):
        i, j = key[1].as_py(), key[2].as_py()
        own, node, n, part = (group.column(c).to_numpy() for c in ("own", "node", "n", "component"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        link = _may_link(n, _signatures(group.column("sig")), part, left, right, match, similarity)
        if link.any():
            docs, values, base = [], [], 0
            for _, _, words in W.pieces(unpacked(group.column("packed")), lower=True):
                doc, value = shingles(words, width)
                docs.append(doc + base)
                values.append(value)
                base += len(words.offsets) - 1
            common = _common(np.concatenate(values), np.concatenate(docs), left, right, len(node)).astype(np.int64)
            link &= q * common >= p * (n[left][:, None] + n[right][None] - common)
        # the smallest node reached over these links
        label = node.copy()
        while link.any():
            rows = np.where(link, label[right][None], np.iinfo(np.int64).max).min(axis=1)
            columns = np.where(link, label[left][:, None], np.iinfo(np.int64).max).min(axis=0)
            new = label.copy()
            np.minimum.at(new, left, rows)
            np.minimum.at(new, right, columns)
            if (new == label).all():
                break
            label = new
        at = np.flatnonzero(label != node)
        return pa.table({"a": label[at], "b": node[at]})

    return _met(members).groupBy("hub", "i", "j", "task").applyInArrow(run, "a long, b long").distinct()


def _same_key(full: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """Pairs (a, b) of nodes that rows with one key are in: of each such key its first node with the others; None if there is no such key."""
    differ = lambda c: F.min(c) != F.max(c)
    several = materialise(full.groupBy("key").agg((differ("d") | differ("e")).alias("several")).filter("several").select("key"))
    if several.isEmpty():
        return None
    own = full.join(several, "key", "left_semi").select("key", "d", "e").distinct()
    own = materialise(own.join(nodes.select("d", "e", F.col("node").alias("b")), ["d", "e"]).select("key", "b"))
    return own.groupBy("key").agg(F.min("b").alias("a")).join(own, "key").filter("a != b").select("a", "b")


def near_duplicates(docs: DataFrame, similarity: Fraction = Fraction(8, 10), width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs its key, n_shingles, component_id (the smallest key reachable over links) and kept.

    Documents are linked if the Jaccard similarity of their sets of distinct `width`-word shingles is at
    least `similarity`; words are lower-cased in A-Z; a document of fewer words has its
    whole sequence as one shingle.

    Documents without words, or with a null text, have no shingles and are linked with nothing: their component
    is their own key. Rows with one key are one document: what any of them is linked with is in their component, and each
    comes back, with kept true where its key stays; rows with a null key link nothing and have a null component and kept false.
    Texts of any length count whole; ties don't matter; an empty table gives no rows; other columns are left out, whatever their names.
    """
    if docs.schema[key].dataType != T.LongType():
        docs = docs.withColumn(key, F.col(key).cast("long"))
    match = match_for(similarity)
    bounded_batches(docs)
    rows = materialise(sketches(docs, key, text, width))
    full = rows.filter("n > 0 AND key IS NOT NULL")
    classes = full.groupBy("d", "e").agg(F.min(F.struct("key", "h")).alias("low"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    # numbers are written once, so later steps agree on them
    nodes = materialise(classes.select(F.monotonically_increasing_id().alias("node"), "d", "e", F.col("low.key").alias("key"), F.col("low.h").alias("h"), "n", "sig"))
    posted = materialise(_postings(nodes, match))
    wanted = posted.select("node").join(nodes.select("node", F.col("key").alias("of"), F.col("h").alias("oh")), "node")
    texts = pack(docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("packed")).filter("packed IS NOT NULL"), "packed")
    texts = texts.join(wanted, (F.col("key") == F.col("of")) & (F.col("h") == F.col("oh"))).select("node", "packed")
    texts = materialise(texts.dropDuplicates(["node"]))

    lists = posted.select("node", "score", F.explode("prefix").alias("token"))
    hubs = lists.groupBy("token").agg(F.max(F.struct("score", "node")).alias("top"), F.count("*").alias("rows")).filter("rows > 1").select("token", F.col("top.node").alias("hub"))
    # two nodes that meet in a list are both in the group of its hub
    groups = materialise(lists.join(hubs, "token").select("hub", "node").distinct())
    pairs = groups.filter("hub != node").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    links, same = _verified(_agree(pairs, posted, match, similarity), texts, width, similarity), _same_key(full, nodes)
    links = materialise(links if same is None else links.unionByName(same))
    found = components(links).withColumnRenamed("node", "in")
    member = posted.select("node", "n", "sig").join(found, F.col("node") == F.col("in"), "left").select("node", "n", "sig", F.coalesce("component", "node").alias("component"))
    member = materialise(member)
    active = materialise(_active(groups.join(member, "node"), match, similarity))
    merged = materialise(_merged(active.join(member, "node").join(texts, "node"), width, match, similarity))
    if not merged.limit(1).isEmpty():
        found = components(links.unionByName(merged)).withColumnRenamed("node", "in")
    known = nodes.select("d", "e", "key", "node").join(found, F.col("node") == F.col("in"), "left").select("d", "e", "key", "node", F.coalesce("component", "node").alias("part"))
    # of nodes on their own the key is known; a component may have very many, so they are dealt out
    lowest = known.groupBy("part").agg(F.min("key").alias("low"), F.count("*").alias("n")).filter("n > 1").drop("n")
    known = salted(known, lowest, "part", "node", "left").select(F.col("d").alias("cd"), F.col("e").alias("ce"), F.coalesce("low", "key").alias("component_id"))
    out = rows.join(known, (F.col("d") == F.col("cd")) & (F.col("e") == F.col("ce")) & (F.col("n") > 0), "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("key"), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, similarity: Fraction = Fraction(8, 10), width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each component the document with the smallest key.

    Of rows with one key and text one stays; rows with a null key all stay, and so do documents without words or with a null text, each for itself; texts of
    any length count whole; ties don't matter; an empty table stays one; columns of any name pass through as they are.
    """
    once, copy, lost = fresh(docs.columns, "once", "copy", "gone")
    gone = near_duplicates(docs, similarity, width, key, text).filter(F.col(key).isNotNull() & ~F.col("kept")).select(F.col(key).cast(docs.schema[key].dataType).alias(lost)).distinct()
    packed = pack(docs, text).join(gone, F.col(key) == F.col(lost), "left_anti")
    packed = packed.withColumn(once, F.md5(text)).withColumn(copy, F.when(F.col(key).isNull(), F.monotonically_increasing_id()))
    return unpack(packed.dropDuplicates([key, once, copy]).drop(once, copy), text)
