"""How far the sources of a language diverge from each other, and by which terms.

Each task counts its texts' terms with DuckDB and hands on sums, a row for each language, source and term. Sums are
hashed by language and term to shards, where further SQL adds them up, keeps the terms of enough documents,
and turns counts into shares. Every shard gives partial sums for pairs of sources and its own
highest terms, and Spark merges sums and rankings.

A pair's value is a sum over all kept terms, most of which neither source has. It is taken apart so that no shard
visits them: with f0 for a term that neither has, the sum is V * f0, corrected for the terms of the one, for those of the other, and for
those of both. The first two need just how often each count occurs; only the last joins sources by term.

All arithmetic is on whole numbers: shares count billionths, and DuckDB adds up in 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranks import numbered
from . import words as W
from .common import bounded_batches, materialise, tidy
from .shards import dealt, runs

#: [\x00-\x40\x5B-\x60\x7B-\x7F]: all of ASCII that is not a letter (texts are lower-cased before).
NOT_LETTER = W._byte_table(bytes([*range(0x61), *range(0x7B, 0x80)]))
#: Bytes of text counted at once, sums that a task holds before it hands them on, and rows of a shard's table.
TEXT_BYTES, SUMS, ROWS = 4 << 20, 1_500_000, 400_000
#: Kept terms that a shard joins at once.
TERMS = 100_000
#: Groups whose pairs one pass adds up: a pass holds no more than the square of it.
GROUPS = 1000
BUCKETS = 16
SUMS_SCHEMA = "lang string, source string, term string, n long, docs long"
PARTS_SCHEMA = "lang string, source string, part string, item string, value decimal(38,0)"
KEPT_SCHEMA = "lang string, term string, sources array<struct<source: string, n: bigint>>"
#: The value of share p where q is expected, and a share in 1 / scale.
MACROS = (
    "CREATE MACRO f(p, q) AS ((p - q) * (p - q)) // q",
    "CREATE MACRO share(n, total, v, scale) AS CAST(1 + (scale::HUGEINT * (n + 1)) // (total::HUGEINT + v) AS BIGINT)",
)


def database() -> duckdb.DuckDBPyConnection:
    base = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "preserve_insertion_order": False})
    for macro in MACROS:
        done(base, macro)
    return base


def done(base: duckdb.DuckDBPyConnection, sql: str, given: dict | None = None) -> list:
    """Run a statement to its end."""
    return base.execute(sql, given or {}).fetchall()


def batches_of(base: duckdb.DuckDBPyConnection, sql: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    table = base.sql(sql).to_arrow_table()
    yield from pa.table([table.column(f.name).cast(f.type) for f in schema], schema=schema).to_batches(max_chunksize=50_000)


def partial_sums(docs: DataFrame) -> DataFrame:
    """docs (lang, source, text) as rows of `SUMS_SCHEMA`, several for a key: how often a term occurs, and in how many documents."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def count(batches):
        base = database()
        done(base, "CREATE TABLE sums (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        total = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM sums GROUP BY ALL"
        held = 0
        for batch in batches:
            for row, stop, words in W.pieces(batch.column("text"), NOT_LETTER, lower=True, size=TEXT_BYTES):
                if not len(words.starts):
                    continue
                here = batch.slice(row, stop - row)
                base.register("found", pa.table({"doc": pa.array(words.docs().astype(np.int32)), "term": W.spans(words.data, words.starts, words.ends)}))
                base.register("rows", pa.table({"doc": pa.array(np.arange(stop - row, dtype=np.int32)), "lang": here.column("lang"), "source": here.column("source")}))
                done(base, """
                    INSERT INTO sums SELECT lang, source, term, sum(n), count(*) FROM (SELECT doc, term, count(*) AS n FROM found GROUP BY ALL) JOIN rows USING (doc) GROUP BY ALL""")
                ((held,),) = done(base, "SELECT count(*) FROM sums")
                if held >= SUMS:
                    yield from batches_of(base, total, schema)
                    done(base, "TRUNCATE sums")
                    held = 0
        if held:
            yield from batches_of(base, total, schema)
        base.close()

    return bounded_batches(docs).mapInArrow(tidy(count), SUMS_SCHEMA)


def kept_terms(sums: DataFrame, least: int) -> DataFrame:
    """A row of `KEPT_SCHEMA` for each term of a language that at least `least` of its documents have, with the sources that have it."""
    sources = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", sources)])

    def merge(batches):
        base = database()

        def added(table):
            base.register("part", table)
            sql = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs, shard FROM part GROUP BY ALL"
            return base.sql(sql).to_arrow_table().cast(table.schema)

        for part in runs(batches, "shard", ROWS, added):
            base.register("part", part)
            yield from batches_of(
                base,
                f"""
                    SELECT lang, term, list({{'source': source, 'n': n}}) AS sources
                    FROM (SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, sum(docs) AS docs FROM part GROUP BY ALL)
                    GROUP BY ALL HAVING sum(docs) >= {int(least)}""",
                schema,
            )
        base.close()

    return dealt(sums, F.xxhash64("lang", "term")).mapInArrow(tidy(merge), KEPT_SCHEMA)


#: For a part of the kept terms: what its terms add to each pair of sources, apart from V * f0.
PAIRS_SQL = """
INSERT INTO sums WITH common AS (
    SELECT a.id AS id, b.id AS other, sum((f(a.p, b.p) - f(a.p, b.p0) - f(a.p0, b.p) + f(a.p0, b.p0))::HUGEINT) AS value
    FROM ours a JOIN theirs b ON a.place = b.place AND a.lang_id = b.lang_id AND a.id <> b.id GROUP BY ALL
), own AS (
    SELECT a.id AS id, b.id AS other, sum(a.n::HUGEINT * (f(a.p, b.p0) - f(a.p0, b.p0))) AS value
    FROM (SELECT lang_id, id, p0, p, count(*) AS n FROM ours GROUP BY ALL) a JOIN other_groups b ON a.lang_id = b.lang_id AND a.id <> b.id GROUP BY ALL
), other AS (
    SELECT a.id AS id, b.id AS other, sum(b.n::HUGEINT * (f(a.p0, b.p) - f(a.p0, b.p0))) AS value
    FROM groups a JOIN (SELECT lang_id, id, p0, p, count(*) AS n FROM theirs GROUP BY ALL) b ON a.lang_id = b.lang_id AND a.id <> b.id GROUP BY ALL
)
SELECT id, other, sum(value) FROM (FROM common UNION ALL FROM own UNION ALL FROM other) GROUP BY ALL
"""
#: The highest terms of each group so far.
TERMS_SQL = """
CREATE OR REPLACE TABLE best AS
SELECT id, term, value FROM (FROM best UNION ALL SELECT id, term, f(p, q) AS value FROM ours JOIN terms USING (place) WHERE p > q)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY value DESC, term) <= $top
"""
RESULT_SQL = """
SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(sum(value) AS DECIMAL(38, 0)) AS value
FROM sums JOIN groups g USING (id) JOIN other_groups h ON h.id = other GROUP BY ALL
UNION ALL SELECT lang, source, 'term', term, CAST(value AS DECIMAL(38, 0)) FROM best JOIN groups USING (id)
"""
#: Entries (place of the term in the part, source) with shares: p of the source, p0 of a term that it hasn't, q of the language.
ENTRIES_SQL = """
CREATE OR REPLACE TEMP TABLE {name} AS
SELECT e.place, g.lang_id, g.id, g.p0, share(e.n, g.total, g.v, $scale) AS p, share(e.n_lang, g.total_lang, g.v, $scale) AS q
FROM (SELECT place, lang, n_lang, unnest(sources, recursive := true) FROM terms) e JOIN {groups} g ON g.lang = e.lang AND g.source = e.source
"""


def _parts(kept: DataFrame, ours: list, theirs: list, scale: int, top: int) -> DataFrame:
    """What the kept terms add to the pairs of a group of `ours` with one of `theirs`; with ours for both, also each part's highest terms."""
    same = ours is theirs
    names = ["lang", "source", "lang_id", "id", "total", "total_lang", "v"]
    shared = kept.sparkSession.sparkContext.broadcast([{c: [r[c] for r in side] for c in names} for side in (ours, theirs)])
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.decimal128(38, 0))])

    def run(batches):
        base = database()
        for name, side in zip(("groups", "other_groups"), shared.value, strict=True):
            base.register("rows_of", pa.table(side))
            done(base, f"CREATE TABLE {name} AS SELECT *, share(0, total, v, {scale}) AS p0 FROM rows_of")
        done(base, "CREATE TABLE sums (id BIGINT, other BIGINT, value HUGEINT)")
        done(base, "CREATE TABLE best (id BIGINT, term VARCHAR, value BIGINT)")
        held, rows = [], 0

        def add():
            base.register("found", pa.Table.from_batches(held))
            done(base, """CREATE OR REPLACE TEMP TABLE terms AS
                SELECT row_number() OVER () AS place, lang, term, sources, CAST(list_sum(list_transform(sources, lambda s: s.n)) AS BIGINT) AS n_lang FROM found""")
            done(base, ENTRIES_SQL.format(name="ours", groups="groups"), {"scale": scale})
            if same:
                done(base, "CREATE OR REPLACE TEMP VIEW theirs AS FROM ours")
                done(base, TERMS_SQL, {"top": top})
            else:
                done(base, ENTRIES_SQL.format(name="theirs", groups="other_groups"), {"scale": scale})
            done(base, PAIRS_SQL)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= TERMS:
                add()
                held, rows = [], 0
        if rows:
            add()
        yield from batches_of(base, RESULT_SQL, schema)
        base.close()

    return kept.mapInArrow(tidy(run), PARTS_SCHEMA)


def audit(docs: DataFrame, least: int = 3, top: int = 200, scale: int = 1_000_000_000, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows (lang, source, part, item, value, rank): how far a source's terms are from each other source's, and from its language's.

    A language keeps the terms, runs of letters with A-Z lower-cased, that `least` of its documents have. The share of a kept term with n occurrences
    of N is p = 1 + floor(scale * (n + 1) / (N + V)) for V kept terms, and a share p where q is expected has value floor((p - q)**2 / q).
    Part `pair`: item is another source of the language, q is its share, and value the sum over all kept terms; all ranks.
    Part `term`: item is a kept term that the source has with more than the language's share, q; ranks up to `top`.
    Ranks go by value, highest first, then by item in UTF-8 order.

    Null texts, languages and sources are empty ones; a text without a term, or of any length, counts as it is; a group without kept terms has every
    pair, of value 0 if its language keeps none; repeated rows are documents of their own; ties go by item;
    an empty table gives no rows; other columns, whatever their names, play no part.
    """
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    docs = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), F.col(text).alias("text"))
    kept = materialise(kept_terms(partial_sums(docs), least))
    totals = kept.select("lang", F.explode("sources").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum(F.aggregate("sources", F.lit(0).cast("long"), lambda a, x: a + x["n"])).alias("total_lang"), F.count("*").alias("v"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    codes = numbered(groups.select("lang").distinct(), ["lang"], "lang_id")
    groups = materialise(numbered(groups.join(codes, "lang"), ["lang", "source"], "id"))

    # a pass for each pair of slices of groups that share a language: one pass for up to GROUPS groups
    n = groups.count()
    slices = [groups.filter(F.col("id").between(a + 1, a + GROUPS)) for a in range(0, n, GROUPS)]
    ends = groups.groupBy(F.floor((F.col("id") - 1) / GROUPS).alias("slice")).agg(F.min("lang_id").alias("first"), F.max("lang_id").alias("last")).orderBy("slice").collect()
    share0 = F.expr(f"1 + {int(scale)}L div (total + v)")
    parts = []
    for i, ours in enumerate(slices):
        rows = ours.collect()
        for j, theirs in enumerate(slices):
            if i != j and (ends[j]["first"] > ends[i]["last"] or ends[j]["last"] < ends[i]["first"]):
                continue
            parts.append(_parts(kept, rows, rows if i == j else theirs.collect(), scale, top))
            # what each pair has for terms that neither source has, and so each pair, even without terms; both sides have GROUPS rows at most
            a = ours.select("lang", "source", "id", "v", F.when(F.col("v") > 0, share0).alias("p"))
            b = theirs.select(F.col("lang").alias("of"), F.col("source").alias("item"), F.col("id").alias("other"), F.when(F.col("v") > 0, share0).alias("q"))
            base = a.join(F.broadcast(b), (F.col("lang") == F.col("of")) & (F.col("id") != F.col("other")))
            value = F.when(F.col("v") > 0, F.expr("v * (((p - q) * (p - q)) div q)")).otherwise(F.lit(0))
            parts.append(base.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("decimal(38,0)").alias("value")))
    every = docs.sparkSession.createDataFrame([], PARTS_SCHEMA)
    for part in parts:
        every = every.unionByName(part)
    every = materialise(every)
    # of a group's highest terms, which each task has found so many of, those of each hash bucket go on
    by = lambda *columns: F.row_number().over(Window.partitionBy("lang", "source", *columns).orderBy(F.col("value").desc(), "item"))
    terms = every.filter("part = 'term'").withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(BUCKETS)))
    terms = terms.withColumn("rank", by("bucket")).filter(F.col("rank") <= top).withColumn("rank", by()).filter(F.col("rank") <= top).drop("bucket")
    pairs = every.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", by())
    out = pairs.unionByName(terms)
    return out.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
