"""Registered queries: the engine's operators on the driver's tables, and their SQL equivalents.

Both sides use one fixed public key, so the keyed draws can be compared.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import dates, keyed, quantities
from ..functions.keyed import json_array_col, json_string_col
from ..operators import audit, graph, hot, references, statistics
from .storage import materialise, spread

KEY = bytes(range(32))
DAYS = 30
STRENGTH_PERCENT = 16

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- SQL building blocks


def _pad(byte: int) -> str:
    return bytes(b ^ byte for b in KEY.ljust(64, b"\0")).hex()


def sql_digest(purpose: str, value: str) -> str:
    message = f"encode('[\"{keyed.ALGORITHM}\",\"{purpose}\",' || {value} || ',0]')"
    return f"sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || {message})))"


def sql_modulo(digest: str, upper: str) -> str:
    limb = f"CAST(('0x' || substr({digest}, CAST(i * 4 + 1 AS BIGINT), 4)) AS HUGEINT)"
    return f"CAST(list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(range(16), lambda i: {limb})), lambda rest, limb: (rest * 65536 + limb) % CAST({upper} AS HUGEINT)) AS BIGINT)"


def sql_string(column: str) -> str:
    return f"'\"' || {column} || '\"'"


def _id_json(kind: str, column: Column) -> Column:
    return F.concat(F.lit(f'"{kind}/'), column.cast("string"), F.lit('"'))


def _new_id(identity: Column) -> Column:
    """Replacement id of a resource whose digest is that of its identity."""
    digest = F.sha2(identity, 256)
    return F.concat(F.lit("pert-"), F.substring(keyed.label_col(KEY, "resource", json_array_col(json_string_col(identity), json_string_col(digest))), 1, 32))


def sql_new_id(identity: str) -> str:
    value = f"'[\"' || {identity} || '\",\"' || sha256({identity}) || '\"]'"
    return f"'pert-' || substr({sql_digest('resource', value)}, 1, 32)"


# ---------------------------------------------------------------- deduplication and sources

_DEDUP = """
WITH d AS (SELECT doc_id, source || '/' || lang AS identity, sha256(text) AS digest FROM documents),
firsts AS (SELECT identity, digest, min(doc_id) AS first_doc, count(*) AS occurrences FROM d GROUP BY ALL),
ids AS (SELECT identity, min(first_doc) AS oldest FROM firsts GROUP BY ALL)
SELECT doc_id, d.identity, d.digest, first_doc, occurrences, doc_id <> first_doc AS duplicate, doc_id = first_doc AND first_doc <> oldest AS conflicting
FROM d JOIN firsts USING (identity, digest) JOIN ids USING (identity)
"""


@query(_DEDUP)
def dedup_identity_digest(spark, sf_dir):
    """Keep-first by (identity, digest); later texts of one identity conflict. Sums meet by join, so no identity is gathered in a window."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("identity"), F.sha2("text", 256).alias("digest"))
    firsts = d.groupBy("identity", "digest").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("occurrences"))
    oldest = firsts.groupBy("identity").agg(F.min("first_doc").alias("oldest"))
    out = d.join(firsts, ["identity", "digest"]).join(oldest, "identity")
    first = F.col("doc_id") == F.col("first_doc")
    return out.select("doc_id", "identity", "digest", "first_doc", "occurrences", (~first).alias("duplicate"), (first & (F.col("first_doc") != F.col("oldest"))).alias("conflicting"))


def _canonical_text(text):
    from veilgraph.functions.canonical import parse, render

    return None if text is None else render(parse(text))


@query("SELECT event_id, replace(props, ' ', '') AS payload, sha256(replace(props, ' ', '')) AS digest FROM events")
def canonical_payload_digest(spark, sf_dir):
    """Canonical JSON and its digest, through the codec."""
    canonical = F.udf(_canonical_text, T.StringType(), useArrow=True)
    e = read(spark, sf_dir, "events").select("event_id", canonical("props").alias("payload"))
    return e.select("event_id", "payload", F.sha2("payload", 256).alias("digest"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS number FROM documents)
SELECT doc_id, 'line:' || number AS locator, CAST(length(line) AS INT) AS n_chars, md5(line) AS digest FROM l WHERE regexp_full_match(line, '[ \\t\\r\\f\\v]*') = false
""")
def numbered_line_scan(spark, sf_dir):
    """Lines with their 1-based numbers, blank ones skipped but counted."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.filter(~F.col("line").rlike(r"^[ \t\r\f\x0b]*\z"))
    return lines.select("doc_id", F.concat(F.lit("line:"), F.col("at") + 1).alias("locator"), F.length("line").alias("n_chars"), F.md5("line").alias("digest"))


@query("""
SELECT conv_id, turn, 'source:' || conv_id || ':$' AS context, '$.entry[' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) || '].resource' AS locator,
    count(*) OVER (PARTITION BY conv_id) AS entries FROM conversations
""")
def bundle_unpack_locators(spark, sf_dir):
    """Entries of a bundle with their locators, in order."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("entry"))
    c = c.select("conv_id", F.size("entry").cast("long").alias("entries"), F.posexplode("entry").alias("at", "e"))
    return c.select("conv_id", "e.turn", F.concat(F.lit("source:"), "conv_id", F.lit(":$")).alias("context"), F.concat(F.lit("$.entry["), "at", F.lit("].resource")).alias("locator"), "entries")


_REST = r"^(https?://[^/?#\s]+(?:/[^?#\s]*)?/)([A-Z][A-Za-z0-9]+/[A-Za-z0-9\-.]{1,64})(?:/_history/([A-Za-z0-9\-.]{1,64}))?$"
_REST_URL = "CASE WHEN page_id % 4 = 3 THEN url ELSE regexp_extract(url, '^[a-z]+://[^/]+', 0) || '/fhir/Page/' || page_id || CASE WHEN page_id % 4 = 1 THEN '/_history/' || (page_id % 7) ELSE '' END END"


@query(f"""
WITH u AS (SELECT page_id, {_REST_URL} AS u FROM pages)
SELECT page_id, u AS full_url, nullif(regexp_extract(u, '{_REST}', 1), '') AS base, nullif(regexp_extract(u, '{_REST}', 2), '') AS relative, nullif(regexp_extract(u, '{_REST}', 3), '') AS version FROM u
""")
def rest_url_parts(spark, sf_dir):
    """REST urls split into base, Type/id and version; other urls have none."""
    host = F.regexp_extract("url", "^[a-z]+://[^/]+", 0)
    made = F.concat(host, F.lit("/fhir/Page/"), "page_id", F.when(F.col("page_id") % 4 == 1, F.concat(F.lit("/_history/"), F.col("page_id") % 7)).otherwise(""))
    u = read(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 4 == 3, F.col("url")).otherwise(made).alias("full_url"))
    part = lambda i: F.nullif(F.regexp_extract("full_url", _REST, i), F.lit(""))
    return u.select("page_id", "full_url", part(1).alias("base"), part(2).alias("relative"), part(3).alias("version"))


# ---------------------------------------------------------------- references and ownership

_REFERENCES = """
edges AS (
    SELECT o_orderkey AS edge, 'Customer/' || (CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 10000000 ELSE o_custkey END) AS alias, CAST((o_custkey + o_orderkey % 2) % 25 AS INT) AS context,
        CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 3 AS VARCHAR) END AS version FROM orders
), aliases AS (
    SELECT 'Customer/' || c_custkey AS alias, CAST(c_custkey % 25 AS INT) AS context, CAST(c_custkey % 3 AS VARCHAR) AS version, c_custkey AS resource FROM customer
    UNION ALL SELECT 'Customer/' || c_custkey, CAST((c_custkey + 3) % 25 AS INT), CAST((c_custkey + 1) % 3 AS VARCHAR), -c_custkey FROM customer WHERE c_custkey % 5 = 0
), scoped AS (SELECT e.*, EXISTS (SELECT 1 FROM aliases a WHERE a.alias = e.alias AND a.context = e.context) AS local FROM edges e),
resolved AS (
    SELECT s.edge, count(DISTINCT a.resource) AS n_targets, min(a.resource) AS low FROM scoped s LEFT JOIN aliases a
    ON a.alias = s.alias AND (NOT s.local OR a.context = s.context) AND (s.version IS NULL OR a.version = s.version) GROUP BY s.edge
), statuses AS (
    SELECT edge, CASE n_targets WHEN 1 THEN 'resolved' WHEN 0 THEN 'unresolved' ELSE 'ambiguous' END AS status, CASE WHEN n_targets = 1 THEN CAST(low AS VARCHAR) END AS target, n_targets FROM resolved
)
"""


def _resolved(spark, sf_dir) -> DataFrame:
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    key = F.col("o_custkey") + F.when(F.col("o_orderkey") % 11 == 0, 10000000).otherwise(0)
    edges = o.select(F.col("o_orderkey").alias("edge"), F.concat(F.lit("Customer/"), key).alias("alias"), ((F.col("o_custkey") + F.col("o_orderkey") % 2) % 25).cast("int").alias("context"), F.when(F.col("o_orderkey") % 5 == 0, (F.col("o_orderkey") % 3).cast("string")).alias("version"))
    k = F.col("c_custkey")
    row = lambda df, shift, sign: df.select(F.concat(F.lit("Customer/"), k).alias("alias"), ((k + 3 * shift) % 25).cast("int").alias("context"), ((k + shift) % 3).cast("string").alias("version"), (k * sign).alias("resource"))
    return references.resolve_relative(edges, row(c, 0, 1).unionByName(row(c.filter(k % 5 == 0), 1, -1)))


@query(f"WITH {_REFERENCES} SELECT * FROM statuses")
def resolve_references(spark, sf_dir):
    """Orders point at customers by scoped names: own context first, then all; one target, none, or several."""
    return _resolved(spark, sf_dir).withColumn("target", F.col("target").cast("string"))


@query(f"WITH {_REFERENCES} SELECT status, count(*) AS n FROM statuses GROUP BY status")
def reference_status_counts(spark, sf_dir):
    return _resolved(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("""
WITH RECURSIVE edges AS (
    SELECT 'o' || (o_orderkey // 4 * 4) AS provider, 'o' || o_orderkey AS dependent FROM orders WHERE o_orderkey % 4 <> 0
    UNION ALL SELECT 'o' || l_orderkey, 'l' || l_orderkey || '-' || l_linenumber FROM lineitem
), owned AS (
    SELECT 'o' || o_orderkey AS node, o_custkey AS owner FROM orders WHERE o_orderkey % 3 = 0
    UNION SELECT dependent, owner FROM owned JOIN edges ON provider = node
)
SELECT node, count(*) AS owners, CASE WHEN count(*) = 1 THEN CAST(min(owner) AS VARCHAR) END AS owner FROM owned GROUP BY node
""")
def ownership_fixpoint(spark, sf_dir):
    """Owners spread from orders with a customer to dependent orders and lines until no set grows."""
    o, l = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    order = lambda c: F.concat(F.lit("o"), c)
    k = F.col("o_orderkey")
    seeds = o.filter(k % 3 == 0).select(order(k).alias("node"), F.col("o_custkey").alias("owner"))
    edges = o.filter(k % 4 != 0).select(order(k - k % 4).alias("provider"), order(k).alias("dependent"))
    lines = l.select(order(F.col("l_orderkey")).alias("provider"), F.concat(F.lit("l"), "l_orderkey", F.lit("-"), "l_linenumber").alias("dependent"))
    return graph.unique_owner(graph.ownership(seeds, edges.unionByName(lines))).withColumn("owner", F.col("owner").cast("string"))


@query("""
WITH RECURSIVE n AS (SELECT count(*) AS n FROM part),
edges AS (SELECT p_partkey AS child, (p_partkey * 7) % n AS parent FROM part, n WHERE p_partkey % 5 <> 0),
nodes AS (SELECT child AS node FROM edges UNION SELECT parent FROM edges),
free AS (SELECT node FROM nodes WHERE node NOT IN (SELECT child FROM edges) UNION SELECT child FROM free JOIN edges ON parent = node)
SELECT node FROM nodes WHERE node NOT IN (SELECT node FROM free)
""")
def hierarchy_cycles(spark, sf_dir):
    """Parts that lie in a cycle of a made-up hierarchy, or below one."""
    p = read(spark, sf_dir, "part")
    n = p.count()
    edges = p.filter(F.col("p_partkey") % 5 != 0).select(F.col("p_partkey").alias("child"), (F.col("p_partkey") * 7 % n).alias("parent"))
    return graph.tangled(edges)


@query("""
WITH RECURSIVE n AS (SELECT count(*) AS n FROM part),
edges AS (SELECT p_partkey AS child, (p_partkey * 7) % n AS parent FROM part, n WHERE p_partkey % 5 <> 0 UNION SELECT p_partkey, (p_partkey * 11) % n FROM part, n WHERE p_partkey % 3 = 0),
up AS (SELECT child AS node, parent AS above FROM edges UNION SELECT node, parent FROM up JOIN edges ON child = above),
around AS (SELECT DISTINCT node FROM up WHERE node = above)
SELECT node FROM around UNION SELECT node FROM up WHERE above IN (SELECT node FROM around)
""")
def hierarchy_cycles_of_several_parents(spark, sf_dir):
    """The same where a part may have two parents: one that leads to a cycle is enough."""
    p = read(spark, sf_dir, "part")
    n = p.count()
    edge = lambda rows, times: p.filter(rows).select(F.col("p_partkey").alias("child"), (F.col("p_partkey") * times % n).alias("parent"))
    return graph.tangled(edge("p_partkey % 5 <> 0", 7).unionByName(edge("p_partkey % 3 = 0", 11)))


@query("""
SELECT l_orderkey, l_linenumber, l_returnflag, lines FROM lineitem JOIN (SELECT l_returnflag AS flag, count(*) AS lines FROM lineitem GROUP BY 1) ON flag = l_returnflag
""")
def hot_key_join(spark, sf_dir):
    """A join with three keys, of which each has far more rows than a task's share: the sketch finds them, and their lines stay where they are."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    counts = lines.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("lines"))
    return hot.join(lines, counts, [("l_returnflag", "flag")], unique=True, small=0)


@query("""
SELECT o_orderkey, o_orderstatus, name FROM orders JOIN (SELECT o_orderstatus AS status, n_name AS name FROM nation, (SELECT DISTINCT o_orderstatus FROM orders) WHERE n_regionkey = 1) ON status = o_orderstatus
""")
def hot_key_join_of_several_rows(spark, sf_dir):
    """The same where a key meets several rows: hot keys are dealt out by a salt, and the rows that they meet are repeated."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    names = read(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_name").alias("name"))
    few = orders.select(F.col("o_orderstatus").alias("status")).distinct().join(F.broadcast(names))  # five names
    return hot.join(orders, few, [("o_orderstatus", "status")], unique=False, by=["o_orderkey"], small=0)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def unassigned_anti_join(spark, sf_dir):
    """Customers that no order belongs to."""
    return without(read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


def without(left: DataFrame, right: DataFrame, key: str, of: str) -> DataFrame:
    """The rows of left whose key no row of right has."""
    return left.join(right.select(of), F.col(key) == F.col(of), "left_anti")


# ---------------------------------------------------------------- keyed draws

_CUSTOMER_ID = "'Customer/' || c_custkey"


@query(f"""
SELECT c_custkey, substr({sql_digest('name-family', sql_string('c_name'))}, 1, 16) AS family, substr({sql_digest('address-city', sql_string('c_mktsegment'))}, 1, 16) AS city,
    {sql_new_id(_CUSTOMER_ID)} AS new_id FROM customer
""")
def keyed_labels(spark, sf_dir):
    """Names, places and ids replaced by labels that depend on the key, the purpose and the value."""
    short = lambda purpose, c: F.substring(keyed.label_col(KEY, purpose, json_string_col(F.col(c))), 1, 16)
    return read(spark, sf_dir, "customer").select("c_custkey", short("name-family", "c_name").alias("family"), short("address-city", "c_mktsegment").alias("city"), _new_id(F.concat(F.lit("Customer/"), "c_custkey")).alias("new_id"))


def _draws() -> str:
    d = sql_digest("contact-number", "'[' || c_custkey || ']'")
    return ", ".join(f"{sql_modulo('d', str(upper))} AS below_{name}" for name, upper in (("2", 2), ("61", 61), ("1e10", 10**10), ("2p53", 1 << 53))), d


@query(f"SELECT c_custkey, {_draws()[0]} FROM (SELECT c_custkey, {_draws()[1]} AS d FROM customer)")
def keyed_bounded_draws(spark, sf_dir):
    """Uniform draws below limits that are and aren't powers of two."""
    value = F.concat(F.lit("["), F.col("c_custkey").cast("string"), F.lit("]"))
    limits = {"below_2": 2, "below_61": 61, "below_1e10": 10**10, "below_2p53": 1 << 53}
    return keyed.with_draws(read(spark, sf_dir, "customer").select("c_custkey"), KEY, **{n: ("contact-number", value, limit) for n, limit in limits.items()})


_SYSTEMS = ("phone", "fax", "pager", "sms", "email", "url", "other", None, "")
_SYSTEM_SQL = "CASE c_custkey % 9 " + " ".join(f"WHEN {i} THEN {'NULL' if s is None else repr(s)}" for i, s in enumerate(_SYSTEMS)) + " END"
_CONTACT_VALUE = "'[' || coalesce('\"' || s || '\"', 'null') || ',\"' || c_name || '\"]'"


@query(f"""
WITH c AS (SELECT c_custkey, c_name, {_SYSTEM_SQL} AS s FROM customer),
d AS (SELECT c_custkey, s, {sql_digest('contact-number', _CONTACT_VALUE)} AS number, substr({sql_digest('contact-point', _CONTACT_VALUE)}, 1, 16) AS token FROM c)
SELECT c_custkey, s AS system, CASE WHEN s IN ('phone', 'fax', 'pager', 'sms') THEN '000' || lpad(CAST({sql_modulo('number', str(10**10))} AS VARCHAR), 10, '0')
    WHEN s = 'email' THEN token || '@example.invalid' WHEN s = 'url' THEN 'https://example.invalid/' || token ELSE token END AS value FROM d
""")
def contact_replacements(spark, sf_dir):
    """Contact points replaced by kind: numbers, addresses and links that lead nowhere, else a label."""
    system = F.element_at(F.array(*[F.lit(s) for s in _SYSTEMS]), (F.col("c_custkey") % 9 + 1).cast("int"))
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", system.alias("system"))
    value = json_array_col(F.coalesce(json_string_col(F.col("system")), F.lit("null")), json_string_col(F.col("c_name")))
    c = keyed.with_draws(c, KEY, token=("contact-point", value, None), number=("contact-number", value, 10**10))
    token = F.substring("token", 1, 16)
    number = F.concat(F.lit("000"), F.lpad(F.col("number").cast("string"), 10, "0"))
    made = F.when(F.col("system").isin("phone", "fax", "pager", "sms"), number).when(F.col("system") == "email", F.concat(token, F.lit("@example.invalid"))).when(F.col("system") == "url", F.concat(F.lit("https://example.invalid/"), token)).otherwise(token)
    return c.select("c_custkey", "system", made.alias("value"))


# ---------------------------------------------------------------- dates

_LIMITS = f"""
spans AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day, count(*) AS n FROM orders GROUP BY ALL),
limits AS (SELECT *, CAST(greatest(-{DAYS}, DATE '1994-12-22' - first_day) AS BIGINT) AS low, CAST(least({DAYS}, DATE '2001-08-10' - last_day) AS BIGINT) AS high FROM spans),
drawn AS (SELECT *, CASE WHEN high >= low THEN low + {sql_modulo(sql_digest('date-offset', sql_string("'Customer/' || o_custkey")), "greatest(high - low + 1, 1)")} END AS days FROM limits)
"""


def _offsets(spark, sf_dir) -> DataFrame:
    """One offset per customer from the days that keep all its orders within made-up bounds: ranges meet before the draw, dates are never clipped. None where no day does."""
    day = F.to_date("o_orderdate")
    spans = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n"))
    low = F.greatest(F.lit(-DAYS), F.datediff(F.lit("1994-12-22").cast("date"), "first_day")).cast("long")
    high = F.least(F.lit(DAYS), F.datediff(F.lit("2001-08-10").cast("date"), "last_day")).cast("long")
    limits = spans.withColumn("low", low).withColumn("high", high)
    limits = keyed.with_draws(limits, KEY, drawn=("date-offset", _id_json("Customer", F.col("o_custkey")), None))
    return limits.withColumn("days", F.when(F.col("high") >= F.col("low"), F.col("low") + keyed.modulo_col(F.col("drawn"), F.col("high") - F.col("low") + 1))).drop("drawn")


@query(f"WITH {_LIMITS} SELECT o_custkey, n, low, high, days FROM drawn")
def patient_date_bounds(spark, sf_dir):
    return _offsets(spark, sf_dir).select("o_custkey", "n", "low", "high", "days")


@query(f"""
WITH {_LIMITS} SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS before, strftime(o_orderdate + to_days(CAST(coalesce(days, 0) AS INT)), '%Y-%m-%dT%H:%M:%SZ') AS after
FROM orders JOIN drawn USING (o_custkey)
""")
def patient_date_shift(spark, sf_dir):
    """All dates of a customer move by its offset, if it has one; the time of day stays as written."""
    before = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("of"), before.alias("before"))
    o = o.join(_offsets(spark, sf_dir), F.col("of") == F.col("o_custkey"))
    return o.select("o_orderkey", "before", dates.shift_col(F.col("before"), F.coalesce("days", F.lit(0))).alias("after"))


_FORMS = ("%Y-%m-%d", "%Y-%m", "%Y", "%Y-%m-%dT%H:%M:%SZ", "%Y-13-%d", "%Y-%m-%dT24:%M:%SZ", "%Y-%m-%dT%H:%M:%S+14:30", "%Y-%m-%dT%H:%M")
_JAVA = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"}


def _java(form: str) -> str:
    import re

    return "".join(_JAVA.get(p, f"'{p}'") for p in re.findall(r"%.|[^%]+", form))


@query("WITH o AS (SELECT o_orderkey, CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, f in enumerate(_FORMS)) + """ END AS written FROM orders)
SELECT o_orderkey, written, CASE WHEN o_orderkey % 8 IN (0, 3) THEN 'full' WHEN o_orderkey % 8 IN (1, 2) THEN 'partial_date_preserved' ELSE 'invalid_date' END AS class FROM o
""")
def date_classification(spark, sf_dir):
    """Full, partial and invalid dates told apart."""
    written = F.coalesce(*[F.when(F.col("o_orderkey") % 8 == i, F.date_format("o_orderdate", _java(f))) for i, f in enumerate(_FORMS)])
    o = read(spark, sf_dir, "orders").select("o_orderkey", written.alias("written"))
    return o.select("o_orderkey", "written", dates.classify_col(F.col("written")).alias("class"))


# ---------------------------------------------------------------- quantities

_LINE = "'LineItem/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT)"
_FIELDS = ("quantity", "extendedprice")


def _slot_sql(field: str) -> str:
    return f"'[\"' || root || '\",[[\"key\",\"{field}\"]]]'"


def _scaled_sql(field: str) -> str:
    m = quantities.STEPS
    part = f"(CAST({m} AS HUGEINT) + {STRENGTH_PERCENT - 1} * n_{field})"
    product = f"(abs(c_{field}) * CASE WHEN u_{field} = 1 THEN CAST({100 * m} AS HUGEINT) + {part} ELSE CAST({100 * m} AS HUGEINT) - {part} END)"
    q, r = f"({product} // {100 * m})", f"({product} % {100 * m})"
    return f"CAST(sign(c_{field}) * ({q} + CASE WHEN 2 * {r} > {100 * m} OR (2 * {r} = {100 * m} AND {q} % 2 = 1) THEN 1 ELSE 0 END) AS BIGINT)"


_LINES = f"""
l0 AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, CAST(round(l_quantity * 100) AS HUGEINT) AS c_quantity, CAST(round(l_extendedprice * 100) AS HUGEINT) AS c_extendedprice, {sql_new_id(_LINE)} AS root FROM lineitem),
l1 AS (SELECT *, {', '.join(f"CAST({sql_modulo(sql_digest('quantity-magnitude', _slot_sql(f)), str(1 << 53))} AS HUGEINT) AS n_{f}, {sql_modulo(sql_digest('quantity-sign', _slot_sql(f)), '2')} AS u_{f}" for f in _FIELDS)} FROM l0),
l2 AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, root, {', '.join(f"CAST(c_{f} AS BIGINT) AS {f}_before, {_scaled_sql(f)} AS {f}_after" for f in _FIELDS)} FROM l1)
"""


def _lines(spark, sf_dir) -> DataFrame:
    """Lines with both measures before and after scaling, in hundredths."""
    l = read(spark, sf_dir, "lineitem")
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    identity = F.concat(F.lit("LineItem/"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents("l_extendedprice")))
    l = spread(l.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", identity.alias("identity"), *[cents(f"l_{f}").alias(f"{f}_before") for f in _FIELDS]))
    kept = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", *[f"{f}_before" for f in _FIELDS]]
    l = quantities.scaled_rows(l, KEY, Decimal(STRENGTH_PERCENT) / 100, "root", "identity", {f"{f}_before": f for f in _FIELDS}, kept)
    return l.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "root", *[f"{f}_{x}" for f in _FIELDS for x in ("before", "after")])


@query(f"WITH {_LINES} SELECT l_orderkey, l_linenumber, quantity_before, quantity_after, extendedprice_before, extendedprice_after FROM l2")
def quantity_perturb(spark, sf_dir):
    """Each measure of each line scaled by a keyed factor of its own, exactly, rounded half to even."""
    return _lines(spark, sf_dir).drop("root", "l_returnflag", "l_linestatus")


@query("SELECT l_orderkey, l_linenumber, l_returnflag AS system, l_linestatus AS code FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('N', 'O'))")
def unit_registry_filter(spark, sf_dir):
    """Rows whose exact (system, code) pair is registered; the registry is fixed and small, so it is sent to all."""
    units = spark.createDataFrame([("A", "F"), ("N", "O")], "system string, code string")
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("system"), F.col("l_linestatus").alias("code"))
    return l.join(F.broadcast(units), ["system", "code"], "left_semi").select("l_orderkey", "l_linenumber", "system", "code")


# ---------------------------------------------------------------- ledger, validation, statistics

_LEDGER = " UNION ALL ".join(f"SELECT root, '[[\"key\", \"{f}\"]]' AS path, {f}_before AS old_value, {f}_after AS new_value, 'field_quantity_scale' AS reason FROM l2 WHERE {f}_before <> {f}_after" for f in _FIELDS)


def _long(spark, sf_dir) -> DataFrame:
    lines = _lines(spark, sf_dir)
    cell = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_before").alias("old_value"), F.col(f"{f}_after").alias("new_value")) for f in _FIELDS]))
    return lines.select("root", "l_returnflag", "l_linestatus", cell.alias("cell")).select("root", "l_returnflag", "l_linestatus", "cell.*")


@query(f"WITH {_LINES} {_LEDGER}")
def change_ledger(spark, sf_dir):
    """A row for each changed cell: where, before, after, why."""
    path = F.concat(F.lit('[["key", "'), "field", F.lit('"]]'))
    return _long(spark, sf_dir).filter("old_value <> new_value").select("root", path.alias("path"), "old_value", "new_value", F.lit("field_quantity_scale").alias("reason"))


@query(f"""
WITH {_LINES}, changes AS ({_LEDGER}),
undone AS (SELECT l2.root, sha256(l2.quantity_before || '|' || l2.extendedprice_before) AS digest, sha256(coalesce(q.old_value, l2.quantity_after) || '|' || coalesce(p.old_value, l2.extendedprice_after)) AS restored,
    CAST(q.root IS NOT NULL AS BIGINT) + CAST(p.root IS NOT NULL AS BIGINT) AS n
    FROM l2 LEFT JOIN changes q ON q.root = l2.root AND q.path LIKE '%quantity%' LEFT JOIN changes p ON p.root = l2.root AND p.path LIKE '%extendedprice%')
SELECT count(*) AS roots_checked, CAST(sum(n) AS BIGINT) AS changes_checked, count(*) FILTER (digest <> restored) AS mismatches FROM undone
""")
def undo_validation(spark, sf_dir):
    """Undoing the ledger in the written output restores every digest.

    Output and ledger are written first, and what is read back is compared with digests of the source, so the proof
    can fail. Both are grouped by root once; draws are made once.
    """
    lines = materialise(_lines(spark, sf_dir).select("root", *[f"{f}_{x}" for f in _FIELDS for x in ("before", "after")]))
    cell = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_before").alias("old_value"), F.col(f"{f}_after").alias("new_value")) for f in _FIELDS]))
    ledger = lines.select("root", cell.alias("c")).select("root", "c.*").filter("old_value <> new_value")
    output = lines.select("root", F.sha2(F.concat_ws("|", *[f"{f}_before" for f in _FIELDS]), 256).alias("digest"), *[f"{f}_after" for f in _FIELDS])
    old = lambda f: F.max(F.when(F.col("field") == f, F.col("old_value"))).alias(f"{f}_old")
    changes = ledger.groupBy("root").agg(F.count("*").alias("n"), *[old(f) for f in _FIELDS])
    both = output.join(changes, "root", "left")
    restored = F.sha2(F.concat_ws("|", *[F.coalesce(f"{f}_old", f"{f}_after") for f in _FIELDS]), 256)
    return both.agg(F.count("*").alias("roots_checked"), F.sum(F.coalesce("n", F.lit(0))).alias("changes_checked"), F.count_if(F.col("digest") != restored).alias("mismatches"))


@query(f"""
WITH {_LINES}, {_LIMITS}, acts AS ({' UNION ALL '.join(f"SELECT 'LineItem' AS type, '{f}' AS path, CASE WHEN {f}_before <> {f}_after THEN 'changed' ELSE 'preserved' END AS action, 'field_quantity_scale' AS reason FROM l2" for f in _FIELDS)}
    UNION ALL SELECT 'Order', 'orderdate', CASE WHEN days IS NULL THEN 'preserved' WHEN days = 0 THEN 'preserved' ELSE 'changed' END, CASE WHEN days IS NULL THEN 'shared_or_unassigned' ELSE 'patient_date_shift' END FROM orders LEFT JOIN drawn USING (o_custkey))
SELECT type, path, action, reason, count(*) AS frequency FROM acts GROUP BY ALL
""")
def field_action_counts(spark, sf_dir):
    """What was done to each field, and why, counted."""
    changed = lambda c: F.when(c, "changed").otherwise("preserved")
    lines = _long(spark, sf_dir).select(F.lit("LineItem").alias("type"), F.col("field").alias("path"), changed(F.col("old_value") != F.col("new_value")).alias("action"), F.lit("field_quantity_scale").alias("reason"))
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("of")).join(_offsets(spark, sf_dir), F.col("of") == F.col("o_custkey"), "left")
    reason = F.when(F.col("days").isNull(), "shared_or_unassigned").otherwise("patient_date_shift")
    orders = o.select(F.lit("Order").alias("type"), F.lit("orderdate").alias("path"), changed(F.coalesce(F.col("days") != 0, F.lit(False))).alias("action"), reason.alias("reason"))
    return lines.unionByName(orders).groupBy("type", "path", "action", "reason").agg(F.count("*").alias("frequency"))


def _ranks(n: str) -> str:
    return ", ".join(f"min(value) FILTER (upto >= (total * {p} + 99) // 100) AS p{p:02d}" for p in statistics.PERCENTS)


@query(f"""
WITH {_LINES}, phases AS ({' UNION ALL '.join(f"SELECT l_returnflag, l_linestatus, '{f}' AS field, '{phase}' AS phase, {f}_{phase} AS value FROM l2" for f in _FIELDS for phase in ("before", "after"))}),
freq AS (SELECT l_returnflag, l_linestatus, field, phase, value, count(*) AS c FROM phases GROUP BY ALL),
run AS (SELECT *, sum(c) OVER (PARTITION BY l_returnflag, l_linestatus, field, phase ORDER BY value) AS upto, sum(c) OVER (PARTITION BY l_returnflag, l_linestatus, field, phase) AS total FROM freq)
SELECT l_returnflag, l_linestatus, field, phase, CAST(any_value(total) AS BIGINT) AS n, min(value) AS minimum, max(value) AS maximum, {_ranks('total')} FROM run GROUP BY ALL
""")
def numeric_context_summary(spark, sf_dir):
    """Exact weighted nearest-rank quantiles of each measure before and after."""
    phase = F.explode(F.array(F.struct(F.lit("before").alias("phase"), F.col("old_value").alias("value")), F.struct(F.lit("after").alias("phase"), F.col("new_value").alias("value"))))
    rows = _long(spark, sf_dir).select("l_returnflag", "l_linestatus", "field", phase.alias("x")).select("l_returnflag", "l_linestatus", "field", "x.*", F.lit(1).alias("c"))
    return statistics.nearest_rank(rows, ["l_returnflag", "l_linestatus", "field", "phase"], ["value"], "value", "c")


@query("""
WITH d AS (SELECT doc_id, source, sha256(text) AS digest FROM documents),
firsts AS (SELECT digest, arg_min(source, doc_id) AS source, min(doc_id) AS doc_id FROM d GROUP BY digest)
SELECT source, count(*) AS records, min(doc_id) AS first_record, min(digest) AS lowest FROM firsts GROUP BY source
""")
def first_occurrence_plan(spark, sf_dir):
    """Each text goes to the file of its first occurrence."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    firsts = d.groupBy("digest").agg(F.min_by("source", "doc_id").alias("source"), F.min("doc_id").alias("doc_id"))
    return firsts.groupBy("source").agg(F.count("*").alias("records"), F.min("doc_id").alias("first_record"), F.min("digest").alias("lowest"))


@query("""
SELECT sha256(string_agg(line, chr(10) ORDER BY part, key)) AS fingerprint, count(*) AS n FROM (
    SELECT 0 AS part, r_regionkey AS key, '[' || r_regionkey || ',"' || r_name || '"]' AS line FROM region
    UNION ALL SELECT 1, n_nationkey, '[' || n_nationkey || ',"' || n_name || '",' || n_regionkey || ']' FROM nation)
""")
def snapshot_fingerprint(spark, sf_dir):
    """One digest over canonical rows in order; the tables are fixed and tiny."""
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    rows = r.select(F.lit(0).alias("part"), F.col("r_regionkey").alias("key"), json_array_col(F.col("r_regionkey").cast("string"), json_string_col(F.col("r_name"))).alias("line"))
    rows = rows.unionByName(n.select(F.lit(1).alias("part"), F.col("n_nationkey").alias("key"), json_array_col(F.col("n_nationkey").cast("string"), json_string_col(F.col("n_name")), F.col("n_regionkey").cast("string")).alias("line")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("part", "key", "line"))), lambda x: x["line"])
    return rows.agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("fingerprint"), F.count("*").alias("n"))


@query("""
WITH n AS (
    SELECT 'Order' AS type, '$' AS path, 'object' AS kind FROM orders UNION ALL SELECT 'Order', '$["key"]', 'number' FROM orders UNION ALL SELECT 'Order', '$["status"]', 'string' FROM orders
    UNION ALL SELECT 'Order', '$["line"]', 'array' FROM orders UNION ALL SELECT 'Order', '$["line"][*]', 'object' FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey
    UNION ALL SELECT 'Order', '$["line"][*]["number"]', 'number' FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey)
SELECT type, path, kind, count(*) AS n FROM n GROUP BY ALL
""")
def walk_nodes(spark, sf_dir):
    """Orders with their lines as documents, walked node by node with the document walker."""
    from ..functions.walk import node_counts

    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("number"))).alias("line"))
    o = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    line = F.coalesce("line", F.array().cast("array<struct<number:int>>"))
    docs = o.select(F.to_json(F.struct(F.lit("Order").alias("resourceType"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), line.alias("line"))).alias("payload"))
    return node_counts(docs, "payload").filter("path <> '$[\"resourceType\"]'").groupBy("type", "path", "kind").agg(F.sum("n").alias("n"))


@query("""
WITH post AS (SELECT quality, toxic FROM labels), pre AS (SELECT quality, toxic FROM labels WHERE doc_id % 3 <> 0)
SELECT quality, toxic, count(*) AS n FROM (SELECT * FROM post EXCEPT ALL SELECT * FROM pre) GROUP BY ALL
""")
def multiset_diff(spark, sf_dir):
    """What is in one multiset of diagnostics beyond another."""
    post = read(spark, sf_dir, "labels")
    return audit.multiset_difference(post, post.filter("doc_id % 3 <> 0"), ["quality", "toxic"])


@query("""
SELECT kind, arg_min(page_id, (CASE WHEN ends_with(url, '.html') THEN 0 ELSE 1 END, url, page_id)) AS page_id, count(*) AS candidates FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS kind FROM pages) GROUP BY kind
""")
def sample_selection(spark, sf_dir):
    """One page per host: a preferred form first, else the first by name."""
    p = read(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("kind"))
    rank = F.struct(F.when(F.col("url").endswith(".html"), 0).otherwise(1).alias("form"), "url", "page_id")
    return p.groupBy("kind").agg(F.min(rank)["page_id"].alias("page_id"), F.count("*").alias("candidates"))


_PAGE = "CASE page_id % 9 WHEN 0 THEN 'Patient' WHEN 1 THEN 'Bundle' WHEN 2 THEN 'CodeSystem' WHEN 3 THEN 'ValueSet' ELSE 'Kind' || (page_id % 9) END"
_NAME = "CASE WHEN page_id % 31 = 0 THEN 'package/' || kind || '-example.json' ELSE 'package/' || substr(md5(url), 1, 12) || '-' || page_id || '.json' END"


@query(f"""WITH p AS (SELECT *, {_PAGE} AS kind FROM pages), e AS (SELECT kind, {_NAME} AS name FROM p)
SELECT kind, name FROM e WHERE kind IN ('Bundle', 'Patient', 'Observation')
UNION ALL SELECT kind, arg_min(name, (CASE WHEN name = 'package/' || kind || '-example.json' THEN 0 ELSE 1 END, name)) FROM e WHERE kind NOT IN ('Bundle', 'Patient', 'Observation') GROUP BY kind""")
def audit_examples(spark, sf_dir):
    """Examples for an audit: some kinds whole, one of each other."""
    p = read(spark, sf_dir, "pages").withColumn("kind", F.expr(_PAGE))
    return audit.select_examples(p.select("kind", F.expr(_NAME).alias("name")))


@query(f"""WITH p AS (SELECT *, {_PAGE} AS kind, 'case' || (page_id % 5) AS "case", lpad(CAST(page_id AS VARCHAR), 9, '0') AS name FROM pages)
SELECT "case", kind, name FROM p WHERE kind NOT IN ('CodeSystem', 'ValueSet') UNION ALL SELECT "case", kind, min(name) FROM p WHERE kind IN ('CodeSystem', 'ValueSet') GROUP BY ALL""")
def audit_validation_sample(spark, sf_dir):
    """Roots that a validator is given: all, but of defining kinds one a case."""
    p = read(spark, sf_dir, "pages").select(F.expr(_PAGE).alias("kind"), F.concat(F.lit("case"), F.col("page_id") % 5).alias("case"), F.lpad(F.col("page_id").cast("string"), 9, "0").alias("name"))
    return audit.sample_for_validation(p)


_SEVERITY = "CASE event_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'fatal' ELSE 'information' END"
_WHERE = "('Bundle.entry[' || (event_id % 3) || '].resource/*Patient/' || substr(md5(CAST(event_id AS STRING)), 1, 8) || '*/.name')"
_SCRUBBED = "('Bundle.entry[' || (event_id % 3) || '].resource/*Patient*/.name')"
_KEY_SQL = f"('[\"' || {_SEVERITY} || '\",\"' || event_type || '\",[\"' || {_SCRUBBED} || '\"],' || CASE WHEN event_id % 6 = 5 THEN '\"odd \\\"text\\\"\"' ELSE '[\"VALIDATION_' || (event_id % 2) || '\"]' END || ']')"


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    ids = F.when(F.col("event_id") % 6 == 5, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("VALIDATION_"), F.col("event_id") % 2)))
    key = audit.issue_key(F.expr(_SEVERITY), F.col("event_type"), F.array(F.expr(_WHERE)), ids, F.lit('odd "text"'))
    return e.select("event_id", (F.col("user_id") % 50).alias("file"), F.expr(_SEVERITY).alias("severity"), key.alias("key"))


@query(f"SELECT event_id, {_KEY_SQL} AS key FROM events")
def audit_issue_keys(spark, sf_dir):
    """What makes diagnostics alike, changing ids left out."""
    return _diagnostics(spark, sf_dir).select("event_id", "key")


@query(f"""WITH d AS (SELECT event_id, user_id % 50 AS file, {_SEVERITY} AS severity, {_KEY_SQL} AS key FROM events), pre AS (SELECT * FROM d WHERE event_id % 5 <> 0), post AS (SELECT * FROM d WHERE event_id % 7 <> 0),
new AS (SELECT file, count(*) AS n FROM (SELECT file, key FROM post WHERE severity IN ('error', 'fatal') EXCEPT ALL SELECT file, key FROM pre WHERE severity IN ('error', 'fatal')) GROUP BY file),
a AS (SELECT file, count(*) FILTER (severity IN ('error', 'fatal')) AS e, count(*) FILTER (severity = 'warning') AS w FROM pre GROUP BY file), b AS (SELECT file, count(*) FILTER (severity IN ('error', 'fatal')) AS e, count(*) FILTER (severity = 'warning') AS w FROM post GROUP BY file)
SELECT file, coalesce(a.e, 0) AS before_errors, coalesce(b.e, 0) AS after_errors, CAST(coalesce(n, 0) AS BIGINT) AS new_errors, coalesce(a.w, 0) AS before_warnings, coalesce(b.w, 0) AS after_warnings FROM a FULL JOIN b USING (file) LEFT JOIN new USING (file)""")
def audit_comparison(spark, sf_dir):
    """Diagnostics before and after, file by file: what is there that wasn't, repeats counted."""
    d = _diagnostics(spark, sf_dir)
    return audit.compare(d.filter("event_id % 5 <> 0"), d.filter("event_id % 7 <> 0"))


_ODD_ID = "CASE page_id % 4 WHEN 0 THEN 'p' || page_id WHEN 1 THEN url WHEN 2 THEN NULL ELSE 'a.b-' || page_id || chr(10) END"
_ODD_REF = "CASE page_id % 3 WHEN 0 THEN 'Patient/p' || page_id WHEN 1 THEN 'Patient/p/_history/' || page_id ELSE url END"


@query(f"SELECT page_id, coalesce(NOT regexp_full_match({_ODD_ID}, '[A-Za-z0-9.\\-]{{1,64}}'), false) AS invalid, CASE WHEN page_id % 3 = 0 THEN 'p' || page_id END AS patient FROM pages")
def audit_predicates(spark, sf_dir):
    """Malformed ids, and exact relative references to patients."""
    return read(spark, sf_dir, "pages").select("page_id", audit.invalid_id(F.expr(_ODD_ID)).alias("invalid"), audit.patient_id(F.expr(_ODD_REF)).alias("patient"))


@query("""
SELECT (SELECT count(*) FROM documents) > 0 AS has_documents, NOT EXISTS (SELECT 1 FROM documents WHERE text IS NULL) AS no_missing_text,
    (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)) AS repeated_ids
""")
def gate_checks(spark, sf_dir):
    """Existence and uniqueness gates, as one row."""
    ids = read(spark, sf_dir, "documents").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("missing"))
    return ids.agg((F.count("*") > 0).alias("has_documents"), (F.coalesce(F.sum("missing"), F.lit(0)) == 0).alias("no_missing_text"), F.count_if(F.col("n") > 1).alias("repeated_ids"))


@query("""
WITH d AS (SELECT source || '/' || lang AS identity, sha256(text) AS digest, source FROM documents), r AS (SELECT DISTINCT identity, digest FROM d)
SELECT (SELECT count(*) FROM d) AS occurrences, (SELECT count(*) FROM r) AS resources, (SELECT count(*) FROM d) - (SELECT count(*) FROM r) AS duplicates, (SELECT count(DISTINCT source) FROM d) AS sources
""")
def ingest_report(spark, sf_dir):
    """Counts of a load: occurrences, resources, duplicates, sources."""
    d = read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("identity"), F.sha2("text", 256).alias("digest"), "source")
    r = d.groupBy("identity", "digest").agg(F.count("*").alias("n"), F.min("source").alias("source"))
    return r.agg(F.sum("n").alias("occurrences"), F.count("*").alias("resources"), (F.sum("n") - F.count("*")).alias("duplicates"), F.count_distinct("source").alias("sources"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a keyed name and how many orders moved by how many days."""
    labels = keyed_labels(spark, sf_dir)
    return labels.join(_offsets(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "family", "new_id", "n", "days")
