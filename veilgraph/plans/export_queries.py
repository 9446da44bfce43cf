"""Registered queries that run the whole engine: exports made of the driver's tables are scanned, indexed, perturbed, proved and written.

Customers become patients, orders measurements, conversations bundles of messages, regions and nations a bundle of
places; events become a second export of faulty documents. The files are written with the engine's own sink. The SQL makes the same
documents, and says what the index, the ledger and the written files must hold. What a run makes is kept for the other queries of the process.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keyed, quantities
from ..functions.keyed import json_string_col
from ..sources import exports, layout
from ..sources.files import Place
from . import index, perturbation
from .registry import DAYS, KEY, STRENGTH_PERCENT, query, read, sql_digest, sql_modulo
from .storage import delete, plain, private_folder, scope, shared_dir, tidy

UCUM = "http://unitsofmeasure.org"
BASE = "https://wards.example/fhir/"


# ---------------------------------------------------------------- documents, for both engines


def made(template: str, **parts: str) -> str:
    """SQL that puts expressions in the places <name> of a text; both engines read it."""
    out = []
    for at, piece in enumerate(re.split(r"<(\w+)>", template)):
        if at % 2:
            out.append(f"CAST({parts[piece]} AS STRING)")
        elif piece:
            out.append("'" + piece.replace("'", "''") + "'")
    return "(" + " || ".join(out) + ")"


_SYSTEM = "CASE c_custkey % 3 WHEN 0 THEN 'phone' WHEN 1 THEN 'email' ELSE 'url' END"
_BORN = "(DATE '1940-01-01' + CAST(c_custkey % 18000 AS INT))"
_PERSON = '{"address":[{"city":"<city>","line":["<way>"]}],"birthDate":"<born>","id":"<id>","identifier":[{"system":"urn:customers","value":"<number>"}],"managingOrganization":{"reference":"Organization/<org>"},"name":[{"family":"<family>","given":["<given>","<second>"]}],"resourceType":"Patient","telecom":[{"system":"<system>","value":"<tel>"}]}'
#: As it stands in the file: other order, blanks.
_PERSON_LINE = '{"resourceType": "Patient", "id": "<id>", "name": [{"given": ["<given>", "<second>"], "family": "<family>"}], "telecom": [{"value": "<tel>", "system": "<system>"}], "address": [{"line": ["<way>"], "city": "<city>"}], "identifier": [{"value": "<number>", "system": "urn:customers"}], "birthDate": "<born>", "managingOrganization": {"reference": "Organization/<org>"}}'
PERSON = {"city": "c_mktsegment", "way": "('Way ' || c_custkey)", "born": _BORN, "id": "('c' || c_custkey)", "number": "c_custkey", "org": "('r' || (c_nationkey % 5))", "family": "c_name", "given": "c_mktsegment", "second": "('N' || c_nationkey)", "system": _SYSTEM, "tel": "c_name"}

_PRICE = "CAST(o_totalprice AS DECIMAL(18,2))"
_WHEN = "(CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T00:00:00Z')"
_DEVICE = '{"id":"<dev>","resourceType":"Device","status":"<devstatus>"}'
_INSIDE = '"contained":[<device>],"device":{"reference":"#<dev>"},'
_VISIT = '{"code":{"coding":[{"code":"<prio>","system":"urn:codes"}]},<inside>"effectiveDateTime":"<when>","id":"<id>","resourceType":"Observation","status":"final","subject":{"reference":"<subject>"},"valueQuantity":{"code":"mg/dL","system":"http://unitsofmeasure.org","unit":"mg/dL","value":<value>}}'
_HAS_DEVICE, _LOST = "o_orderkey % 7 = 0", "o_orderkey % 11 = 0"


def _visit(**parts: str) -> str:
    device = made(_DEVICE, dev=parts.pop("dev"), devstatus="o_orderstatus")
    inside = f"CASE WHEN {_HAS_DEVICE} THEN {made(_INSIDE, device=device, dev=parts.pop('ref'))} ELSE '' END"
    return made(_VISIT, inside=inside, prio="o_orderpriority", **parts)


_SUBJECT = f"(CASE WHEN {_LOST} THEN 'Patient/x' ELSE 'Patient/c' END || o_custkey)"
VISIT = {"dev": "'d'", "ref": "'d'", "when": _WHEN, "id": "('o' || o_orderkey)", "subject": _SUBJECT, "value": _PRICE}
DEVICE = made(_DEVICE, dev="'d'", devstatus="o_orderstatus")

_TALK = '{"id":"<id>","payload":[{"contentString":<text>}],"resourceType":"Communication","sent":"<sent>","status":"completed","subject":{"reference":"<subject>"}}'
_SENT = "(CAST(DATE '2024-01-01' + CAST(i % 28 AS INT) AS STRING) || 'T10:00:00+01:00')"
TALK = {"id": "('v' || conv_id || '-' || i)", "text": "quoted", "sent": _SENT, "subject": "('Patient/c' || (conv_id % people))"}
_ORG = '{"id":"<id>","name":"<name>","resourceType":"Organization"}'
ORG = {"id": "('r' || r_regionkey)", "name": "r_name"}
_PLACE = '{"id":"<id>","managingOrganization":{"reference":"Organization/<org>"},"name":"<name>","resourceType":"Location"}'
PLACE = {"id": "('n' || n_nationkey)", "name": "n_name", "org": "('r' || n_regionkey)"}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, n, line) of the export: n orders the lines of a file."""
    part = lambda df, source, order, line: df.select(F.lit(source).alias("source_id"), F.struct(*order).alias("order"), F.expr(line).alias("line"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    customers, orders = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    rows = part(customers, 1, [one.alias("a"), F.col("c_custkey").alias("b"), none.alias("c")], made(_PERSON_LINE, **PERSON))
    # a bundle for each conversation; the file begins with a byte order mark
    talks = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("e"))
    talks = talks.select("conv_id", F.posexplode("e").alias("i", "m")).select("conv_id", "i", json_string_col(F.col("m.text")).alias("quoted"), F.lit(customers.count()).alias("people"))
    talks = talks.select("conv_id", F.struct("i", F.expr(made('{"resource":<r>}', r=made(_TALK, **TALK))).alias("t")).alias("e"))
    talks = talks.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda x: x["t"]), ",").alias("entries"))
    first = talks.agg(F.min("conv_id")).first()[0] or 0
    talks = talks.withColumn("mark", F.when(F.col("conv_id") == first, "﻿").otherwise(""))
    rows = rows.unionByName(part(talks, 2, [one.alias("a"), F.col("conv_id").alias("b"), none.alias("c")], made('<mark>{"resourceType":"Bundle","type":"collection","entry":[<entries>]}', mark="mark", entries="entries")))
    # blank lines stand between the orders, and some come twice
    order = lambda a, c: [F.lit(a).cast("long").alias("a"), F.col("o_orderkey").alias("b"), F.lit(c).cast("long").alias("c")]
    visit = _visit(**VISIT)
    for df, a, c, line in ((orders.filter("o_orderkey % 17 = 0"), 1, 0, "'  '"), (orders, 1, 1, visit), (orders.filter("o_orderkey % 13 = 0"), 2, 1, visit)):
        rows = rows.unionByName(part(df, 3, order(a, c), line))
    entry = lambda df, key, a, doc, kind: df.select(F.struct(F.lit(a).alias("a"), F.col(key).cast("int").alias("k"), F.expr(made('{"fullUrl":"<url>","resource":<r>}', url=f"('{BASE}{kind}/{kind[0].lower() if kind != 'Location' else 'n'}' || {key})".replace("Organization/o", "Organization/r"), r=doc)).alias("t")).alias("e"))
    places = entry(read(spark, sf_dir, "region"), "r_regionkey", 0, made(_ORG, **ORG), "Organization").unionByName(entry(read(spark, sf_dir, "nation"), "n_nationkey", 1, made(_PLACE, **PLACE), "Location"))
    # some thirty rows, whatever the scale
    ward = places.agg(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda x: x["t"]), ",").alias("entries"))
    return rows.unionByName(part(ward, 4, [one.alias("a"), one.alias("b"), none.alias("c")], made('{"resourceType":"Bundle","type":"searchset","entry":[<entries>]}', entries="entries")))


#: Documents of the faulty export by the remainder of an event's number, with severity and code of what is found; null: nothing.
FAULTS = [
    ('{"resourceType": "Basic", "id": "b<k>"}', None, None),
    ('{"resourceType": "Basic", "id": "b<k>"', "error", "invalid_json"),
    ('{"resourceType": "Basic", "id": "b<k>", "x": NaN}', "error", "invalid_json"),
    ('{"resourceType": "Basic", "id": "b<k>", "id": "b"}', "error", "invalid_json"),
    ("[1, <k>]", "error", "invalid_resource"),
    ('{"resourceType": "basic", "id": "b<k>"}', "error", "invalid_resource_type"),
    ('{"resourceType": "Basic", "id": "b <k>"}', "error", "invalid_resource_id"),
    ('{"resourceType": "Basic", "id": "b<k>", "meta": []}', "error", "invalid_meta"),
    ('{"resourceType": "Basic", "id": "b<k>", "meta": {"versionId": <k>}}', "error", "invalid_version_id"),
    ('{"resourceType": "Basic", "id": "b<k>", "meta": {"profile": [""]}}', "error", "invalid_profile_declaration"),
    ('{"resourceType": "Basic", "id": "b<k>", "contained": {}}', "error", "invalid_contained"),
    ('{"resourceType": "Basic", "id": "b<k>", "subject": {"reference": <k>}}', "error", "invalid_reference"),
    ('{"resourceType": "Basic", "id": "b<k>", "subject": {"identifier": {"value": "<k>"}}}', "warning", "logical_reference_unresolved"),
    ('{"resourceType": "Bundle", "type": "odd", "entry": []}', "error", "invalid_bundle_type"),
    ('{"resourceType": "Bundle", "type": "collection", "entry": [<k>]}', "error", "invalid_bundle_entry"),
    ('{"resourceType": "Bundle", "type": "collection", "entry": [{}]}', "error", "bundle_entry_without_resource"),
    ('{"resourceType": "Bundle", "type": "collection", "entry": [{"fullUrl": "nowhere<k>", "resource": {"resourceType": "Basic", "id": "b<k>"}}]}', "error", "invalid_full_url"),
    ('{"resourceType": "Bundle", "type": "collection", "entry": [{"fullUrl": "http://h/Basic/a<k>", "resource": {"resourceType": "Basic", "id": "b<k>"}}]}', "error", "full_url_identity_mismatch"),
    ('{"resourceType": "Observation", "id": "b<k>", "component": {}}', "error", "invalid_observation_components"),
    ('{"resourceType": "Observation", "id": "b<k>", "valueString": "<k>", "valueInteger": <k>}', "error", "observation_value_conflict"),
    ('{"resourceType": "CapabilityStatement", "id": "b<k>", "fhirVersion": "3.0.2"}', "error", "incompatible_fhir_version_declaration"),
    ('{"resourceType": "Basic", "id": "b<k>", "contained": [{"resourceType": "Device", "status": "<k>"}]}', "error", "contained_resource_without_id"),
    ('{"resourceType": "Encounter", "id": "b<k>", "partOf": {"reference": "Encounter/b<k>"}}', "error", "encounter_cycle_or_dependency"),
]
_FAULTY = "CASE event_id % " + str(len(FAULTS)) + " " + " ".join(f"WHEN {i} THEN {made(doc, k='event_id')}" for i, (doc, _, _) in enumerate(FAULTS)) + " END"


# ---------------------------------------------------------------- runs, kept for the process

_runs: dict[tuple, Path] = {}


def _folder(spark: SparkSession) -> Path:
    """A private folder of this process in the shared one, which the engine's sink needs to be a plain path."""
    place = f"{shared_dir(spark)}/veilgraph-queries-{spark.sparkContext.applicationId}"
    if plain(place) is None:
        raise RuntimeError("exports are written to a folder that is mounted on driver and executors")
    if (spark.sparkContext.applicationId,) not in _runs:
        import atexit

        private_folder(spark, place)
        _runs[(spark.sparkContext.applicationId,)] = plain(place)
        atexit.register(delete, None, place)
    return _runs[(spark.sparkContext.applicationId,)]


def _kept(spark: SparkSession, sf_dir: str, name: str, make) -> Path:
    """The folder that `make` has filled, once for a process and the tables as they are."""
    at = (spark.sparkContext.applicationId, sf_dir, Place(spark, sf_dir).stamp(), name)
    if at not in _runs:
        out = _folder(spark) / f"{name}-{len(_runs)}"
        make(out)
        _runs[at] = out
    return _runs[at]


def _write(rows: DataFrame, names: dict[int, str], folder: Path) -> None:
    """Lines (source_id, order, line) to files, by the engine's sink, which orders by number."""
    from ..operators.ranks import numbered

    with scope(rows.sparkSession):
        rows = numbered(rows, ["source_id", "order"], "root_id")
        counts = {r["source_id"]: r["count"] for r in rows.groupBy("source_id").count().collect()}
        plans = [{"source_id": i, "file": name, "records": counts.get(i, 0), "compressed": name.endswith(".gz")} for i, name in names.items()]
        layout.write(rows.select("source_id", "root_id", "line"), plans, Place(rows.sparkSession, folder))


def export(spark: SparkSession, sf_dir: str) -> Path:
    names = {1: "people.ndjson", 2: "talks.ndjson", 3: "visits.ndjson.gz", 4: "wards.json"}
    return _kept(spark, sf_dir, "export", lambda out: _write(_documents(tidy(spark), sf_dir), names, out))


def faulty(spark: SparkSession, sf_dir: str) -> Path:
    rows = lambda: read(tidy(spark), sf_dir, "events").select(F.lit(1).alias("source_id"), F.struct("event_id").alias("order"), F.expr(_FAULTY).alias("line"))
    return _kept(spark, sf_dir, "faulty", lambda out: _write(rows(), {1: "events.jsonl"}, out))


def indexed(spark: SparkSession, sf_dir: str, which=export) -> Path:
    return _kept(spark, sf_dir, f"index-{which.__name__}", lambda out: index.ingest([which(spark, sf_dir)], out, spark=spark))


def perturbed(spark: SparkSession, sf_dir: str) -> Path:
    """A run with the fixed public key, which it takes over from a run file as a second run would."""

    def run(out: Path) -> None:
        source, settings = indexed(spark, sf_dir), perturbation.validate_settings(Decimal(STRENGTH_PERCENT) / 100, DAYS)
        tables, _ = index.open_index(tidy(spark), source)
        before = {"schema_version": perturbation.STATE_VERSION, "status": "completed", "algorithm": keyed.ALGORITHM, "run_key": KEY.hex(), "source_fingerprint": perturbation.fingerprint_of(spark, Place(spark, source), tables), "definitions": perturbation.definitions(), "settings": {k: str(v) for k, v in settings.items()}}
        state = _folder(spark) / f"key-{len(_runs)}.json"
        Place(spark, state).write_text(json.dumps(before))
        perturbation.perturb(source, out, strength=settings["strength"], date_shift_days=DAYS, reuse_key_from=state, spark=spark)

    return _kept(spark, sf_dir, "perturbed", run)


def _table(spark: SparkSession, folder: Path, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.as_uri()}/{name}")


def _named(spark: SparkSession, sf_dir: str, which=export) -> DataFrame:
    """(of, identity) of all resources."""
    return _table(spark, indexed(spark, sf_dir, which), "index/resources").select(F.col("id").alias("of"), "identity")


def _with_name(df: DataFrame, names: DataFrame, column: str, name: str) -> DataFrame:
    return df.join(names.withColumnRenamed("identity", name), F.col(column) == F.col("of"), "left").drop("of", column)


def _report(folder: Path) -> dict:
    from ..functions import canonical

    return canonical.parse((folder / "result/reports/perturbation-report.json").read_text())


# ---------------------------------------------------------------- the same in SQL

_LABEL = lambda purpose, value: f"substr({sql_digest(purpose, value)}, 1, 16)"
_JSON = lambda e: f"('\"' || {e} || '\"')"


def _new(identity: str, digest: str) -> str:
    value = f"('[\"' || {identity} || '\",\"' || {digest} || '\"]')"
    return f"('pert-' || substr({sql_digest('resource', value)}, 1, 32))"


_LINES_SQL = f"""
talk0 AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations),
talk AS (SELECT *, CAST(to_json(text) AS VARCHAR) AS quoted, (SELECT count(*) FROM customer) AS people, dense_rank() OVER (ORDER BY conv_id) AS n FROM talk0),
visit0 AS (SELECT 1 AS a, 0 AS c, o.* FROM orders o WHERE o_orderkey % 17 = 0 UNION ALL SELECT 1, 1, o.* FROM orders o UNION ALL SELECT 2, 1, o.* FROM orders o WHERE o_orderkey % 13 = 0),
visit AS (SELECT *, row_number() OVER (ORDER BY a, o_orderkey, c) AS n FROM visit0),
person AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS n FROM customer),
ward AS (SELECT 0 AS kind, r_regionkey AS k, {made(_ORG, **ORG)} AS payload, '{BASE}Organization/r' || r_regionkey AS url FROM region UNION ALL SELECT 1, n_nationkey, {made(_PLACE, **PLACE)}, '{BASE}Location/n' || n_nationkey FROM nation),
ward_n AS (SELECT *, row_number() OVER (ORDER BY kind, k) - 1 AS i FROM ward),
lines AS (
    SELECT 1 AS source_id, n, {made(_PERSON_LINE, **PERSON)} AS line FROM person
    UNION ALL SELECT 2, n, '{{"resourceType":"Bundle","type":"collection","entry":[' || string_agg({made('{"resource":<r>}', r=made(_TALK, **TALK))}, ',' ORDER BY i) || ']}}' FROM talk GROUP BY n
    UNION ALL SELECT 3, n, {_visit(**VISIT)} FROM visit WHERE c = 1
    UNION ALL SELECT 4, 1, '{{"resourceType":"Bundle","type":"searchset","entry":[' || string_agg({made('{"fullUrl":"<url>","resource":<r>}', url="url", r="payload")}, ',' ORDER BY i) || ']}}' FROM ward_n
),
occ0 AS (
    SELECT 1 AS source_id, n AS ordinal, 0 AS seq, 'line:' || n AS locator, 'source:1:standalone' AS context, NULL AS full_url, 'Patient/c' || c_custkey AS identity, 'Patient' AS resource_type, {PERSON['id']} AS logical_id, false AS contained, {made(_PERSON, **PERSON)} AS payload, c_custkey AS k FROM person
    UNION ALL SELECT 2, n, i, 'line:' || n || '.entry[' || i || '].resource', 'source:2:line:' || n, NULL, 'Communication/' || {TALK['id']}, 'Communication', {TALK['id']}, false, {made(_TALK, **TALK)}, conv_id % people FROM talk
    UNION ALL SELECT 3, n, 0, 'line:' || n, 'source:3:standalone', NULL, 'Observation/o' || o_orderkey, 'Observation', {VISIT['id']}, false, {_visit(**VISIT)}, o_orderkey FROM visit WHERE c = 1
    UNION ALL SELECT 3, n, 1, 'line:' || n || '.contained[0]', 'source:3:standalone', NULL, NULL, 'Device', 'd', true, {DEVICE}, o_orderkey FROM visit WHERE c = 1 AND {_HAS_DEVICE}
    UNION ALL SELECT 4, 1, i, '$.entry[' || i || '].resource', 'source:4:$', url, url, CASE kind WHEN 0 THEN 'Organization' ELSE 'Location' END, CASE kind WHEN 0 THEN 'r' ELSE 'n' END || k, false, payload, k FROM ward_n
),
occ1 AS (SELECT *, sha256(payload) AS digest, row_number() OVER (ORDER BY source_id, ordinal, seq) AS pos, CASE WHEN contained THEN 'device ' || k ELSE resource_type || ' ' || logical_id END AS name FROM occ0),
ids AS (SELECT name, row_number() OVER (ORDER BY min(pos)) AS id, min(pos) AS first FROM occ1 GROUP BY name),
occ AS (SELECT o.* EXCLUDE (identity), id, first, CASE WHEN contained THEN (SELECT id FROM ids WHERE ids.name = 'Observation o' || k) ELSE id END AS root_id,
    CASE WHEN contained THEN 'contained:' || (SELECT id FROM ids WHERE ids.name = 'Observation o' || k) || '#d' ELSE identity END AS identity FROM occ1 o JOIN ids USING (name)),
res AS (SELECT * FROM occ WHERE pos = first)
"""


@query(f"WITH {_LINES_SQL} SELECT CAST(source_id AS INT) AS source_id, n AS ordinal, CASE source_id WHEN 4 THEN '$' ELSE 'line:' || n END AS locator, md5(line) AS digest FROM lines")
def export_scan(spark, sf_dir):
    """Documents of plain, compressed and single-document files, with their line numbers, a byte order mark and blank lines left out."""
    files, _ = exports.discover(spark, [export(spark, sf_dir)], _folder(spark) / "nothing")
    return exports.scan(spark, files, part_bytes=1 << 18).select("source_id", "ordinal", "locator", F.md5(F.regexp_replace("text", r"\n\z", "")).alias("digest"))


@query(f"WITH {_LINES_SQL} SELECT identity, digest, resource_type, logical_id, full_url, contained FROM res")
def export_resources(spark, sf_dir):
    """Resources, each once, with identity and digest of the canonical payload."""
    return _table(spark, indexed(spark, sf_dir), "index/resources").select("identity", "digest", "resource_type", "logical_id", "full_url", "contained")


@query(f"WITH {_LINES_SQL}, names AS (SELECT id AS of, identity FROM res) SELECT occ.identity, CAST(source_id AS INT) AS source_id, locator, context, full_url, names.identity AS root, CASE WHEN contained THEN names.identity END AS parent FROM occ JOIN names ON names.of = root_id")
def export_occurrences(spark, sf_dir):
    """Where each resource stands: file, place, lookup context, root and parent."""
    names = _named(spark, sf_dir)
    out = _table(spark, indexed(spark, sf_dir), "index/occurrences").drop("id")
    for column, name in (("resource_id", "identity"), ("root_resource_id", "root"), ("parent_resource_id", "parent")):
        out = _with_name(out, names, column, name)
    return out


@query(f"""WITH {_LINES_SQL} SELECT DISTINCT alias, kind, CASE kind WHEN 'contained' THEN 'contained:' || root_id ELSE context END AS context, identity FROM (
    SELECT '#d' AS alias, 'contained' AS kind, * FROM occ WHERE contained UNION ALL SELECT resource_type || '/' || logical_id, 'relative', * FROM occ WHERE NOT contained UNION ALL SELECT full_url, 'absolute', * FROM occ WHERE full_url IS NOT NULL)""")
def export_aliases(spark, sf_dir):
    """Names that references can use, by kind and context."""
    return _with_name(_table(spark, indexed(spark, sf_dir), "index/aliases"), _named(spark, sf_dir), "resource_id", "identity")


_REFS_SQL = f"""
refs AS (
    SELECT o.*, 'managingOrganization.reference' AS path, 'Organization/r' || (c_nationkey % 5) AS literal, '{BASE}Organization/r' || (c_nationkey % 5) AS target FROM occ o JOIN customer ON resource_type = 'Patient' AND k = c_custkey
    UNION ALL SELECT o.*, 'subject.reference', 'Patient/c' || k, 'Patient/c' || k FROM occ o WHERE resource_type = 'Communication'
    UNION ALL SELECT o.*, 'subject.reference', {_SUBJECT}, CASE WHEN NOT {_LOST} THEN 'Patient/c' || o_custkey END FROM occ o JOIN orders ON resource_type = 'Observation' AND k = o_orderkey
    UNION ALL SELECT o.*, 'device.reference', '#d', 'contained:' || root_id || '#d' FROM occ o WHERE resource_type = 'Observation' AND k % 7 = 0
    UNION ALL SELECT o.*, 'managingOrganization.reference', 'Organization/r' || n_regionkey, '{BASE}Organization/r' || n_regionkey FROM occ o JOIN nation ON resource_type = 'Location' AND k = n_nationkey
),
owners AS (SELECT identity, identity AS patient, 'direct' AS basis FROM res WHERE resource_type = 'Patient' UNION ALL SELECT DISTINCT identity, target, 'direct' FROM refs WHERE path = 'subject.reference' AND target IS NOT NULL
    UNION ALL SELECT DISTINCT d.identity, r.target, 'inferred_from_context' FROM refs r JOIN res d ON d.contained AND d.root_id = r.id WHERE r.path = 'subject.reference' AND r.target IS NOT NULL)
"""


@query(f"WITH {_LINES_SQL}, {_REFS_SQL} SELECT identity, locator, path, literal, 'literal' AS kind, CASE WHEN target IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, target FROM refs")
def export_references(spark, sf_dir):
    """References of every occurrence, resolved by scope: contained, own context, server, all."""
    folder, names = indexed(spark, sf_dir), _named(spark, sf_dir)
    place = _table(spark, folder, "index/occurrences").select(F.col("id").alias("o"), "locator")
    out = _table(spark, folder, "index/resource_references").join(place, F.col("occurrence_id") == F.col("o")).drop("o", "occurrence_id", "at")
    return _with_name(_with_name(out, names, "source_resource_id", "identity"), names, "target_resource_id", "target")


@query(f"WITH {_LINES_SQL}, {_REFS_SQL} SELECT identity, patient, basis FROM owners")
def export_memberships(spark, sf_dir):
    """The one patient that a resource belongs to, and by what."""
    names = _named(spark, sf_dir)
    out = _table(spark, indexed(spark, sf_dir), "index/patient_memberships")
    return _with_name(_with_name(out, names, "resource_id", "identity"), names, "patient_resource_id", "patient")


@query(f"""WITH {_LINES_SQL}, {_REFS_SQL} SELECT 'info' AS severity, 'duplicate_resource' AS code, CAST(source_id AS INT) AS source_id, locator, NULL AS detail, identity FROM occ WHERE pos <> first
    UNION ALL SELECT 'warning', 'unresolved_reference', NULL, NULL, path, identity FROM refs WHERE target IS NULL
    UNION ALL SELECT 'warning', 'unassigned_patient_resource', NULL, NULL, NULL, identity FROM res WHERE resource_type = 'Observation' AND identity NOT IN (SELECT identity FROM owners)""")
def export_issues(spark, sf_dir):
    """What is amiss in an export without errors: duplicates, lost references, resources of nobody."""
    return _with_name(_table(spark, indexed(spark, sf_dir), "index/issues"), _named(spark, sf_dir), "resource_id", "identity")


@query(f"""WITH {_LINES_SQL}, {_REFS_SQL} SELECT * FROM (VALUES ('files', 4)) UNION ALL SELECT 'resource_occurrences', count(*) FROM occ UNION ALL SELECT 'unique_resources', count(*) FROM res
    UNION ALL SELECT 'duplicate_occurrences', (SELECT count(*) FROM occ) - (SELECT count(*) FROM res) UNION ALL SELECT 'patients', count(*) FROM customer UNION ALL SELECT 'grouped_resources', count(*) FROM owners
    UNION ALL SELECT 'reference ' || CASE WHEN target IS NULL THEN 'unresolved' ELSE 'resolved' END, count(*) FROM refs GROUP BY ALL UNION ALL SELECT 'type ' || resource_type, count(*) FROM res GROUP BY ALL
    UNION ALL SELECT 'status completed_with_warnings', 1""".replace("SELECT * FROM (VALUES ('files', 4))", "SELECT 'files' AS name, CAST(4 AS BIGINT) AS value"))
def export_report(spark, sf_dir):
    """Counts and status, as the report of the load gives them."""
    found = json.loads((indexed(spark, sf_dir) / "report.json").read_text())
    rows = {**found["counts"], **{f"reference {k}": n for k, n in found["reference_status"].items()}, **{f"type {k}": n for k, n in found["resource_types"].items()}, f"status {found['status']}": 1}
    return spark.createDataFrame(list(rows.items()), "name string, value long")


_FAULT_ROWS = ", ".join(f"({i}, {'NULL' if s is None else repr(s)}, {'NULL' if c is None else repr(c)})" for i, (_, s, c) in enumerate(FAULTS))


@query(f"""WITH faults(r, severity, code) AS (VALUES {_FAULT_ROWS}), e AS (SELECT event_id, event_id % {len(FAULTS)} AS r FROM events), n AS (SELECT severity, code, count(*) AS n FROM e JOIN faults USING (r) WHERE code IS NOT NULL GROUP BY ALL)
SELECT * FROM n UNION ALL SELECT 'warning', 'missing_resource_id', count(*) FROM e WHERE r IN (6, 21) UNION ALL SELECT 'warning', 'no_patient_resources', 1
UNION ALL SELECT 'warning', 'unassigned_patient_resource', count(*) FROM e WHERE r IN (18, 19, 22)""")
def faulty_export_issues(spark, sf_dir):
    """Each kind of fault is told as an issue, and the rest is indexed."""
    issues = _table(spark, indexed(spark, sf_dir, faulty), "index/issues")
    return issues.groupBy("severity", "code").agg(F.count("*").alias("n"))


@query("SELECT 'incomplete' AS status, 'The index was not finished.' AS refused")
def faulty_export_gate(spark, sf_dir):
    """An index with errors is marked and is not opened."""
    from ..errors import InputError

    folder, refused = indexed(spark, sf_dir, faulty), None
    try:
        index.open_index(spark, folder)
    except InputError as error:
        refused = str(error)
    return spark.createDataFrame([(json.loads((folder / "index-run.json").read_text())["status"], refused)], "status string, refused string")


_TREE = f"""level1 AS (SELECT id AS n, sha256('[' || id || ',"' || identity || '","' || digest || '","' || resource_type || '",' || contained || ']') AS h FROM res),
level2 AS (SELECT n // {perturbation.LEAVES} AS n, sha256(string_agg(h, '' ORDER BY n)) AS h FROM level1 GROUP BY n // {perturbation.LEAVES})"""


@query(f"WITH {_LINES_SQL}, {_TREE} SELECT sha256(coalesce(string_agg(h, '' ORDER BY n), '')) AS digest FROM level2")
def index_fingerprint(spark, sf_dir):
    """A digest over the resources in order, by a tree of digests."""
    return spark.createDataFrame([(perturbation.ordered_digest(_table(spark, indexed(spark, sf_dir), "index/resources"), ["id", "identity", "digest", "resource_type", "contained"], "id"),)], "digest string")


_OFFSET = sql_modulo(sql_digest("date-offset", _JSON("identity")), str(2 * DAYS + 1))
_CENTS = "CAST(round(o_totalprice * 100) AS HUGEINT)"
_SLOT = "('[\"' || new_id || '\",[[\"key\",\"valueQuantity\"],[\"key\",\"value\"]]]')"


def _scaled(cents: str, n: str, up: str) -> str:
    m = quantities.STEPS
    part = f"(CAST({m} AS HUGEINT) + {STRENGTH_PERCENT - 1} * {n})"
    product = f"({cents} * CASE WHEN {up} = 1 THEN CAST({100 * m} AS HUGEINT) + {part} ELSE CAST({100 * m} AS HUGEINT) - {part} END)"
    q, r = f"({product} // {100 * m})", f"({product} % {100 * m})"
    return f"({q} + CASE WHEN 2 * {r} > {100 * m} OR (2 * {r} = {100 * m} AND {q} % 2 = 1) THEN 1 ELSE 0 END)"


_MONEY = lambda c: f"(({c}) // 100 || '.' || lpad(CAST(({c}) % 100 AS VARCHAR), 2, '0'))"
_TEL_VALUE = f"('[\"' || {_SYSTEM} || '\",\"' || c_name || '\"]')"
_TEL_NUMBER = "'000' || lpad(CAST(" + sql_modulo("number", str(10**10)) + " AS VARCHAR), 10, '0')"
_NEW_PERSON = {"city": "n_city", "way": "n_way", "born": f"({_BORN} + CAST(days AS INT))", "id": "new_id", "number": "n_number", "org": "n_org", "family": "n_family", "given": "n_given", "second": "n_second", "system": _SYSTEM, "tel": "n_tel"}
_MOVED = "CASE WHEN days IS NULL THEN " + _WHEN + " ELSE (CAST(CAST(o_orderdate AS DATE) + CAST(days AS INT) AS STRING) || 'T00:00:00Z') END"
_NEW_VISIT = {"dev": "coalesce(n_dev, '')", "ref": "coalesce(n_dev, '')", "when": _MOVED, "id": "new_id", "subject": "n_subject", "value": "n_value"}
_NEW_TALK = {"id": "new_id", "text": "quoted", "sent": "(CAST(DATE '2024-01-01' + CAST(i % 28 AS INT) + CAST(days AS INT) AS STRING) || 'T10:00:00+01:00')", "subject": "n_subject"}

_NEW_SQL = f"""
new AS MATERIALIZED (SELECT identity, {_new('identity', 'digest')} AS new_id, id, root_id, resource_type, k, logical_id, contained FROM res),
days AS MATERIALIZED (SELECT identity AS patient, k, {_OFFSET} - {DAYS} AS days FROM new WHERE resource_type = 'Patient'),
people0 AS MATERIALIZED (SELECT c.*, n.identity, n.new_id, days, o.new_id AS n_org, {_LABEL('address-city', _JSON('c_mktsegment'))} AS n_city, {_LABEL('address-line', _JSON("'Way ' || c_custkey"))} AS n_way, 'pert-' || substr({sql_digest('identifier', "('[\"urn:customers\",\"' || c_custkey || '\"]')")}, 1, 32) AS n_number,
    {_LABEL('name-family', _JSON('c_name'))} AS n_family, {_LABEL('name-given', _JSON('c_mktsegment'))} AS n_given, {_LABEL('name-given', _JSON("'N' || c_nationkey"))} AS n_second, {_LABEL('contact-point', _TEL_VALUE)} AS token, {sql_digest('contact-number', _TEL_VALUE)} AS number
    FROM customer c JOIN new n ON n.resource_type = 'Patient' AND n.k = c_custkey JOIN days d ON d.patient = n.identity JOIN new o ON o.identity = '{BASE}Organization/r' || (c_nationkey % 5)),
people AS MATERIALIZED (SELECT *, CASE c_custkey % 3 WHEN 0 THEN {_TEL_NUMBER} WHEN 1 THEN token || '@example.invalid' ELSE 'https://example.invalid/' || token END AS n_tel FROM people0),
visits0 AS MATERIALIZED (SELECT o.*, n.identity, n.new_id, n.root_id, CASE WHEN NOT {_LOST} THEN days END AS days, CASE WHEN {_LOST} THEN {_SUBJECT} ELSE 'Patient/' || p.new_id END AS n_subject, d.new_id AS n_dev, d.identity AS dev_identity,
    {sql_modulo(sql_digest('quantity-magnitude', _SLOT.replace('new_id', 'n.new_id')), str(1 << 53))} AS drawn, {sql_modulo(sql_digest('quantity-sign', _SLOT.replace('new_id', 'n.new_id')), '2')} AS up, {_CENTS} AS cents
    FROM orders o JOIN new n ON n.resource_type = 'Observation' AND n.k = o_orderkey LEFT JOIN new p ON p.resource_type = 'Patient' AND p.k = o_custkey LEFT JOIN days ON days.patient = p.identity LEFT JOIN new d ON d.contained AND d.root_id = n.id),
visits1 AS (SELECT *, CASE WHEN {_LOST} THEN cents ELSE {_scaled('cents', 'CAST(drawn AS HUGEINT)', 'up')} END AS scaled FROM visits0),
visits AS MATERIALIZED (SELECT *, {_MONEY('scaled')} AS n_value FROM visits1),
talks AS MATERIALIZED (SELECT t.*, n.identity, n.new_id, days, 'Patient/' || p.new_id AS n_subject FROM talk t JOIN new n ON n.resource_type = 'Communication' AND n.logical_id = 'v' || conv_id || '-' || i JOIN new p ON p.resource_type = 'Patient' AND p.k = conv_id % people JOIN days ON days.patient = p.identity),
orgs AS (SELECT r.*, identity, new_id FROM region r JOIN new ON resource_type = 'Organization' AND k = r_regionkey),
places AS (SELECT l.*, n.identity, n.new_id, o.new_id AS n_org FROM nation l JOIN new n ON n.resource_type = 'Location' AND n.k = n_nationkey JOIN new o ON o.resource_type = 'Organization' AND o.k = n_regionkey),
written AS MATERIALIZED (
    SELECT 1 AS source_id, identity, {made(_PERSON, **_NEW_PERSON)} AS line FROM people UNION ALL SELECT 2, identity, {made(_TALK, **_NEW_TALK)} FROM talks UNION ALL SELECT 3, identity, {_visit(**_NEW_VISIT)} FROM visits
    UNION ALL SELECT 4, identity, {made(_ORG, id='new_id', name='r_name')} FROM orgs UNION ALL SELECT 4, identity, {made(_PLACE, id='new_id', name='n_name', org='n_org')} FROM places)
"""
_RUN_SQL = f"WITH {_LINES_SQL}, {_REFS_SQL}, {_NEW_SQL}"


@query(f"{_RUN_SQL} SELECT new.identity, new_id, resource_type, r.identity AS root, owners.patient FROM new JOIN (SELECT id AS of, identity FROM new) r ON r.of = root_id LEFT JOIN owners ON owners.identity = new.identity")
def perturbed_mappings(spark, sf_dir):
    """New ids, by key, identity and digest, with root and patient."""
    names = _named(spark, sf_dir)
    out = _table(spark, perturbed(spark, sf_dir) / "intermediates", "state/resource_mappings").select("resource_id", "root_id", "patient_id", "resource_type", "new_id")
    for column, name in (("resource_id", "identity"), ("root_id", "root"), ("patient_id", "patient")):
        out = _with_name(out, names, column, name)
    return out


@query(f"{_RUN_SQL} SELECT patient AS identity, CAST(-{DAYS} AS INT) AS minimum_days, CAST({DAYS} AS INT) AS maximum_days, CAST(days AS INT) AS days FROM days")
def perturbed_patients(spark, sf_dir):
    """Offsets of patients, drawn within what all their dates allow."""
    return _table(spark, perturbed(spark, sf_dir) / "intermediates", "state/patient_parameters").select("identity", "minimum_days", "maximum_days", "days")


@query(f"{_RUN_SQL} SELECT identity, sha256(line) AS digest FROM written")
def perturbed_lines(spark, sf_dir):
    """Every perturbed root as it is written."""
    out = _table(spark, perturbed(spark, sf_dir) / "intermediates", "state/written").select("root_id", F.sha2("line", 256).alias("digest"))
    return _with_name(out, _named(spark, sf_dir), "root_id", "identity")


def _place(*path) -> str:
    return "'" + json.dumps([["index" if isinstance(p, int) else "key", p] for p in path]) + "'"


def _change(table: str, path: tuple, old: str, new: str, reason: str, kind: str, owner: str = "identity", only: str = "true") -> str:
    return f"SELECT identity, {owner} AS owner, {_place(*path)} AS path, {old} AS old_json, {new} AS new_json, '{reason}' AS reason, '{kind}' AS datatype FROM {table} WHERE {only}"


_CHANGES_SQL = " UNION ALL ".join([
    *[_change(t, ("id",), _JSON(old), _JSON("new_id"), "resource_id_replaced", "id") for t, old in (("people", PERSON["id"]), ("visits", VISIT["id"]), ("talks", TALK["id"]), ("orgs", ORG["id"]), ("places", PLACE["id"]))],
    _change("people", ("address", 0, "city"), _JSON("c_mktsegment"), _JSON("n_city"), "address_replaced", "string"),
    _change("people", ("address", 0, "line", 0), _JSON(PERSON["way"]), _JSON("n_way"), "address_replaced", "string"),
    _change("people", ("name", 0, "family"), _JSON("c_name"), _JSON("n_family"), "name_replaced", "string"),
    _change("people", ("name", 0, "given", 0), _JSON("c_mktsegment"), _JSON("n_given"), "name_replaced", "string"),
    _change("people", ("name", 0, "given", 1), _JSON(PERSON["second"]), _JSON("n_second"), "name_replaced", "string"),
    _change("people", ("telecom", 0, "value"), _JSON("c_name"), _JSON("n_tel"), "contact_point_replaced", "string"),
    _change("people", ("identifier", 0, "value"), _JSON("c_custkey"), _JSON("n_number"), "identifier_replaced", "string"),
    _change("people", ("birthDate",), _JSON(_BORN), _JSON(_NEW_PERSON["born"]), "patient_date_shift", "date", only="days <> 0"),
    _change("people", ("managingOrganization", "reference"), _JSON("'Organization/r' || (c_nationkey % 5)"), _JSON("'Organization/' || n_org"), "reference_rewritten", "string"),
    _change("places", ("managingOrganization", "reference"), _JSON("'Organization/r' || n_regionkey"), _JSON("'Organization/' || n_org"), "reference_rewritten", "string"),
    _change("talks", ("subject", "reference"), _JSON(TALK["subject"]), _JSON("n_subject"), "reference_rewritten", "string"),
    _change("talks", ("sent",), _JSON(_SENT), _JSON(_NEW_TALK["sent"]), "patient_date_shift", "dateTime", only="days <> 0"),
    _change("visits", ("subject", "reference"), _JSON(_SUBJECT), _JSON("n_subject"), "reference_rewritten", "string", only=f"NOT ({_LOST})"),
    _change("visits", ("effectiveDateTime",), _JSON(_WHEN), _JSON(_MOVED), "patient_date_shift", "dateTime", only="days <> 0"),
    _change("visits", ("valueQuantity", "value"), _MONEY("cents"), "n_value", "field_quantity_scale", "decimal", only="scaled <> cents"),
    _change("visits", ("contained", 0, "id"), "'\"d\"'", _JSON("n_dev"), "resource_id_replaced", "id", owner="dev_identity", only=_HAS_DEVICE),
    _change("visits", ("device", "reference"), "'\"#d\"'", _JSON("'#' || n_dev"), "reference_rewritten", "string", only=_HAS_DEVICE),
])


@query(f"{_RUN_SQL} {_CHANGES_SQL}")
def perturbed_changes(spark, sf_dir):
    """The ledger: each changed cell of each root, before and after, and why."""
    names = _named(spark, sf_dir)
    out = _table(spark, perturbed(spark, sf_dir) / "intermediates", "state/changes").select("root_id", "owner_id", "path", "old_json", "new_json", "reason", "datatype")
    return _with_name(_with_name(out, names, "root_id", "identity"), names, "owner_id", "owner")


@query(f"{_RUN_SQL}, changes AS ({_CHANGES_SQL}) SELECT reason, count(*) AS n FROM changes GROUP BY ALL UNION ALL SELECT 'roots', count(*) FROM written")
def perturbed_validation(spark, sf_dir):
    """What the proof checked in the written output, by undoing the ledger: as many of each kind as the ledger has."""
    folder = perturbed(spark, sf_dir)
    found = _report(folder)["validation"]
    changes = _table(spark, folder / "intermediates", "state/changes")
    checked = {"reference_rewritten": found["references_checked"], "patient_date_shift": found["dates_checked"], "field_quantity_scale": found["quantities_checked"], "roots": found["roots_checked"]}
    others = changes.filter(~F.col("reason").isin(*checked)).groupBy("reason").agg(F.count("*").alias("n"))
    if found["changes_checked"] != changes.count():
        raise ValueError("the proof left changes out")
    return spark.createDataFrame(list(checked.items()), "reason string, n long").unionByName(others)


#: What is done to the fields of each root, by statistical path: (path, datatype, action, reason, how many; SQL over the root's table).
_KEPT, _SHAPE = "clinical_or_other_content_preserved", "structure_or_null_preserved"


def _fields() -> str:
    """Rows (type, path, datatype, action, reason, frequency) in SQL."""
    text = lambda path: "'" + json.dumps([["item", None] if p == "*" else ["key", p] for p in path]) + "'"
    out = []

    def add(table: str, kind: str, path: str, datatype: str, action: str, reason: str, count: str = "count(*)"):
        out.append(f"SELECT '{kind}' AS type, {text(path.split('.') if path else ())} AS path, '{datatype}' AS datatype, '{action}' AS action, '{reason}' AS reason, {count} AS frequency FROM {table}")

    def shapes(table, kind, entries, count="count(*)"):
        for path, datatype in entries.items():
            add(table, kind, path, datatype, "preserved", _SHAPE, count)

    def kept(table, kind, entries, count="count(*)"):
        for path, datatype in entries.items():
            add(table, kind, path, datatype, "preserved", _KEPT, count)

    for table, kind in (("people", "Patient"), ("visits", "Observation"), ("talks", "Communication"), ("orgs", "Organization"), ("places", "Location")):
        shapes(table, kind, {"": kind})
        kept(table, kind, {"resourceType": "code"})
        add(table, kind, "id", "id", "changed", "resource_id_replaced")
    shapes("people", "Patient", {"address": "Address", "address.*": "Address", "address.*.line": "string", "identifier": "Identifier", "identifier.*": "Identifier", "managingOrganization": "Reference", "name": "HumanName", "name.*": "HumanName", "name.*.given": "string", "telecom": "ContactPoint", "telecom.*": "ContactPoint"})
    kept("people", "Patient", {"identifier.*.system": "uri", "telecom.*.system": "code"})
    for path, reason, count in (("address.*.city", "address_replaced", 1), ("address.*.line.*", "address_replaced", 1), ("name.*.family", "name_replaced", 1), ("name.*.given.*", "name_replaced", 2), ("telecom.*.value", "contact_point_replaced", 1), ("identifier.*.value", "identifier_replaced", 1), ("managingOrganization.reference", "reference_rewritten", 1)):
        add("people", "Patient", path, "string", "changed", reason, f"{count} * count(*)")
    shifted = lambda table, kind, path, datatype: [add(table, kind, path, datatype, action, "patient_date_shift", f"count(*) FILTER (days {'<>' if action == 'changed' else '='} 0)") for action in ("changed", "preserved")]
    shifted("people", "Patient", "birthDate", "date")
    shapes("talks", "Communication", {"payload": "BackboneElement", "payload.*": "BackboneElement", "subject": "Reference"})
    kept("talks", "Communication", {"status": "code", "payload.*.contentString": "string"}, "count(*) FILTER (text <> '')")
    out[-2] = out[-2].replace("count(*) FILTER (text <> '')", "count(*)")
    add("talks", "Communication", "payload.*.contentString", "string", "preserved", "empty_string_preserved", "count(*) FILTER (text = '')")
    add("talks", "Communication", "subject.reference", "string", "changed", "reference_rewritten")
    shifted("talks", "Communication", "sent", "dateTime")
    kept("orgs", "Organization", {"name": "string"})
    kept("places", "Location", {"name": "string"})
    shapes("places", "Location", {"managingOrganization": "Reference"})
    add("places", "Location", "managingOrganization.reference", "string", "changed", "reference_rewritten")
    shapes("visits", "Observation", {"code": "CodeableConcept", "code.coding": "Coding", "code.coding.*": "Coding", "subject": "Reference", "valueQuantity": "Quantity"})
    kept("visits", "Observation", {"code.coding.*.code": "code", "code.coding.*.system": "uri", "status": "code", "valueQuantity.code": "code", "valueQuantity.system": "uri", "valueQuantity.unit": "string"})
    with_device, lost = f"count(*) FILTER ({_HAS_DEVICE})", f"count(*) FILTER ({_LOST})"
    shapes("visits", "Observation", {"contained": "Resource", "contained.*": "Device", "device": "Reference"}, with_device)
    kept("visits", "Observation", {"contained.*.resourceType": "code", "contained.*.status": "code"}, with_device)
    add("visits", "Observation", "contained.*.id", "id", "changed", "resource_id_replaced", with_device)
    add("visits", "Observation", "device.reference", "string", "changed", "reference_rewritten", with_device)
    add("visits", "Observation", "subject.reference", "string", "changed", "reference_rewritten", f"count(*) - {lost}")
    add("visits", "Observation", "subject.reference", "string", "unsupported", "reference_unresolved_or_ambiguous", lost)
    shifted("visits", "Observation", "effectiveDateTime", "dateTime")
    for path, datatype in (("effectiveDateTime", "dateTime"), ("valueQuantity.value", "decimal")):
        add("visits", "Observation", path, datatype, "preserved", "shared_or_unassigned", lost)
    for action, sign in (("changed", "<>"), ("preserved", "=")):
        add("visits", "Observation", "valueQuantity.value", "decimal", action, "field_quantity_scale", f"count(*) FILTER (scaled {sign} cents AND NOT ({_LOST}))")
    return " UNION ALL ".join(out)


@query(f"{_RUN_SQL} SELECT * FROM ({_fields()}) WHERE frequency > 0")
def perturbed_field_actions(spark, sf_dir):
    """What was done to every field of every root, by statistical path, datatype and reason."""
    return _table(spark, perturbed(spark, sf_dir) / "intermediates", "state/field_actions").select(F.col("resource_type").alias("type"), "path", "datatype", "action", "reason", "frequency")


_CONTEXT = made('["Observation", [["key", "valueQuantity"], ["key", "value"]], "decimal", [[[], "{\\"code\\":{\\"coding\\":[{\\"code\\":\\"<prio>\\",\\"system\\":\\"urn:codes\\"}]}}"]]]{"code":"mg/dL","system":"http://unitsofmeasure.org","unit":"mg/dL"}', prio="o_orderpriority")


@query(f"{_RUN_SQL} SELECT {_CONTEXT} AS context, count(*) AS samples, count(*) FILTER (scaled <> cents) AS changed, count(*) FILTER (cents = 0) AS zero_baselines FROM visits GROUP BY 1")
def perturbed_numeric_contexts(spark, sf_dir):
    """Measurements in each context that makes them alike."""
    return _table(spark, perturbed(spark, sf_dir) / "intermediates", "state/numeric_contexts").select("context", "samples", "changed", "zero_baselines")


@query(f"""{_RUN_SQL}, phases AS (SELECT {_CONTEXT} AS context, 'before' AS phase, cents AS v FROM visits UNION ALL SELECT {_CONTEXT}, 'after', scaled FROM visits),
freq AS (SELECT context, phase, v, count(*) AS c FROM phases GROUP BY ALL), run AS (SELECT *, sum(c) OVER (PARTITION BY context, phase ORDER BY v) AS upto, sum(c) OVER (PARTITION BY context, phase) AS total FROM freq),
found AS (SELECT context, phase, CAST(any_value(total) AS BIGINT) AS n, min(v) AS lo, max(v) AS hi, {', '.join(f'min(v) FILTER (upto >= (total * {p} + 99) // 100) AS q{p:02d}' for p in (5, 25, 50, 75, 95))} FROM run GROUP BY ALL)
SELECT context, phase, n, {_MONEY('lo')} AS minimum, {_MONEY('hi')} AS maximum, {', '.join(f'{_MONEY(f"q{p:02d}")} AS p{p:02d}' for p in (5, 25, 50, 75, 95))} FROM found""")
def perturbed_numeric_summaries(spark, sf_dir):
    """Exact quantiles of each context before and after; those of relative changes have 34 digits, which SQL doesn't."""
    return _table(spark, perturbed(spark, sf_dir) / "intermediates", "state/numeric_summaries").filter("phase IN ('before', 'after')")


_FILES = "(VALUES (1, 'people.ndjson', 'people.ndjson', false, false), (2, 'talks.ndjson', 'talks.ndjson', false, false), (3, 'visits.ndjson.gz', 'visits.ndjson.gz', true, false), (4, 'wards.ndjson', 'wards.json', false, true)) AS f(source_id, file, source_file, compressed, bundle_unpacked)"


@query(f"""{_RUN_SQL} SELECT file, source_file, compressed, bundle_unpacked, 'ndjson' AS format, count(*) AS records, sha256(string_agg(line || chr(10), '' ORDER BY id)) AS uncompressed_sha256
FROM written JOIN new USING (identity) JOIN {_FILES} USING (source_id) GROUP BY ALL""")
def perturbed_files(spark, sf_dir):
    """The files written, laid out as the source, each read back and summed."""
    rows = _report(perturbed(spark, sf_dir))["export"]["files"]
    return spark.createDataFrame([(r["file"], r["source_file"], r["compressed"], r["bundle_unpacked"], r["format"], r["records"], r["uncompressed_sha256"]) for r in rows], "file string, source_file string, compressed boolean, bundle_unpacked boolean, format string, records long, uncompressed_sha256 string")


@query(f"{_RUN_SQL} SELECT md5(line) AS digest, count(*) AS n FROM written GROUP BY ALL")
def perturbed_export_scan(spark, sf_dir):
    """The written files, scanned as a source again: every root is there, once."""
    files, _ = exports.discover(spark, [perturbed(spark, sf_dir) / "result/fhir"], _folder(spark) / "nothing")
    return exports.scan(spark, files).groupBy(F.md5(F.regexp_replace("text", r"\n\z", "")).alias("digest")).agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('index', 'completed_with_warnings', NULL, NULL), ('state', 'completed_with_warnings', 'complete', NULL), ('report', 'completed_with_warnings', NULL, '0.16')) AS t(part, status, phase, strength)")
def run_status(spark, sf_dir):
    """How the parts of a run are marked at its end."""
    state = json.loads((perturbed(spark, sf_dir) / "intermediates/state-run.json").read_text())
    rows = [("index", json.loads((indexed(spark, sf_dir) / "index-run.json").read_text())["status"], None, None), ("state", state["status"], state["phase"], None), ("report", _report(perturbed(spark, sf_dir))["status"], None, state["settings"]["strength"])]
    return spark.createDataFrame(rows, "part string, status string, phase string, strength string")


@query("""SELECT a AS archive, 'package/' || kind || k || '.json' AS name, md5('{"id":"' || kind || k || '","n":"' || n || '"}') AS digest FROM (SELECT 'nation' AS kind, n_nationkey AS k, n_name AS n FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region) CROSS JOIN (VALUES ('p.tgz'), ('p.zip')) AS t(a)
UNION ALL SELECT a, 'package/package.json', md5('{"name":"p","version":"1"}') FROM (VALUES ('p.tgz'), ('p.zip')) AS t(a)""")
def archive_scan(spark, sf_dir):
    """Members of packages in two formats, read without unpacking them, after a look at what they call themselves. The packed tables are fixed and tiny."""
    import io
    import tarfile
    import zipfile

    from ..sources import archives

    def pack(out: Path) -> None:
        rows = [*read(spark, sf_dir, "nation").select(F.lit("nation"), "n_nationkey", "n_name").collect(), *read(spark, sf_dir, "region").select(F.lit("region"), "r_regionkey", "r_name").collect()]
        files = {f"package/{kind}{k}.json": f'{{"id":"{kind}{k}","n":"{n}"}}' for kind, k, n in rows} | {"package/package.json": '{"name":"p","version":"1"}', "package/readme.txt": "no"}
        out.mkdir()
        with tarfile.open(out / "p.tgz", "w:gz") as tar, zipfile.ZipFile(out / "p.zip", "w") as bag:
            for name, text in files.items():
                member = tarfile.TarInfo(name)
                member.size = len(text.encode())
                tar.addfile(member, io.BytesIO(text.encode()))
                bag.writestr(name, text)

    folder = _kept(spark, sf_dir, "archives", pack)
    both = [folder / "p.tgz", folder / "p.zip"]
    for path in both:
        archives.check_identity(path, "p", "1")
    return archives.scan(spark, both).select("archive", "name", F.md5("text").alias("digest"))
