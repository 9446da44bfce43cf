"""Registered queries of the functions that documents are walked and settings are checked with, applied to the driver's tables."""

from __future__ import annotations

import json
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InputError
from ..functions import canonical, dates, keyed, quantities
from ..operators import perturb as kernel
from ..operators import ranks
from ..operators.unpack import lookup, rest_parts
from ..progress import hms
from ..sources import exports
from . import perturbation
from .export_queries import _folder, export, indexed, made
from .registry import KEY, STRENGTH_PERCENT, query, read, sql_digest, sql_modulo
from .storage import tidy


def mapped(df: DataFrame, schema: str, f) -> DataFrame:
    """Rows of `f` of the values of each row of df, a batch of rows at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            rows = [f(*row) for row in zip(*(c.to_pylist() for c in batch.columns))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, schema)


@query("SELECT event_id, '{' || chr(10) || '  \"type\": \"' || event_type || '\",' || chr(10) || '  \"props\": {' || chr(10) || '    \"k\": ' || regexp_extract(props, '([0-9]+)', 1) || chr(10) || '  }' || chr(10) || '}' AS pretty FROM events")
def pretty_documents(spark, sf_dir):
    """Documents indented, names in their order, numbers as written."""
    e = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"type": "'), "event_type", F.lit('", "props": '), "props", F.lit("}")))
    return mapped(e, "event_id long, pretty string", lambda k, text: (k, canonical.pretty(canonical.parse(text))))


@query(f"SELECT event_id, {sql_digest('composite', chr(39) + '[[\"key\",' + chr(39) + ' || event_id || ' + chr(39) + '],[\"' + chr(39) + ' || event_type || ' + chr(39) + '\",null,true]]' + chr(39))} AS label FROM events")
def composite_labels(spark, sf_dir):
    """Labels of nested values: tuples and lists are one, whole numbers, nulls and truth keep their kind."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type")
    return mapped(e, "event_id long, label string", lambda k, kind: (k, keyed.label(KEY, "composite", (("key", k), [kind, None, True]))))


@query(f"SELECT event_id, {sql_modulo(sql_digest('walked', chr(39) + '[' + chr(39) + ' || event_id || ' + chr(39) + ']' + chr(39)), '61')} AS below_61, {sql_modulo(sql_digest('walked', chr(39) + '[' + chr(39) + ' || event_id || ' + chr(39) + ']' + chr(39)), str(1 << 53))} AS below_2p53 FROM events")
def walked_draws(spark, sf_dir):
    """The draws that a walk makes, value by value."""
    draw = lambda k: (k, keyed.below(KEY, "walked", [k], 61), keyed.below(KEY, "walked", [k], 1 << 53))
    return mapped(read(spark, sf_dir, "events").select("event_id"), "event_id long, below_61 long, below_2p53 long", draw)


_TOKEN = "CASE event_id % 5 WHEN 0 THEN CAST(event_id AS STRING) || '.50' WHEN 1 THEN '-' || event_id || 'E+2' WHEN 2 THEN '0.000' || event_id WHEN 3 THEN event_id || '.0E-3' ELSE '-0.00' END"
_OTHER = "CASE event_id % 3 WHEN 0 THEN CAST(event_id AS STRING) || '.5' WHEN 1 THEN '0' ELSE '-' || event_id || '00' END"


@query(f"SELECT event_id, CAST(sign(CAST({_TOKEN} AS DECIMAL(38,10)) - CAST({_OTHER} AS DECIMAL(38,10))) AS INT) AS sign FROM events")
def decimal_comparison(spark, sf_dir):
    """Written decimals compared by keys that sort as they do."""
    compare = lambda k, a, b: (k, (x > y) - (x < y)) if (x := quantities.order_key(a)) is not None and (y := quantities.order_key(b)) is not None else None
    return mapped(read(spark, sf_dir, "events").select("event_id", F.expr(_TOKEN), F.expr(_OTHER)), "event_id long, sign int", compare)


_AFTER = "CAST(round(abs(value) * 100) AS BIGINT)"


@query(f"""WITH d AS (SELECT event_id, {_AFTER} - 10000 AS d FROM events) SELECT event_id, (CASE WHEN d < 0 THEN '-' ELSE '' END) || (abs(d) // 10000) || '.' || CASE WHEN d % 100 = 0 THEN lpad(CAST(abs(d) % 10000 // 100 AS VARCHAR), 2, '0')
    WHEN d % 10 = 0 THEN lpad(CAST(abs(d) % 10000 // 10 AS VARCHAR), 3, '0') ELSE lpad(CAST(abs(d) % 10000 AS VARCHAR), 4, '0') END AS change FROM d""")
def relative_changes(spark, sf_dir):
    """What values grew by as a share of a hundred, exactly, as written."""
    e = read(spark, sf_dir, "events").select("event_id", F.round(F.abs("value") * 100).cast("long"))
    return mapped(e, "event_id long, change string", lambda k, cents: (k, canonical.render(quantities.relative_change(100, Decimal(cents).scaleb(-2)))))


_DATE_FORMS = ("%Y-%m-%d", "%Y-%m", "%Y", "%Y-%m-%dT%H:%M:%SZ", "%Y-13-%d", "%Y-%m-%dT24:%M:%SZ", "%Y-%m-%dT%H:%M:%S+14:30", "%Y-%m-%dT%H:%M")


@query("WITH o AS (SELECT o_orderkey, CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, f in enumerate(_DATE_FORMS)) + """ END AS written, o_orderdate FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (0, 3) THEN NULL WHEN o_orderkey % 8 IN (1, 2) THEN 'partial_date_preserved' ELSE 'invalid_date' END AS fault,
    CASE WHEN o_orderkey % 8 IN (0, 3) THEN strftime(o_orderdate + to_days(CAST(o_orderkey % 61 - 30 AS INT)), '%Y-%m-%d') || substr(written, 11) END AS moved FROM o""")
def walked_dates(spark, sf_dir):
    """Dates classified and moved value by value, as a walk does it; what comes after the day stays as written."""
    from .registry import _java

    written = F.coalesce(*[F.when(F.col("o_orderkey") % 8 == i, F.date_format("o_orderdate", _java(f))) for i, f in enumerate(_DATE_FORMS)])

    def judge(k, text):
        day, fault = dates.classify(text, "dateTime")
        return k, fault, dates.shift(text, k % 61 - 30) if day else None

    return mapped(read(spark, sf_dir, "orders").select("o_orderkey", written), "o_orderkey long, fault string, moved string", judge)


_UNIT = "CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN ',\"system\":\"http://unitsofmeasure.org\",\"code\":\"mg\"' WHEN 1 THEN ',\"system\":\"http://unitsofmeasure.org\",\"code\":\"%\"' WHEN 2 THEN ',\"code\":\"mg\"' WHEN 3 THEN ',\"system\":\"http://unitsofmeasure.org\",\"code\":\"MG\"' ELSE ',\"system\":\"http://unitsofmeasure.org\",\"code\":\"kg\"' END"
_MEASURE = made('{"id":"m","resourceType":"Observation","valueQuantity":{"value":<value><unit>}}', value="CASE WHEN l_linenumber = 4 THEN '\"12\"' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) END", unit=_UNIT)


@query("""SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 5 WHEN 1 THEN 'unsupported_unit' WHEN 2 THEN 'missing_unit' WHEN 3 THEN 'unsupported_unit'
    ELSE CASE WHEN l_linenumber = 4 THEN 'invalid_quantity_value' WHEN l_linenumber % 2 = 0 THEN 'shared_or_unassigned' ELSE 'field_quantity_scale' END END AS reason FROM lineitem""")
def measurement_eligibility(spark, sf_dir):
    """Which measurements are scaled, and why others aren't: by exact unit, value and owner."""

    at = canonical.path_text((("key", "valueQuantity"), ("key", "value")))

    def run(batches):
        for batch in batches:
            group, found = kernel.measurement_groups(batch.column("payload"), KEY, batch.column("owned"))
            reasons = pa.array([next(reason for path, reason in one if path == at) for one in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), reasons.take(pa.array(group))], ["l_orderkey", "l_linenumber", "reason"])

    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    # a file may come in few parts, and a row costs more than its move, which comes before its document is made; dealt out by key, rows need no sort
    dealt = lines.repartition(max(spark.sparkContext.defaultParallelism, -(-lines.count() // 100_000)), "l_orderkey", "l_linenumber")
    made_of = dealt.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 2 != 0).alias("owned"), F.expr(_MEASURE).alias("payload"))
    return made_of.mapInArrow(run, "l_orderkey long, l_linenumber int, reason string")


_REST_FORM = "CASE page_id % 5 WHEN 0 THEN 'https://h/fhir/Patient/p' || page_id WHEN 1 THEN 'https://h/fhir/Patient/p' || page_id || '/_history/' || (page_id % 7) WHEN 2 THEN url WHEN 3 THEN 'Patient/p' || page_id ELSE '#c' || page_id END"


@query(f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://h/fhir/' WHEN 1 THEN 'https://h/fhir/' END AS base, CASE WHEN page_id % 5 < 2 THEN 'Patient/p' || page_id END AS relative, CASE WHEN page_id % 5 = 1 THEN CAST(page_id % 7 AS VARCHAR) END AS version,
    CASE page_id % 5 WHEN 3 THEN 'relative' WHEN 4 THEN 'contained' ELSE 'absolute' END AS mode, CASE page_id % 5 WHEN 1 THEN 'https://h/fhir/Patient/p' || page_id ELSE {_REST_FORM} END AS alias FROM pages""")
def reference_lookups(spark, sf_dir):
    """How a literal is looked up, and urls of resources in parts, as unpacking does it."""

    def parts(k, literal):
        found, how = rest_parts(literal), lookup(literal, None)
        return k, *(found or (None, None, None)), how["mode"], how["alias"]

    return mapped(read(spark, sf_dir, "pages").select("page_id", F.expr(_REST_FORM)), "page_id long, base string, relative string, version string, mode string, alias string", parts)


@query("SELECT event_id, lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS elapsed FROM (SELECT event_id, event_id * 7 % 300000 AS s FROM events)")
def elapsed_times(spark, sf_dir):
    """Seconds as progress shows them."""
    return mapped(read(spark, sf_dir, "events").select("event_id"), "event_id long, elapsed string", lambda k: (k, hms(k * 7 % 300000 + 0.9)))


@query("""SELECT n_nationkey, (n_nationkey - 3) / 100.0 = 0 OR ((n_nationkey - 3) / 100.0 >= 0.01 AND n_nationkey < 103) AS strength_fits, n_nationkey >= 5 AS days_fit FROM nation""")
def settings_gate(spark, sf_dir):
    """Strengths and ranges of days that a run accepts."""

    def fits(**settings):
        try:
            perturbation.validate_settings(**settings)
            return True
        except InputError:
            return False

    return mapped(read(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey int, strength_fits boolean, days_fit boolean", lambda k: (k, fits(strength=Decimal(k - 3) / 100, date_shift_days=1), fits(strength=0, date_shift_days=k - 5)))


_BASE_FORM = "CASE page_id % 6 WHEN 0 THEN 'https://h/fhir/' || page_id || '//' WHEN 1 THEN 'http://h?x=' || page_id WHEN 2 THEN 'https://u:p@h/' || page_id WHEN 3 THEN 'ftp://h/' || page_id WHEN 4 THEN 'https://h/#' || page_id ELSE 'https://h/a b' || page_id END"


@query("SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'https://h/fhir/' || page_id END AS base FROM pages")
def base_urls(spark, sf_dir):
    """A server's base url, slashes at the end left out; others are refused."""

    def normal(k, url):
        try:
            return k, exports.normalize_base_url(url)
        except InputError:
            return k, None

    return mapped(read(spark, sf_dir, "pages").select("page_id", F.expr(_BASE_FORM)), "page_id long, base string", normal)


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS place FROM customer")
def document_order(spark, sf_dir):
    """Places in a global order, numbered by ranges and not in one task."""
    return ranks.numbered(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment", "c_custkey"], "place").select("c_custkey", "place")


@query("SELECT * FROM (VALUES (1, 'people.ndjson'), (2, 'talks.ndjson'), (3, 'visits.ndjson.gz'), (4, 'wards.json')) AS t(source, file)")
def export_discovery(spark, sf_dir):
    """Files of an export, found and ordered."""
    files, _ = exports.discover(spark, [export(spark, sf_dir)], _folder(spark) / "nothing")
    return spark.createDataFrame([(i, f.path.rsplit("/", 1)[-1]) for i, f in enumerate(files, 1)], "source int, file string")


@query("SELECT * FROM (VALUES ('as it was', false), ('schema_version', true), ('status', true), ('algorithm', true), ('run_key', true), ('source_fingerprint', true), ('definitions', true), ('settings', true)) AS t(changed, refused)")
def prior_state_gates(spark, sf_dir):
    """A key is taken over from a state file only if all of it fits."""
    from ..sources.files import Place
    from .index import open_index

    settings = perturbation.validate_settings(Decimal("0.16"), 30)
    source = indexed(spark, sf_dir)
    found = perturbation.fingerprint_of(spark, Place(spark, source), open_index(tidy(spark), source)[0])
    state = {"schema_version": perturbation.STATE_VERSION, "status": "completed", "algorithm": keyed.ALGORITHM, "run_key": keyed.new_key().hex(), "source_fingerprint": found, "definitions": perturbation.definitions(), "settings": {k: str(v) for k, v in settings.items()}}
    rows = []
    for name in ("as it was", *state):
        path = Place(spark, _folder(spark)) / f"gate-{len(rows)}.json"
        path.replace_text(json.dumps(state | {name: "other"}))
        try:
            perturbation.read_reuse_key(spark, path, settings, found)
            rows.append((name, False))
        except InputError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "changed string, refused boolean")
