"""The source index: resources, occurrences, names, references, owners and issues, as Parquet tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError
from ..operators import graph, hot, references
from ..operators.ranks import numbered
from ..operators.unpack import unpack
from ..progress import counted, notify
from ..sources import exports, sqlite_index
from ..sources.files import Entry, Place, escaped
from .storage import CODEC, materialise, scope, tidy, together

SCHEMA_VERSION = 2
#: Versions that can be read: the first has no references of canonical fragments, which perturbation finds itself.
READABLE = (1, 2)
FHIR_VERSION = "4.0.1"
DONE = ("completed", "completed_with_warnings")
TABLES = ("sources", "resources", "occurrences", "aliases", "resource_references", "patient_memberships", "issues")
#: Types that a patient's export is expected to tell the patient of. Fixed values.
PATIENT_TYPES = ("Encounter", "Condition", "Observation", "Procedure", "MedicationAdministration", "Consent")
SUBJECT_PATHS = ("subject.reference", "patient.reference", "beneficiary.reference")
CONTEXT_PATHS = ("encounter.reference", "context.reference")
ORDER = ["source_id", "ordinal", "seq"]


def session() -> SparkSession:
    active = SparkSession.getActiveSession()
    return active or SparkSession.builder.appName("veilgraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _issues(df: DataFrame, severity: str, code: str, source=None, locator=None, resource=None, detail=None) -> DataFrame:
    pick = lambda c, kind: (F.col(c) if c else F.lit(None)).cast(kind)
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), pick(source, "int").alias("source_id"), pick(locator, "string").alias("locator"), pick(resource, "long").alias("resource_id"), pick(detail, "string").alias("detail"))


def build(spark: SparkSession, files: list[Entry], base_url: str | None, progress=None) -> dict[str, DataFrame]:
    """All tables of the index."""
    sources = spark.createDataFrame([(i, f.path) for i, f in enumerate(files, 1)], "id int, path string")
    with scope(spark) as keep:
        with counted(progress, spark, "Reading and unpacking documents", None, "documents") as counter:
            unpacked = materialise(unpack(exports.scan(spark, files), base_url, counter))
        with scope(spark) as keep_told:
            told = keep_told(lambda told=_told(unpacked): materialise(told))
        rows = keep(lambda: materialise(_placed(unpacked, told)))
        found = unpacked.select("source_id", "ordinal", F.explode("issues").alias("i")).select("source_id", "ordinal", "i.*")
        found = keep(lambda: materialise(found))
    identity = F.coalesce("identity", F.concat(F.lit("contained:"), "root_id", F.lit("#"), "local"))
    resources = rows.filter("new").select(F.col("resource_id").alias("id"), identity.alias("identity"), "digest", "resource_type", "logical_id", "version_id", "full_url", "contained", "root_id", "payload", "source_id", "locator")
    occ = rows.select("id", "resource_id", "source_id", "ordinal", "seq", "locator", "context", "full_url", "root_id", "parent_resource_id", "version_id", "contained", "names", "refs", "new")
    occurrences = occ.select("id", "resource_id", "source_id", "locator", "context", "full_url", F.col("root_id").alias("root_resource_id"), "parent_resource_id")

    names = occ.select("resource_id", "context", "root_id", "version_id", F.explode("names").alias("n"))
    within = F.when(F.col("n.kind") == "contained", F.concat(F.lit("contained:"), "root_id")).otherwise(F.col("context"))
    aliases = materialise(names.select(F.col("n.alias").alias("alias"), "resource_id", within.alias("context"), F.col("n.kind").alias("kind"), "version_id").distinct())

    notify(progress, "Resolving references")
    with scope(spark) as keep:
        refs = keep(lambda refs=_resolve(occ, aliases): materialise(refs))
    notify(progress, "Finding owners")
    memberships, owner_issues = _owners(resources, occurrences, refs)

    # issues: those of single documents, tied to resources, and those that only the whole shows
    where = occ.select(F.col("source_id").alias("os"), F.col("ordinal").alias("oo"), F.col("seq").alias("oq"), "resource_id", "new")
    raw = found.join(where, (F.col("source_id") == F.col("os")) & (F.col("ordinal") == F.col("oo")) & (F.col("seq") == F.col("oq")), "left")
    raw = raw.filter(~F.col("first") | F.coalesce("new", F.lit(False)))
    shown = lambda c, kind: F.when(~F.col("bare"), F.col(c)).cast(kind).alias(c)
    parts = [raw.select("severity", "code", shown("source_id", "int"), shown("locator", "string"), "resource_id", "detail")]
    parts.append(_issues(occ.filter("NOT new"), "info", "duplicate_resource", "source_id", "locator", "resource_id"))
    oldest = resources.groupBy("identity").agg(F.min("id").alias("oldest"), F.count("*").alias("n")).filter("n > 1")
    clash = resources.join(oldest.select(F.col("identity").alias("i2"), "oldest"), (F.col("identity") == F.col("i2")) & (F.col("id") > F.col("oldest")))
    parts.append(_issues(clash, "error", "conflicting_resource_identity", "source_id", "locator", "id"))
    for status, severity in (("unresolved", "warning"), ("ambiguous", "error")):
        parts.append(_issues(refs.filter(F.col("status") == status), severity, f"{status}_reference", resource="source_resource_id", detail="path"))
    parts += owner_issues
    empty = sources.join(occ.select("source_id").distinct(), F.col("id") == F.col("source_id"), "left_anti")
    parts.append(_issues(empty, "warning", "source_without_resources", "id"))
    one = spark.range(1)
    if resources.limit(1).isEmpty():
        parts.append(_issues(one, "error", "no_resources_ingested"))
    elif resources.filter("resource_type = 'Patient'").limit(1).isEmpty():
        parts.append(_issues(one, "warning", "no_patient_resources"))
    issues = parts[0]
    for part in parts[1:]:
        issues = issues.unionByName(part)
    return {
        "sources": sources, "resources": resources.drop("source_id", "locator"), "occurrences": occurrences, "aliases": aliases.drop("version_id"),
        "resource_references": refs, "patient_memberships": memberships, "issues": issues,
    }


def _told(unpacked: DataFrame) -> DataFrame:
    """(id, source_id, ordinal, seq, parent, resource_id, root_id, new) of all occurrences: these follow from places and keys alone; all other columns, payloads among them, stay behind until ids are known, and move once."""
    short = ("seq", "parent", "key", "root_key")
    keys = unpacked.select("source_id", "ordinal", F.inline(F.arrays_zip(*[F.col(f"occurrences.{c}") for c in short]))).toDF("source_id", "ordinal", *short)
    flat = numbered(keys, ORDER, "id")

    # a resource is new where its key first occurs, and is numbered in that order; a key tells of its root's
    new = numbered(flat.groupBy("key").agg(F.min("id").alias("first"), F.max("root_key").alias("root_key")), ["first"], "resource_id")
    outer = new.filter("root_key IS NULL")
    inner = new.filter("root_key IS NOT NULL").join(outer.select(F.col("key").alias("of_root"), F.col("resource_id").alias("root_id")), F.col("root_key") == F.col("of_root"), "left")
    ids = outer.withColumn("root_id", F.col("resource_id")).unionByName(inner.drop("of_root")).select(F.col("key").alias("k"), "first", "resource_id", "root_id")
    told = flat.join(ids, F.col("key") == F.col("k")).withColumn("new", F.col("id") == F.col("first"))
    return told.select("id", "source_id", "ordinal", "seq", "parent", "resource_id", "root_id", "new")


def _placed(unpacked: DataFrame, told: DataFrame) -> DataFrame:
    """All occurrences with their numbers and those of their parents; the payload where the resource is new."""
    place = told.select(F.col("source_id").alias("ps"), F.col("ordinal").alias("po"), F.col("seq").alias("pq"), F.col("resource_id").alias("parent_resource_id"))
    within = told.filter("parent IS NOT NULL").join(place, (F.col("source_id") == F.col("ps")) & (F.col("ordinal") == F.col("po")) & (F.col("parent") == F.col("pq")), "left").drop("ps", "po", "pq")
    told = told.filter("parent IS NULL").withColumn("parent_resource_id", F.lit(None).cast("long")).unionByName(within).drop("parent")
    whole = unpacked.select("source_id", "ordinal", F.explode("occurrences").alias("o")).select("source_id", "ordinal", "o.*").drop("parent", "root", "key", "root_key")
    return whole.join(told, ["source_id", "ordinal", "seq"]).withColumn("payload", F.when(F.col("new"), F.col("payload")))


def _resolve(occ: DataFrame, aliases: DataFrame) -> DataFrame:
    """References with status and target.

    One join does it: names get a prefix by kind, so that absolute names have one scope,
    contained ones that of their root, and relative ones their own and all others'.
    """
    refs = occ.select(F.col("id").alias("occurrence_id"), F.col("resource_id").alias("source_resource_id"), "context", "root_id", F.posexplode("refs").alias("at", "r"))
    refs = refs.select("occurrence_id", "source_resource_id", "context", "root_id", "at", "r.*")
    scoped = lambda kind, root: F.when(kind == "contained", F.concat(F.lit("c:"), root, F.lit(":"))).when(kind == "absolute", F.lit("a:")).otherwise(F.lit("r:"))
    inside = lambda kind: F.when(kind == "relative", F.col("context")).otherwise(F.lit(""))
    known = aliases.select(F.concat(scoped(F.col("kind"), F.substring_index("context", ":", -1)), "alias").alias("alias"), inside(F.col("kind")).alias("context"), F.col("version_id").alias("version"), F.col("resource_id").alias("resource"))
    own, looked = ("occurrence_id", "at", "source_resource_id", "path", "literal", "kind"), F.col("mode").isin("absolute", "relative", "contained")
    edges = materialise(refs.filter(looked).select(*own, F.concat(scoped(F.col("mode"), F.col("root_id")), "alias").alias("alias"), inside(F.col("mode")).alias("context"), "version"))
    found = references.resolve_relative(edges, known).select(*own, F.col("target").cast("long").alias("target_resource_id"), "status")
    others = refs.filter(~F.coalesce(looked, F.lit(False)))
    root = F.when(F.col("mode") == "root", F.col("root_id")).cast("long")
    others = others.select(*own, root.alias("target_resource_id"), F.when(F.col("kind") == "logical", "logical_unresolved").otherwise("resolved").alias("status"))
    return found.unionByName(others)


def _owners(resources: DataFrame, occurrences: DataFrame, refs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    kind = resources.select("id", "resource_type")
    # what the paths below don't ask for tells of no owner
    links = refs.filter((F.col("status") == "resolved") & F.col("path").isin(*SUBJECT_PATHS, *CONTEXT_PATHS, "partOf.reference")).select("source_resource_id", "path", "target_resource_id")
    targets = kind.filter("resource_type IN ('Patient', 'Encounter')").select(F.col("id").alias("t"), F.col("resource_type").alias("target_type"))
    links = materialise(hot.join(links, targets, [("target_resource_id", "t")], unique=True))
    patients = kind.filter("resource_type = 'Patient'").select(F.col("id").alias("node"), F.col("id").alias("owner"))
    direct = links.filter(F.col("path").isin(*SUBJECT_PATHS) & (F.col("target_type") == "Patient")).select(F.col("source_resource_id").alias("node"), F.col("target_resource_id").alias("owner"))
    seeds = patients.unionByName(direct).distinct()
    edge = lambda df, a, b: df.select(F.col(a).alias("provider"), F.col(b).alias("dependent"))
    visits = links.filter((F.col("path") == "partOf.reference") & (F.col("target_type") == "Encounter"))
    visits = visits.join(kind.filter("resource_type = 'Encounter'").select(F.col("id").alias("s")), F.col("source_resource_id") == F.col("s"), "left_semi")
    contexts = links.filter(F.col("path").isin(*CONTEXT_PATHS) & (F.col("target_type") == "Encounter"))
    inner = occurrences.filter("parent_resource_id IS NOT NULL").distinct()
    edges = edge(visits.unionByName(contexts), "target_resource_id", "source_resource_id").unionByName(edge(inner, "parent_resource_id", "resource_id"))
    with scope(seeds.sparkSession) as keep:
        owned = keep(lambda owned=graph.unique_owner(graph.ownership(seeds, edges)): materialise(owned))
    direct_nodes = seeds.select(F.col("node").alias("d")).distinct()
    basis = F.when(F.col("d").isNotNull(), "direct").otherwise("inferred_from_context")
    memberships = owned.filter("owners = 1").join(direct_nodes, F.col("node") == F.col("d"), "left").select(F.col("node").alias("resource_id"), F.col("owner").alias("patient_resource_id"), basis.alias("basis"))
    lost = kind.filter(F.col("resource_type").isin(*PATIENT_TYPES)).join(owned, F.col("id") == F.col("node"), "left_anti")
    tangled = graph.tangled(visits.select(F.col("source_resource_id").alias("child"), F.col("target_resource_id").alias("parent")))
    return memberships, [
        _issues(owned.filter("owners > 1"), "error", "conflicting_patient_context", resource="node"),
        _issues(lost, "warning", "unassigned_patient_resource", resource="id"),
        _issues(tangled, "error", "encounter_cycle_or_dependency", resource="node"),
    ]


def _counts(df: DataFrame, *by: str) -> list:
    return df.groupBy(*by).count().orderBy(*by).collect()


def report(tables: dict[str, DataFrame]) -> dict:
    spark = tables["issues"].sparkSession
    jobs = [lambda: _counts(tables["issues"], "severity", "code"), lambda: _counts(tables["resources"], "resource_type"), lambda: _counts(tables["resource_references"], "status")]
    jobs += [lambda name=name: tables[name].count() for name in ("occurrences", "sources", "patient_memberships")]
    by_issue, by_type, by_status, occurrences, files, grouped = together(spark, *jobs)
    issues = [{"severity": r[0], "code": r[1], "count": r[2]} for r in by_issue]
    severities = {i["severity"] for i in issues}
    status = "incomplete" if "error" in severities else "completed_with_warnings" if "warning" in severities else "completed"
    types = {r[0]: r[1] for r in by_type}
    unique = sum(types.values())
    return {
        "schema_version": SCHEMA_VERSION, "status": status, "data_classification": "source_patient_data_not_synthetic",
        "fhir": {"target_version": FHIR_VERSION, "profile_validation_performed": False, "hospital_version_confirmed": False},
        "counts": {"files": files, "resource_occurrences": occurrences, "unique_resources": unique, "duplicate_occurrences": occurrences - unique, "patients": types.get("Patient", 0), "grouped_resources": grouped},
        "resource_types": types, "reference_status": {r[0]: r[1] for r in by_status}, "issues": issues,
    }


def text_report(found: dict) -> str:
    """The report as lines of text, for people."""
    parts = {"Counts": found["counts"], "References": found["reference_status"], "Issues": {f"{i['severity']} {i['code']}": i["count"] for i in found["issues"]}}
    lines = [f"Index of a FHIR {found['fhir']['target_version']} export: {found['status']}", "It holds the patients' data as they are. Profiles have not been validated."]
    for title, entries in parts.items():
        lines += ["", title, *(f"{n:>12,}  {name.replace('_', ' ')}" for name, n in entries.items())]
    return "\n".join(lines) + "\n"


def write(spark: SparkSession, files: list[Entry], folder: Place, base_url: str | None, progress=None) -> dict:
    """Index the files into `folder`, which exists and is empty; the run file comes last, so a folder without it isn't whole."""
    (folder / "index").make_folder()
    spark = tidy(spark)
    with scope(spark):
        tables = build(spark, files, base_url, progress)
        notify(progress, "Writing the index")
        together(spark, *[lambda name=name, df=df: df.write.parquet(f"{folder.uri}/index/{name}", compression=CODEC) for name, df in tables.items()])
    (folder / "index").lock()
    saved = {name: spark.read.parquet(escaped(f"{folder.uri}/index/{name}")) for name in TABLES}
    notify(progress, "Reporting on the load")
    found = report(saved)
    (folder / "report.json").write_text(json.dumps(found, indent=2, ensure_ascii=False) + "\n")
    (folder / "report.txt").write_text(text_report(found))
    (folder / "index-run.json").write_text(json.dumps({"schema_version": SCHEMA_VERSION, "status": found["status"], "fhir_version": FHIR_VERSION}) + "\n")
    return found


def ingest(inputs, output, base_url: str | None = None, *, progress=None, spark: SparkSession | None = None) -> dict:
    """Index an export into a new folder and return the report. Inputs and folder are paths or URIs of any file system that Spark reaches."""
    base_url = exports.normalize_base_url(base_url)
    notify(progress, "Looking for files")
    spark = spark or session()
    files, folder = exports.discover(spark, inputs, output)
    return write(spark, files, folder.make_folder(), base_url, progress)


#: Columns that perturbation reads.
NEEDED = {
    "sources": {"id", "path"}, "resources": {"id", "identity", "digest", "resource_type", "logical_id", "contained", "root_id", "payload"}, "occurrences": {"id", "resource_id", "source_id", "locator"},
    "resource_references": {"source_resource_id", "path", "literal", "kind", "status", "target_resource_id"}, "patient_memberships": {"resource_id", "patient_resource_id", "basis"}, "issues": {"severity", "code"},
}


def _of_folder(spark: SparkSession, folder: Place) -> tuple[dict[str, DataFrame], dict]:
    try:
        return {name: spark.read.parquet(escaped(f"{folder.uri}/index/{name}")) for name in NEEDED}, json.loads((folder / "index-run.json").read_text())
    except Exception:
        raise InputError("The folder holds no index that can be read.") from None


def _of_file(spark: SparkSession, file: Place) -> tuple[dict[str, DataFrame], dict]:
    """An index in SQLite. What its tables hold is written to the shared folder at once, as it will be read many times."""
    found = sqlite_index.open_file(spark, file)
    try:
        runs = found["run"].limit(2).collect()
        if len(runs) != 1:
            raise InputError("The index file tells of no run, or of several.")
        return _copied(spark, found), runs[0].asDict()
    except Exception as error:
        if "sqlite3." in str(error):  # a task met what is no database
            raise InputError("The index file is no SQLite file of an index that can be read.") from None
        raise


def _copied(spark: SparkSession, found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    inner = F.col("identity").substr(F.lit(len("contained:") + 1), F.length("identity"))
    root = F.when(F.col("contained"), F.substring_index(inner, "#", 1).cast("long")).otherwise(F.col("id"))
    found["resources"] = found["resources"].withColumn("root_id", root)
    return dict(zip(NEEDED, together(spark, *[lambda name=name: materialise(found[name]) for name in NEEDED])))


def open_index(spark: SparkSession, folder) -> tuple[dict[str, DataFrame], dict]:
    """Tables and run of a whole and clean index, a folder that `ingest` has made or an index file in SQLite; raises InputError for any other."""
    folder = Place(spark, folder)
    if folder.is_link() or not folder.exists():
        raise InputError("The index is a folder or an index file that is there and no link.")
    tables, run = _of_folder(spark, folder) if folder.is_folder() else _of_file(spark, folder)
    if run.get("schema_version") not in READABLE:
        raise InputError("The index is of another schema than 1 or 2.")
    if run.get("status") not in DONE:
        raise InputError("The index was not finished.")
    if any(not columns <= set(tables[name].columns) for name, columns in NEEDED.items()):
        raise InputError("The folder holds no index that can be read.")
    if not tables["issues"].filter("severity = 'error'").limit(1).isEmpty():
        raise InputError("The index tells of errors in the export; mend these first.")
    if tables["resources"].filter("NOT contained").limit(1).isEmpty():
        raise InputError("The index holds no resource of its own standing.")
    return tables, run
