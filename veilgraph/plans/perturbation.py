"""Perturbation of an indexed export: identities, date offsets, edits, their proof, files and reports.

Every phase is a table in the run's `state` folder; phases meet by joins on root,
resource or patient.
"""

from __future__ import annotations

import json
from datetime import date
from decimal import Decimal, InvalidOperation

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError, PerturbationError
from ..functions import canonical, keyed, walk
from ..functions.columns import listed
from ..operators import hot, perturb as kernel
from ..operators.statistics import nearest_rank
from ..progress import add, counted, notify
from ..sources import layout
from ..sources.files import Place, escaped
from . import index
from .index import DONE
from .storage import CODEC, materialise, parts, scope, spread, tidy, together

STATE_VERSION, REPORT_VERSION = 3, 2
LOWEST = Decimal("0.01")


def validate_settings(strength, date_shift_days) -> dict:
    """Settings as they are kept: an exact strength and a whole number of days."""
    try:
        exact = Decimal(str(strength))
        fine = not isinstance(strength, bool) and exact.is_finite() and (exact == 0 or LOWEST <= exact < 1)
    except InvalidOperation:
        fine = False
    days = date_shift_days
    if not fine or isinstance(days, bool) or not isinstance(days, int) or not 0 <= days < date.max.toordinal():
        raise PerturbationError("The strength is 0, or from 0.01 up to below 1; the days are a whole number from 0 that the calendar can hold.")
    return {"strength": exact, "date_shift_days": days}


def definitions() -> dict:
    """What identifies the datatype definitions in use."""
    known = walk.types()
    return {"fhir_version": known.version, "definitions_sha256": known.digest, "definitions": len(known.definitions)}


#: Digests that are joined into one at a time.
LEAVES = 4096


def ordered_digest(df: DataFrame, columns: list[str], number: str) -> str:
    """A digest of the rows in order of `number`, then of their text: of each row, then of runs of `LEAVES` numbers, then of `LEAVES` of these, up to one.

    Nothing but a run comes together in a task, and the last few digests on the driver.
    """
    text = F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(keyed.json_string_col(F.col(c)) if df.schema[c].dataType.typeName() == "string" else F.col(c).cast("string"), F.lit("null")) for c in columns]), F.lit("]"))
    level = df.select(F.col(number).alias("n"), F.sha2(text, 256).alias("h"))
    joined = lambda: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "h"))), lambda x: x["h"]), ""), 256)
    while True:
        level = level.groupBy(F.floor(F.col("n") / LEAVES).alias("run")).agg(joined().alias("h")).select(F.col("run").alias("n"), "h")
        level = materialise(level)  # the rows are summed up once, however many levels there are
        rows = level.orderBy("n").limit(LEAVES + 1).collect()
        if len(rows) <= LEAVES:
            return keyed.sha256("".join(r["h"] for r in rows))


def fingerprint(tables: dict[str, DataFrame]) -> str:
    """One digest of resources, owners and references, each in order."""
    parts = {"resources": (["id", "identity", "digest", "resource_type", "contained"], "id"), "patient_memberships": (["resource_id", "patient_resource_id", "basis"], "resource_id")}
    parts["resource_references"] = (["source_resource_id", "path", "literal", "kind", "target_resource_id", "status"], "source_resource_id")
    found = together(tables["resources"].sparkSession, *[lambda name=name, how=how: ordered_digest(tables[name], *how) for name, how in parts.items()])
    return keyed.sha256(canonical.render([*zip(parts, found)]))


_fingerprints: dict[tuple, str] = {}


def fingerprint_of(spark: SparkSession, source: Place, tables: dict[str, DataFrame]) -> str:
    """The fingerprint of the index in `source`, once for a process and its files as they are."""
    at = spark.sparkContext.applicationId, source.uri, source.stamp()
    if at not in _fingerprints:
        with scope(spark):
            _fingerprints[at] = fingerprint(tables)
    return _fingerprints[at]


def read_reuse_key(spark: SparkSession, folder, settings: dict, found: str) -> bytes:
    """The key of an earlier whole run on the same index with the same settings."""
    path = Place(spark, folder)
    path = path / "state-run.json" if path.is_folder() else path
    if not path.exists() or path.is_link() or path.is_folder():
        raise InputError("The key is taken from a state file that is there and no link.")
    try:
        run = json.loads(path.read_text())
        key = bytes.fromhex(run.get("run_key") or "")
    except (ValueError, AttributeError):
        raise InputError("No key can be read from this state file; it takes one of a finished run.") from None
    gates = (
        (run.get("schema_version") == STATE_VERSION, "The state file is not of schema 3."),
        (run.get("status") in DONE, "The run of the state file did not finish."),
        (run.get("algorithm") == keyed.ALGORITHM and len(key) == keyed.KEY_BYTES, "The state file's algorithm or key is not one that this version draws with."),
        (run.get("source_fingerprint") == found, "The state file's run was on another index."),
        (run.get("definitions") == definitions(), "The state file's run had other datatype definitions."),
        (run.get("settings") == {k: str(v) for k, v in settings.items()}, "The state file's run had another strength or range of days."),
    )
    for passed, message in gates:
        if not passed:
            raise InputError(message)
    return key


class State:
    """The run file and the tables of a run."""

    def __init__(self, spark: SparkSession, folder: Place, run: dict):
        self.spark, self.folder, self.run = spark, folder, run
        self.save()

    def save(self, **news) -> None:
        self.run |= news
        (self.folder / "state-run.json").replace_text(json.dumps(self.run) + "\n")

    def table(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder.uri}/state/{name}", compression=CODEC)
        return self.spark.read.schema(df.schema).parquet(escaped(f"{self.folder.uri}/state/{name}"))


def _mappings(tables: dict[str, DataFrame], key: bytes) -> DataFrame:
    """A row per resource: root, patient, old and new id; the key goes by closure, never into a plan's text."""

    def label(batches):
        for batch in batches:
            new = ["pert-" + keyed.label(key, "resource", [i, d])[:32] for i, d in zip(listed(batch.column("identity")), listed(batch.column("digest")))]
            names = [n for n in batch.schema.names if n != "identity"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(new, pa.string())], [*names, "new_id"])

    r = tables["resources"].select(F.col("id").alias("resource_id"), "root_id", "resource_type", F.col("logical_id").alias("old_id"), "digest", "identity")
    named = r.mapInArrow(label, "resource_id long, root_id long, resource_type string, old_id string, digest string, new_id string")
    owner = tables["patient_memberships"].select(F.col("resource_id").alias("of"), F.col("patient_resource_id").alias("patient_id"))
    return named.join(owner, F.col("resource_id") == F.col("of"), "left").drop("of")


def _members(mappings: DataFrame, patients: DataFrame | None = None) -> DataFrame:
    """For each root the resources in it, and its digest."""
    if patients is None:
        rows = mappings.withColumn("days", F.lit(None).cast("int"))
    else:
        rows = mappings.join(patients.select(F.col("patient_id").alias("p"), "days"), F.col("patient_id") == F.col("p"), "left")
    member = F.struct("resource_id", "resource_type", "old_id", "new_id", "patient_id", "days")
    own = F.max(F.when(F.col("resource_id") == F.col("root_id"), F.col("digest"))).alias("digest")
    return rows.groupBy(F.col("root_id").alias("of")).agg(F.sort_array(F.collect_list(member)).alias("members"), own)


def near_the_ends(days: int) -> Column | None:
    """Can a payload have a date that `days` would move out of the calendar? Only such dates narrow a patient's range. None where that can't be told by some years.

    A date begins with its year, unless its characters are escaped, as those of a canonical payload never are.
    """
    early, late = date.fromordinal(1 + days).year, date.fromordinal(date.max.toordinal() - days).year
    if early + date.max.year - late > 50:
        return None
    years = "|".join(f"{year:04d}" for year in (*range(1, early + 1), *range(late, date.max.year + 1)))
    return F.col("payload").rlike(rf'"(?:{years})-|\\u00[23]')


def _patients(tables: dict[str, DataFrame], mappings: DataFrame, roots: DataFrame, number: int, days: int, key: bytes) -> DataFrame:
    """(patient_id, identity, minimum_days, maximum_days, days): ranges of all dates of a patient meet before its one draw. Roots without a date that could narrow a range are not taken apart for it."""

    def limits(batches):
        for batch in batches:
            rooted = zip(batch.column("root_id").to_pylist(), batch.column("payload").to_pylist(), kernel.entries(batch.column("members")))
            rows = [(p, *span) for row in rooted for p, span in kernel.date_limits(kernel.Root(*row)).items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["p", "low", "high"])

    if (near := near_the_ends(days)) is not None:
        roots = materialise(roots.filter(near))
        number, mappings = roots.count(), mappings.join(roots.select("root_id"), "root_id", "left_semi")
    joined = roots.join(_members(mappings), F.col("root_id") == F.col("of")).select("root_id", "payload", "members")
    spans = spread(joined, number).mapInArrow(limits, "p long, low long, high long").groupBy("p").agg(F.max("low").alias("low"), F.min("high").alias("high"))
    people = tables["resources"].filter("resource_type = 'Patient'").select(F.col("id").alias("patient_id"), "identity")
    bounded = people.join(spans, F.col("patient_id") == F.col("p"), "left")
    bounded = bounded.select("patient_id", "identity", F.greatest(F.lit(-days), F.coalesce("low", F.lit(-days))).cast("int").alias("minimum_days"), F.least(F.lit(days), F.coalesce("high", F.lit(days))).cast("int").alias("maximum_days"))

    def draw(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("identity", "minimum_days", "maximum_days")))
            drawn = [low + keyed.below(key, "date-offset", name, high - low + 1) for name, low, high in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn, pa.int32())], [*batch.schema.names, "days"])

    return bounded.mapInArrow(draw, "patient_id long, identity string, minimum_days int, maximum_days int, days int")


#: What is wrong with a resolved reference, as it ends the run.
LOST, CROSSES = "A reference is resolved to a resource that is not there.", "A reference points into the inside of another root."


def _edges(tables: dict[str, DataFrame], mappings: DataFrame, tasks: int | None = None) -> DataFrame:
    """For each root what becomes of its references: (owner_id, path, literal, replacement, target_id, fault).

    References of one place and literal have an outcome together: what they are rewritten to if all are
    resolved alike, else nothing.
    """
    m = mappings.select("resource_id", "root_id", "resource_type", "new_id")
    inner = F.col("resource_id") != F.col("root_id")
    target = m.select(F.col("resource_id").alias("t"), inner.alias("inner"), F.col("root_id").alias("target_root"), F.when(inner, F.concat(F.lit("#"), "new_id")).otherwise(F.concat_ws("/", "resource_type", "new_id")).alias("to"))
    refs = tables["resource_references"].filter("kind = 'literal'").select(F.col("source_resource_id").alias("owner_id"), "path", "literal", F.struct("status", F.col("target_resource_id").alias("target_id")).alias("found"))
    # what an owner has comes together once: for the sums, and for the owner's root
    alike = refs.repartition("owner_id").groupBy("owner_id", "path", "literal").agg(F.min("found").alias("low"), F.max("found").alias("high"))
    alike = alike.withColumn("target_id", F.when((F.col("low") == F.col("high")) & (F.col("low.status") == "resolved"), F.coalesce("low.target_id", F.lit(-1)))).drop("low", "high")
    alike = alike.join(m.select(F.col("resource_id").alias("o"), F.col("root_id").alias("of_root")), F.col("owner_id") == F.col("o"))
    # most references may have one target; those without any meet nothing
    alike = alike.withColumn("wanted", F.col("target_id"))
    alike = hot.join(alike, target.withColumn("found", F.col("t")), [("wanted", "t")], "left", unique=True).withColumnRenamed("found", "t")
    fault = F.when(F.col("target_id").isNotNull() & F.col("t").isNull(), F.lit(LOST)).when(F.col("inner") & (F.col("target_root") != F.col("of_root")), F.lit(CROSSES))
    outcome = F.struct("owner_id", "path", "literal", F.col("to").alias("replacement"), "target_id", fault.alias("fault"))
    if tasks is not None:
        alike = alike.repartition(tasks, "of_root")
    return alike.groupBy("of_root").agg(F.collect_list(outcome).alias("edges"))


def _by_root(tasks: int, first: DataFrame, root: str, *others: tuple[DataFrame, str, str]) -> DataFrame:
    """Rows of roots joined with others (table, root, how), which are dealt out by root in so many parts already: none moves twice, and the wide rows are not sorted."""
    dealt = first.repartition(tasks, root)
    for df, of, how in others:
        dealt = dealt.join(df.hint("shuffle_hash"), F.col(root) == F.col(of), how)
    return dealt


def _written(roots: DataFrame, number: int, members: DataFrame, edges: DataFrame, key: bytes, strength: Decimal, counter=None) -> DataFrame:
    def run(batches):
        for batch in batches:
            for made in kernel.perturb_batch(batch, key, strength):  # what a root makes is many times its size
                add(counter, made.num_rows)
                yield made

    tasks = parts(roots.sparkSession, number)
    joined = _by_root(tasks, roots, "root_id", (members.repartition(tasks, "of"), "of", "inner"), (edges, "of_root", "left"))
    return joined.select("root_id", "payload", "members", "edges").mapInArrow(run, kernel.OUT)


def _checked(written: DataFrame, number: int, mappings: DataFrame, members: DataFrame, patients: DataFrame, key: bytes, strength: Decimal, counter=None) -> dict:
    """Undo all changes in what was written and compare digests; draw every patient's offset again."""

    def offsets(batches):
        for batch in batches:
            for name, low, high, days in zip(*(batch.column(c).to_pylist() for c in ("identity", "minimum_days", "maximum_days", "days"))):
                if days != low + keyed.below(key, "date-offset", name, high - low + 1):
                    raise PerturbationError("A patient's offset is not the one drawn for them.")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    patients.select("identity", "minimum_days", "maximum_days", "days").mapInArrow(offsets, "n long").agg(F.sum("n")).collect()
    m = mappings.select(F.col("resource_id").alias("t"), F.col("root_id").alias("t_root"), "resource_type", "new_id")
    targeted = F.array_distinct(F.filter(F.col("changes.target_id"), lambda t: t.isNotNull()))
    links = written.select("root_id", F.explode(targeted).alias("target_id"))
    links = hot.join(links, m.withColumn("met", F.col("t")), [("target_id", "met")], unique=True)
    # a contained target must lie in the same root
    meant = F.when(F.col("t") == F.col("t_root"), F.concat_ws("/", "resource_type", "new_id")).when(F.col("t_root") == F.col("root_id"), F.concat(F.lit("#"), "new_id"))
    tasks = parts(written.sparkSession, number)
    links = links.select(F.col("root_id").alias("l"), "target_id", meant.alias("meant")).repartition(tasks, "l")
    targets = links.groupBy("l").agg(F.map_from_entries(F.collect_list(F.struct("target_id", "meant"))).alias("targets"))
    rows = _by_root(tasks, written.select("root_id", "line", "changes"), "root_id", (members.repartition(tasks, "of"), "of", "inner"), (targets, "l", "left")).select("root_id", "line", "changes", "digest", "members", "targets")

    def undo(batches):
        for batch in batches:
            counts = [[], [], [], []]
            plain = [listed(batch.column(c)) for c in ("root_id", "line", "digest", "targets")]
            nested = [kernel.entries(batch.column(c)) for c in ("changes", "members")]
            for root, line, digest, targets, changes, inside in zip(*plain, *nested):
                row = {"root_id": root, "line": line, "digest": digest, "targets": dict(targets or ()), "changes": changes, "members": inside}
                for column, n in zip(counts, kernel.check_root(row, key, strength).values()):
                    column.append(n)
            add(counter, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in counts], list(kernel.CHECKED))

    sums = rows.mapInArrow(undo, ", ".join(f"{c} long" for c in kernel.CHECKED)).agg(F.count("*").alias("roots_checked"), *[F.sum(c).alias(c) for c in kernel.CHECKED]).first()
    found = {k: v or 0 for k, v in sums.asDict().items()}
    # as many were written as there are, and as many of these are the source's: each is there, once
    if not found["roots_checked"] == number == written.count():
        raise PerturbationError("The output does not hold the source's resources, each once.")
    return found


def _statistics(state: State, written: DataFrame) -> None:
    """Exact summaries of each measurement context before, after and of the changes; they stay in the state folder."""
    n = written.filter(F.size("numbers") > 0).select("resource_type", F.explode("numbers").alias("x")).select("resource_type", "x.*")
    contexts = n.filter("phase = 'before'").groupBy("context", "resource_type", "path", "datatype").agg(F.sum("frequency").alias("samples"), F.sum("changed").alias("changed"), F.sum("zero").alias("zero_baselines"))
    state.table("numeric_contexts", contexts)
    freq = state.table("numeric_frequencies", n.groupBy("context", "phase", "value", "sort_key").agg(F.sum("frequency").alias("frequency")))
    with scope(state.spark):
        state.table("numeric_summaries", nearest_rank(freq, ["context", "phase"], ["sort_key", "value"], "value", "frequency", summed=True))


def _report(folder: Place, header: dict, actions: DataFrame) -> None:
    """Header, then coverage by field; no values and no numbers of patients' measurements. There is an entry for each field of a type, whatever the data."""
    head = "".join(f"{canonical.render(k)}:{canonical.pretty(v)},\n" for k, v in header.items())
    entries = []
    for row in actions.orderBy("resource_type", "path", "datatype", "action", "reason").toLocalIterator():
        place = canonical.parse(row["path"])
        entries.append(canonical.pretty(row.asDict() | {"path": place, "display_path": walk.shown(place)}))
    (folder / "perturbation-report.json").write_text("{\n" + head + '"fields":[' + "".join(f"{',' if i else ''}\n{e}" for i, e in enumerate(entries)) + "]\n}\n")


def run(spark: SparkSession, source: Place, output: Place, settings: dict, reuse_key_from=None, *, reserved: bool = False, progress=None) -> dict:
    """Perturb the index in `source` into `output`; `reserved`: the folder is there already and holds the index."""
    spark = tidy(spark)
    with scope(spark):
        return _whole(spark, source, output, settings, reuse_key_from, reserved, progress)


def _whole(spark: SparkSession, source: Place, output: Place, settings: dict, reuse_key_from, reserved: bool, progress) -> dict:
    notify(progress, "Opening the index")
    tables, source_run = index.open_index(spark, source)
    if source_run["fhir_version"] != index.FHIR_VERSION:
        raise PerturbationError("The index is not one of FHIR R4 4.0.1.")
    notify(progress, "Summing up the index")
    found = fingerprint_of(spark, source, tables)
    notify(progress, "Planning files")
    places = materialise(layout.population(tables["occurrences"], tables["resources"]))
    sizes = {r["source_id"]: (r["n"], r["first"]) for r in places.groupBy("source_id").agg(F.count("*").alias("n"), F.min("locator").alias("first")).collect()}
    plans = layout.plan([(r["id"], r["path"]) for r in tables["sources"].orderBy("id").collect()], sizes)
    key = keyed.new_key() if reuse_key_from is None else read_reuse_key(spark, reuse_key_from, settings, found)
    work = output / "intermediates"
    if not reserved:
        output.make_folder()
        work.make_folder()
    kept = {k: str(v) for k, v in settings.items()}
    state = State(spark, work, {"schema_version": STATE_VERSION, "status": "in_progress", "phase": "preparation", "settings": kept, "source_fingerprint": found, "definitions": definitions(), "algorithm": keyed.ALGORITHM, "run_key": key.hex(), "failure_code": None})
    try:
        (work / "state").make_folder()
        header = _run(state, tables, source_run, places, plans, settings, key, output, reserved, progress)
        (work / "state").lock()
    except BaseException as error:
        failed = "interrupted" if isinstance(error, KeyboardInterrupt) else "failed"
        state.save(status=failed, failure_code=failed)
        raise
    state.save(status=header["status"], phase="complete")
    return header


def _run(state: State, tables, source_run, places, plans, settings, key, output, reserved, progress) -> dict:
    spark, strength = state.spark, settings["strength"]
    notify(progress, "Drawing new ids")
    mappings = state.table("resource_mappings", _mappings(tables, key))
    repeated = mappings.groupBy("new_id").count().filter("count > 1")
    if not repeated.limit(1).isEmpty():
        raise PerturbationError("Two resources were given one new id.")
    roots = tables["resources"].filter("NOT contained").select(F.col("id").alias("root_id"), "payload")
    number = roots.count()
    state.save(phase="date_bounds")
    notify(progress, "Drawing offsets")
    with scope(spark):
        patients = state.table("patient_parameters", _patients(tables, mappings, roots, number, settings["date_shift_days"], key))
    state.save(phase="writing")
    members = materialise(_members(mappings, patients))
    with counted(progress, spark, "Editing", number, "roots") as counter, scope(spark):
        written = state.table("written", _written(roots, number, members, _edges(tables, mappings, parts(spark, number)), key, strength, counter))
    state.save(phase="validation")
    with counted(progress, spark, "Undoing and comparing", number, "roots") as counter, scope(spark):
        validation = _checked(written, number, mappings, members, patients, key, strength, counter)
    state.save(phase="exporting")
    notify(progress, "Writing files and reading them back")
    partial = state.folder / ".result.partial"
    partial.make_folder()
    lines = written.select("root_id", "line").join(places, F.col("root_id") == F.col("resource_id"))
    manifest = layout.write(lines, plans, partial / "fhir")
    state.save(phase="aggregation")
    notify(progress, "Adding up")
    acts = written.select("resource_type", F.explode("actions").alias("a")).groupBy("resource_type", "a.path", "a.datatype", "a.action", "a.reason").agg(F.sum("a.frequency").alias("frequency"))
    changes = written.select("root_id", F.explode("changes").alias("c")).select("root_id", "c.*")
    actions, *_ = together(spark, lambda: state.table("field_actions", acts), lambda: state.table("changes", changes), lambda: _statistics(state, written))
    by_action = {r["action"]: r["n"] for r in actions.groupBy("action").agg(F.sum("frequency").alias("n")).orderBy("action").collect()}
    inner = mappings.filter("resource_id <> root_id").count()
    types = {r[0]: r[1] for r in mappings.filter("resource_id = root_id").groupBy("resource_type").count().orderBy("resource_type").collect()}
    issues = [{"severity": r[0], "code": r[1], "frequency": r[2]} for r in tables["issues"].groupBy("severity", "code").count().orderBy("severity", "code").collect()]
    warned = by_action.get(kernel.UNSUPPORTED, 0) or source_run["status"] == "completed_with_warnings"
    header = {
        "schema_version": REPORT_VERSION, "status": "completed_with_warnings" if warned else "completed", "data_classification": "perturbed_source_derived_data", "source_fingerprint": state.run["source_fingerprint"], "datatype_definitions": definitions(),
        "source_issues": issues, "population": "deduplicated_non_contained_roots_with_contained_subtrees", "resource_types": types,
        "counts": {"root_resources": validation["roots_checked"], "contained_resources": inner, "patients": patients.count(), "field_actions": by_action},
        "validation": {**validation, "preserved_content_and_structure_verified": True, "consistently_resolved_reference_targets_verified": True, "changed_dates_use_shared_offsets": True, "changed_quantities_use_independent_field_factors": True},
        "export": {"layout": "source_files", "directory": "result/fhir", "files": manifest, "files_checked": len(manifest), "records": sum(p["records"] for p in plans), "decompressed_bytes_verified": True, "resource_stream_sha256": keyed.sha256("".join(m["uncompressed_sha256"] for m in manifest))},
    }
    state.save(phase="reporting")
    notify(progress, "Reporting")
    reports = partial / "reports"
    reports.make_folder()
    _report(reports, header, actions)
    if reserved:
        for name in ("report.json", "report.txt"):
            (state.folder / name).rename(reports / name)
    # the result appears at once, when all of it is there
    partial.rename(output / "result")
    return header


def perturb(source, output_dir, *, strength=Decimal("0.16"), date_shift_days: int = 30, reuse_key_from=None, progress=None, spark: SparkSession | None = None) -> dict:
    """Perturb an index made by `ingest` into a new folder; returns the report's header."""
    settings = validate_settings(strength, date_shift_days)
    spark = spark or index.session()
    output = Place(spark, output_dir)
    if output.exists():
        raise PerturbationError("There is something at the output's place already; name a new folder.")
    return run(spark, Place(spark, source), output, settings, reuse_key_from, progress=progress)


def iter_export_lines(output, spark: SparkSession | None = None):
    """The lines of a published result, in the order of the ledger."""
    folder = Place(spark or index.session(), output) / "result"
    found = canonical.parse((folder / "reports/perturbation-report.json").read_text())
    yield from layout.read_back(folder / "fhir", found["export"]["files"])
