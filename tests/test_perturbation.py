"""Perturbation of indexed exports: invariants, reuse of keys, and mutation of what is checked."""

import gzip
import json
from decimal import Decimal

import pytest

from veilgraph import cli
from veilgraph.errors import InputError, PerturbationError
from veilgraph.functions import canonical, keyed, walk
from veilgraph.operators import perturb as kernel
from veilgraph.plans import index, perturbation, workflow
from veilgraph.sources import layout

from tests.samples import bundle, doc, observation, person, put, quantity, ref, text, ward

KEY = bytes(range(32))


def member(resource_id, kind, old, patient=None, days=None) -> dict:
    return {"resource_id": resource_id, "resource_type": kind, "old_id": old, "new_id": f"pert-{resource_id}", "patient_id": patient, "days": days}


def perturbed(value, members=None, edges=(), strength="0.16"):
    payload = canonical.render(canonical.parse(text(value)))
    members = members or [member(1, value["resourceType"], value.get("id"), 7, 5)]
    out = kernel.perturb_root({"root_id": 1, "payload": payload, "members": members, "edges": list(edges)}, KEY, Decimal(strength))
    check = {"root_id": 1, "line": out["line"], "changes": out["changes"], "members": members, "digest": keyed.sha256(payload), "targets": {e["target_id"]: e["replacement"] for e in edges}}
    return json.loads(out["line"], parse_float=Decimal), out, check


def test_edits_keep_the_shape_and_undo():
    value = person("p", active=True, multipleBirthInteger=2, extension=[{"url": "u", "valueHumanName": {"family": "X"}, "valueDate": "2020-01-01"}])
    after, out, check = perturbed(value)
    assert after["id"] == "pert-1" and after["birthDate"] == "1980-05-11" and after["active"] is True
    assert len(after["name"][0]["given"]) == 2 and after["name"][0]["given"][0] != "Anna"
    assert after["telecom"][0]["value"].startswith("000") and after["telecom"][0]["system"] == "phone"
    # names are replaced inside extensions too, other contents there stay
    assert after["extension"][0]["valueHumanName"]["family"] != "X" and after["extension"][0]["valueDate"] == "2020-01-01"
    assert kernel.check_root(check, KEY, Decimal("0.16"))["dates_checked"] == 1
    again, _, _ = perturbed(value)
    assert again == after


def test_documents_of_one_outline_are_walked_once(monkeypatch):
    """What values decide is decided in each document all the same, and sums of a batch are those of its roots."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    walked = []
    monkeypatch.setattr(kernel, "walk", lambda *a, **k: walked.append(1) or list(walk.walk(*a, **k)))
    monkeypatch.setattr(kernel, "_outlines", {})
    values = ["@1.50@", 7, "@0.00@", "x", "", None]
    documents = [observation(f"o{i}", quantity(values[i % 6]), effectiveDateTime=["2020-01-01", "2020-01", "never"][i % 3], subject={"reference": ["Patient/p", "#c", ""][i % 3]}) for i in range(60)]
    rows = [{"root_id": i, "payload": canonical.render(canonical.parse(text(d))), "members": [member(i, "Observation", f"o{i}", 7 if i % 4 else None, 5)], "edges": [{"owner_id": i, "path": "subject.reference", "literal": "Patient/p", "replacement": "Patient/q", "target_id": 99, "fault": None}] if i % 2 else None} for i, d in enumerate(documents)]
    alone = [kernel.perturb_root(row, KEY, Decimal("0.16")) for row in rows]
    assert len(walked) <= 24  # outlines: kinds of value, of an empty string and of absent ones
    given = lambda **columns: T.StructType([T.StructField(n, T.LongType() if k is int else T.StringType()) for n, k in columns.items()])
    schema = T.StructType([T.StructField("root_id", T.LongType()), T.StructField("payload", T.StringType()), T.StructField("members", T.ArrayType(given(resource_id=int, resource_type=str, old_id=str, new_id=str, patient_id=int, days=int))), T.StructField("edges", T.ArrayType(given(owner_id=int, path=str, literal=str, replacement=str, target_id=int, fault=str)))])
    batch = pa.RecordBatch.from_pylist(rows, to_arrow_schema(schema))
    together = [row for part in (batch.slice(0, 13), batch.slice(13)) for out in kernel.perturb_batch(part, KEY, Decimal("0.16"), 9) for row in out.to_pylist()]
    assert [(r["root_id"], r["line"], r["changes"]) for r in together] == [(r["root_id"], r["line"], r["changes"]) for r in alone]

    def sums(found, field):
        out = {}
        for entry in (e for r in found for e in r[field]):
            name = tuple(v for k, v in entry.items() if k not in ("frequency", "changed", "zero"))
            out[name] = [a + b for a, b in zip(out.get(name, [0] * 3), [entry.get(k, 0) for k in ("frequency", "changed", "zero")])]
        return out

    assert sums(together, "actions") == sums(alone, "actions") and sums(together, "numbers") == sums(alone, "numbers")
    assert sum(n for n, _, _ in sums(alone, "actions").values()) == sum(len(list(walk.walk(canonical.parse(r["payload"]), walk.types()))) for r in rows)


def test_quantities():
    value = observation("o", quantity("@100.00@"), subject=None, component=[{"valueQuantity": quantity("@100.00@")}, {"valueQuantity": quantity(5, "%")}, {"valueQuantity": {"value": 3}}, {"valueQuantity": quantity("x")}, {"valueAge": {"value": 4}}])
    del value["subject"]
    after, out, check = perturbed(value)
    first, second = after["valueQuantity"]["value"], after["component"][0]["valueQuantity"]["value"]
    assert first != second and 84 <= first <= 116 and abs(first - 100) >= 1 and first.as_tuple().exponent == -2
    reasons = {a["reason"]: a["frequency"] for a in out["actions"]}
    assert reasons["unsupported_unit"] == 1 and reasons["missing_unit"] == 1 and reasons["invalid_quantity_value"] == 1
    assert kernel.check_root(check, KEY, Decimal("0.16"))["quantities_checked"] == 2
    same, out, _ = perturbed(value, strength="0")
    assert same["valueQuantity"]["value"] == 100
    alone, out, _ = perturbed(value, [member(1, "Observation", "o")])
    assert alone["valueQuantity"]["value"] == 100 and any(a["reason"] == "shared_or_unassigned" for a in out["actions"])


def test_references_and_contained():
    value = doc("MedicationAdministration", None, contained=[doc("Medication", "m")], medicationReference=ref("#m"), subject=ref("Patient/p"), context=ref("Encounter/lost"))
    members = [member(1, "MedicationAdministration", None, 7, 1), member(2, "Medication", "m")]
    edge = lambda path, literal, target=None, to=None, fault=None: {"owner_id": 1, "path": path, "literal": literal, "target_id": target, "replacement": to, "fault": fault}
    edges = [edge("medicationReference.reference", "#m", 2, "#pert-2"), edge("subject.reference", "Patient/p", 9, "Patient/pert-9"), edge("context.reference", "Encounter/lost")]
    after, out, check = perturbed(value, members, edges)
    assert after["contained"][0]["id"] == "pert-2" and after["medicationReference"]["reference"] == "#pert-2" and after["subject"]["reference"] == "Patient/pert-9"
    assert after["context"]["reference"] == "Encounter/lost" and after["id"] == "pert-1"
    assert [c["old_present"] for c in out["changes"] if c["reason"] == "resource_id_added"] == [False]
    assert kernel.check_root(check, KEY, Decimal("0.16"))["references_checked"] == 2
    with pytest.raises(PerturbationError):
        perturbed(value, members, [edge("medicationReference.reference", "#m", 3, "#pert-3", perturbation.CROSSES)])
    with pytest.raises(PerturbationError):
        perturbed(value, members[:1], edges)


@pytest.mark.parametrize("spoil", ["value", "extra", "ledger", "date", "name", "id", "quantity"])
def test_validation_notices(spoil):
    value = observation("o", quantity("@100.00@"), effectiveDateTime="2020-01-01", note=[{"text": "t"}], contained=[person("c")])
    _, _, check = perturbed(value, [member(1, "Observation", "o", 7, 5), member(2, "Patient", "c", 7, 5)])
    line = json.loads(check["line"], parse_float=Decimal)
    if spoil == "value":
        line["valueQuantity"]["value"] = Decimal("1.00")
    elif spoil == "extra":
        line["note"][0]["text"] = "u"
    elif spoil == "ledger":
        check["changes"] = check["changes"][1:]
    elif spoil == "id":
        line["contained"][0]["id"] = "other"
    else:
        field, wrong = {"date": ("patient_date_shift", '"2020-02-02"'), "name": ("name_replaced", '"0000000000000000"'), "quantity": ("field_quantity_scale", "101.00")}[spoil]
        change = next(c for c in check["changes"] if c["reason"] == field)
        place = line
        path = canonical.parse(change["path"])
        for _, k in path[:-1]:
            place = place[k]
        place[path[-1][1]] = canonical.parse(wrong)
        change["new_json"] = wrong
    check["line"] = canonical.render(line)
    with pytest.raises(PerturbationError):
        kernel.check_root(check, KEY, Decimal("0.16"))


def test_dates_at_both_ends_stop_all_shifts():
    value = doc("Patient", "p", birthDate="0001-01-01", deceasedDateTime="9999-12-31", extension=[{"url": "u", "valueDate": "0500-01-01"}])
    root = kernel.Root(1, canonical.render(value), [member(1, "Patient", "p", 1)])
    assert kernel.date_limits(root) == {1: (0, 0)}


def test_outcomes_of_references(spark):
    mappings = spark.createDataFrame([(1, 1, "Condition", "pert-1"), (2, 2, "Patient", "pert-2"), (3, 2, "Medication", "pert-3"), (4, 1, "Medication", "pert-4")], "resource_id long, root_id long, resource_type string, new_id string")
    rows = [("a", "Patient/p", "resolved", 2), ("b", "#m", "resolved", 4), ("c", "#x", "resolved", 3), ("d", "y", "resolved", 99), ("e", "z", "unresolved", None), ("f", "t", "resolved", 2), ("f", "t", "ambiguous", None), ("a", "Patient/p", "resolved", 2)]
    refs = spark.createDataFrame([(1, path, literal, "literal", status, target) for path, literal, status, target in rows], "source_resource_id long, path string, literal string, kind string, status string, target_resource_id long")
    (row,) = perturbation._edges({"resource_references": refs}, mappings).collect()
    found = {e["path"]: (e["replacement"], e["fault"]) for e in row["edges"]}
    assert row["of_root"] == 1 and found == {"a": ("Patient/pert-2", None), "b": ("#pert-4", None), "c": ("#pert-3", perturbation.CROSSES), "d": (None, perturbation.LOST), "e": (None, None), "f": (None, None)}


def test_settings():
    assert perturbation.validate_settings(0.16, 30) == {"strength": Decimal("0.16"), "date_shift_days": 30}
    for strength, days in ((0.001, 1), (1, 1), (True, 1), ("x", 1), (0.1, -1), (0.1, True), (0.1, 1.5), (float("nan"), 1), (0.1, 10**7)):
        with pytest.raises(InputError):
            perturbation.validate_settings(strength, days)


def test_file_plan():
    sources = [(1, "/d/a.json"), (2, "/d/s/b.json.gz"), (3, "/d/c.ndjson"), (4, "/d/e.json")]
    plans = layout.plan(sources, {1: (1, "$"), 2: (3, "$.entry[0].resource"), 3: (2, "line:1")})
    assert [(p["file"], p["format"], p["bundle_unpacked"], p["records"]) for p in plans] == [("a.json", "json", False, 1), ("s/b.ndjson.gz", "ndjson", True, 3), ("c.ndjson", "ndjson", False, 2), ("e.ndjson", "ndjson", True, 0)]
    with pytest.raises(InputError):
        layout.plan([(1, "/d/a.json"), (2, "/d/A.ndjson")], {})


def test_run_reuse_and_reingestion(spark, tmp_path):
    source = tmp_path / "in"
    put(source / "ward.json", ward())
    put(source / "x/more.ndjson.gz", person("z"), observation("zo", quantity("@1.50@"), subject=ref("Patient/z")), person("z"))
    stages, counts = [], {}

    def told(stage, completed, total, unit):
        stages.append(stage)
        if completed is not None:
            counts.setdefault((stage, unit), []).append((completed, total))

    header = workflow.run_export([source], tmp_path / "one", spark=spark, progress=told)
    for (stage, unit), rose in counts.items():
        assert rose == sorted(rose, key=lambda x: x[0]) and rose[0][0] == 0 and rose[-1][0] == rose[-1][1], (stage, rose)
    assert {k: v[-1][0] for k, v in counts.items()} == {("Reading and unpacking documents", "documents"): 4, ("Editing", "roots"): 17, ("Undoing and comparing", "roots"): 17}
    assert header["status"] == "completed_with_warnings" and header["validation"]["roots_checked"] == 17 and "Editing" in stages
    assert {f["file"] for f in header["export"]["files"]} == {"ward.ndjson", "x/more.ndjson.gz"}
    lines = list(perturbation.iter_export_lines(tmp_path / "one", spark))
    assert len(lines) == 17 and "Muster" not in "".join(lines)
    report = (tmp_path / "one/result/reports/perturbation-report.json").read_text()
    state = json.loads((tmp_path / "one/intermediates/state-run.json").read_text())
    assert state["run_key"] not in report and "Muster" not in report and canonical.parse(report)["fields"]
    assert json.loads((tmp_path / "one/intermediates/run.json").read_text()) == {"status": "completed_with_warnings", "phase": "complete"}
    for place in (tmp_path / "one").rglob("*"):
        assert place.stat().st_mode & 0o077 == 0, place
    # the same key on the same index makes the same bytes
    perturbation.perturb(tmp_path / "one/intermediates", tmp_path / "two", reuse_key_from=tmp_path / "one/intermediates", spark=spark)
    for name in ("ward.ndjson", "x/more.ndjson.gz"):
        assert (tmp_path / "one/result/fhir" / name).read_bytes() == (tmp_path / "two/result/fhir" / name).read_bytes()
    with pytest.raises(InputError):
        perturbation.perturb(tmp_path / "one/intermediates", tmp_path / "three", strength=0.2, reuse_key_from=tmp_path / "one/intermediates", spark=spark)
    # what comes out is indexed as what went in
    again = index.ingest([tmp_path / "one/result/fhir"], tmp_path / "again", spark=spark)
    before = json.loads((tmp_path / "one/result/reports/report.json").read_text())
    assert again["reference_status"] == before["reference_status"] and again["resource_types"] == before["resource_types"]
    assert gzip.decompress((tmp_path / "one/result/fhir/x/more.ndjson.gz").read_bytes()).count(b"\n") == 2
    summaries = spark.read.parquet(str(tmp_path / "one/intermediates/state/numeric_summaries"))
    assert summaries.filter("phase = 'before'").count() > 0


def test_failed_ingestion_ends_the_run(spark, tmp_path):
    with pytest.raises(InputError):
        workflow.run_export([put(tmp_path / "a.ndjson", raw="{bad\n")], tmp_path / "out", spark=spark)
    assert json.loads((tmp_path / "out/intermediates/run.json").read_text()) == {"status": "failed", "phase": "ingestion"}
    with pytest.raises(InputError):
        workflow.run_export([tmp_path / "a.ndjson"], tmp_path / "out", spark=spark)


def test_command_line(spark, tmp_path, capsys):
    source = put(tmp_path / "w.json", bundle((None, person())))
    assert cli.main(["ingest", "--input", str(source), "--output", str(tmp_path / "i")]) == 0
    assert cli.main(["perturb", "--input", str(tmp_path / "i"), "--output", str(tmp_path / "p")]) == 0
    assert cli.main(["ingest", "--input", str(source), "--output", str(tmp_path / "i")]) == 2
    out = capsys.readouterr()
    assert "1 roots" in out.out and "veilgraph ingest: There is something" in out.err
