"""Indexing of small invented exports."""

import json
from pathlib import Path

import pytest

from veilgraph.errors import InputError
from veilgraph.operators.unpack import Unpacker, lookup, rest_parts
from veilgraph.plans import index
from veilgraph.sources import exports
from veilgraph.sources.files import Entry

from tests.samples import bundle, doc, observation, person, put, quantity, ref, text, ward


def unpacked(value, base_url=None) -> Unpacker:
    one = Unpacker(1, base_url)
    one.text(value if isinstance(value, str) else text(value), "line:1")
    return one


def codes(value) -> list[str]:
    return [i["code"] for i in unpacked(value).issues]


@pytest.mark.parametrize(
    ("value", "code"),
    [
        ("{", "invalid_json"), ('{"a": NaN}', "invalid_json"), ('{"a":1,"a":2}', "invalid_json"), ("[]", "invalid_resource"), ({"resourceType": 3}, "invalid_resource"),
        (doc("patient"), "invalid_resource_type"), (doc("Patient", "a", contained=[bundle()]), "contained_bundle_unsupported"), (bundle(type="odd"), "invalid_bundle_type"),
        (bundle(type="history"), "history_bundle_requires_snapshot"), (bundle(link=[{"relation": "next"}]), "pagination_link_present"), ({**bundle(), "entry": {}}, "invalid_bundle_entries"),
        ({**bundle(), "entry": [1]}, "invalid_bundle_entry"), ({**bundle(), "entry": [{}]}, "bundle_entry_without_resource"), ({**bundle(), "entry": [{"fullUrl": "", "resource": doc("Patient", "a")}]}, "invalid_full_url"),
        (bundle(("http://h/Patient/a/_history/1", doc("Patient", "a"))), "versioned_full_url"), (bundle(("http://h/Patient/b", doc("Patient", "a"))), "full_url_identity_mismatch"),
        (bundle(("http:///x", doc("Patient", "a"))), "invalid_full_url"), (doc("Patient", "a b"), "invalid_resource_id"), (doc("Patient"), "missing_resource_id"),
        (doc("Patient", "a", contained=[doc("Medication")]), "contained_resource_without_id"), (doc("Patient", "a", meta=[]), "invalid_meta"), (doc("Patient", "a", meta={"versionId": 1}), "invalid_version_id"),
        (doc("Patient", "a", contained={}), "invalid_contained"), (doc("Patient", "a", contained=[doc("Medication", "m", contained=[doc("Medication", "n")])]), "nested_contained_resources"),
        (doc("Patient", "a", meta={"profile": [""]}), "invalid_profile_declaration"), (doc("CapabilityStatement", "a", fhirVersion="3.0.2"), "incompatible_fhir_version_declaration"),
        (doc("Condition", "a", subject={"reference": 3}), "invalid_reference"), (doc("Condition", "a", subject={"identifier": {"value": "x"}}), "logical_reference_unresolved"),
        (observation("a", quantity(1), component={}), "invalid_observation_components"), (observation("a", quantity(1), component=[None]), "invalid_observation_component"),
        (observation("a", quantity(1), valueString="x"), "observation_value_conflict"), (observation("a", quantity(1), dataAbsentReason={}), "observation_value_conflict"),
    ],
)
def test_issue_codes(value, code):
    assert code in codes(value)


def test_deep_nesting_is_an_issue():
    value = doc("Patient", "a")
    for _ in range(70):
        value = bundle((None, value))
    assert codes(value) == ["nesting_limit"]


def test_rest_parts_and_lookup():
    assert rest_parts("https://h/fhir/Patient/p1/_history/2") == ("https://h/fhir/", "Patient/p1", "2")
    assert rest_parts("https://h/Patient/p1") == ("https://h/", "Patient/p1", None)
    for bad in ("urn:uuid:x", "https://h/fhir/Patient/p1/", "https://h/Patient/p1?x=1", "https://h/patient/p1", None, "http://[::1"):
        assert rest_parts(bad) is None
    assert lookup("#", None)["mode"] == "root" and lookup("#x", None)["mode"] == "contained"
    assert lookup("Patient/a/_history/3", None) == {"mode": "relative", "alias": "Patient/a", "version": "3"}
    assert lookup("Patient/a", "https://h/f/Observation/o")["alias"] == "https://h/f/Patient/a"
    assert lookup("urn:uuid:1", None) == {"mode": "absolute", "alias": "urn:uuid:1", "version": None}


def test_reference_lookalikes():
    refs = lambda v: [r["path"] for r in unpacked(v).occurrences[0]["refs"]]
    assert refs(doc("Claim", "a", related=[{"reference": {"value": "x"}}])) == []
    assert refs(doc("DetectedIssue", "a", reference="http://x")) == []
    assert refs(doc("Immunization", "a", education=[{"reference": "http://x"}])) == []
    assert refs(doc("ImplementationGuide", "a", definition={"resource": [{"reference": ref("Patient/x")}]})) == ["definition.resource[0].reference.reference"]
    assert refs(doc("Questionnaire", "a", item=[{"answerValueSet": "#vs"}])) == ["item[0].answerValueSet"]


def listed(spark, *paths):
    return [Entry(str(p), p.stat().st_size) for p in paths]


def plain_rows(path):
    return list(exports.documents_of(str(path), path.read_bytes()))


def test_discovery(spark, tmp_path):
    a = put(tmp_path / "in/b/x.ndjson.gz", person())
    b = put(tmp_path / "in/A.JSON", person())
    put(tmp_path / "in/readme.txt", raw="no")
    assert exports.discover(spark, [tmp_path / "in", b], tmp_path / "out")[0] == sorted(listed(spark, a, b))
    (tmp_path / "in/link.json").symlink_to(b)
    for inputs, output in (([tmp_path / "in"], "out"), ([tmp_path / "none.json"], "out"), ([tmp_path / "in/link.json"], "out"), ([b], "in"), ([tmp_path / "in/b"], "in/b/out")):
        with pytest.raises(InputError):
            exports.discover(spark, inputs, tmp_path / output)
    put(tmp_path / "hidden/_a.ndjson", person())
    with pytest.raises(InputError):
        exports.discover(spark, [tmp_path / "hidden"], tmp_path / "out")
    assert exports.normalize_base_url("https://h/fhir//") == "https://h/fhir" and exports.normalize_base_url(None) is None
    for bad in ("ftp://h", "https://u:p@h", "https://h?x=1", "https://h/#f", "https://h/a b", "https://"):
        with pytest.raises(InputError):
            exports.normalize_base_url(bad)


def test_reading_lines(spark, tmp_path, monkeypatch):
    path = put(tmp_path / "a.ndjson", raw="﻿{}\n\n  \n{bad\n{}\n")
    assert [(n, w) for n, w, _ in plain_rows(path)] == [(1, "line:1"), (4, "line:4"), (5, "line:5")]
    bad = tmp_path / "b.ndjson"
    bad.write_bytes(b"{}\n\xff\xfe\n")
    assert [t for *_, t in plain_rows(bad)][-1] is None
    broken = tmp_path / "c.ndjson.gz"
    broken.write_bytes(put(tmp_path / "d.ndjson.gz", *[person(f"p{i}") for i in range(2000)]).read_bytes()[:-400])
    rows = plain_rows(broken)
    assert rows[-1][2] is None and len(rows) > 1
    # Spark's readers bring the same rows, and a broken file stops no other; the same as a stream
    for limit in (exports.WHOLE, 100):
        monkeypatch.setattr(exports, "WHOLE", limit)
        files = listed(spark, path, bad, broken, tmp_path / "d.ndjson.gz")
        found = {tuple(r) for r in exports.scan(spark, files).collect()}
        clean = lambda rows: {(i, n, w, t and t.rstrip("\n")) for i, n, w, t in rows}
        expected = {(i, *row) for i, f in enumerate(files, 1) for row in plain_rows(Path(f.path))}
        if limit == 100:  # how far a broken stream was unpacked is up to the codec
            expected, found = ({r for r in rows if r[0] != 3} for rows in (expected, found | {(3, 0, "", None)}))
            third = sorted(tuple(r)[1:] for r in exports.scan(spark, files).filter("source_id = 3").collect())
            assert third[-1][2] is None and third[-1][0] == len(third) and [t for *_, t in third[:-1]] == [t.rstrip("\n") for *_, t in rows[: len(third) - 1]]
        assert clean(found) == clean(expected)


def test_parts_of_a_large_file(spark, tmp_path):
    body = "\ufeff" + "".join(f'{{"n": {i}}}' + ("\r\n" if i % 3 else "\n" if i % 5 else "\r") + ("\n" if i % 7 == 0 else "") for i in range(3000)) + "é" * 10
    large, small = put(tmp_path / "a.ndjson", raw=""), put(tmp_path / "b.ndjson", raw="x\ny\n")
    large.write_bytes(body.encode())
    packed = put(tmp_path / "c.jsonl.gz", raw=body)
    files = listed(spark, large, small, packed)
    plain = {(i, n, w, t.rstrip("\n")) for i, f in enumerate(files, 1) for n, w, t in plain_rows(Path(f.path))}
    for size in (1000, 1 << 30):
        df = exports.scan(spark, files, part_bytes=size)
        assert {(*r[:3], r[3].rstrip("\n")) for r in df.collect()} == plain
    assert exports.scan(spark, files, part_bytes=1000).rdd.getNumPartitions() > 20
    large.write_bytes(body.encode()[:20000] + b"\n\xff\n" + body.encode()[20000:])
    rows = sorted(tuple(r) for r in exports.scan(spark, listed(spark, large), part_bytes=1000).collect())
    assert rows[-1][3] is None and rows[-1][1] == len(body.encode()[:20000].decode("utf-8-sig").replace("\r\n", "\n").replace("\r", "\n").split("\n")) + 1


def test_rest_urls_with_odd_hosts():
    assert rest_parts("HTTP://h:80/a/b/Patient/p") == ("HTTP://h:80/a/b/", "Patient/p", None)
    assert rest_parts("https://[::1]:8080/Patient/p") == ("https://[::1]:8080/", "Patient/p", None)
    for bad in ("https:///Patient/p", "https://h/Patient/p/_history/", "ftp://h/Patient/p", "https://h/Patient/p#x", "https://hPatient/p"):
        assert rest_parts(bad) is None


def test_ward(spark, tmp_path):
    found = index.ingest([put(tmp_path / "ward.json", ward())], tmp_path / "out", spark=spark)
    assert found["status"] == "completed" and found["issues"] == []
    assert found["counts"] == {"files": 1, "resource_occurrences": 15, "unique_resources": 15, "duplicate_occurrences": 0, "patients": 2, "grouped_resources": 13}
    tables, run = index.open_index(spark, tmp_path / "out")
    assert run["schema_version"] == 2 and found["reference_status"] == {"resolved": tables["resource_references"].count()}
    owners = {r["identity"].rsplit("/", 2)[-2] + "/" + r["identity"].rsplit("/", 1)[-1]: r["basis"] for r in tables["resources"].join(tables["patient_memberships"], tables["resources"]["id"] == tables["patient_memberships"]["resource_id"]).collect()}
    assert owners["Encounter/unit"] == "inferred_from_context" and owners["Observation/o4"] == "inferred_from_context" and owners["Encounter/house"] == "direct"
    assert "Location/room" not in owners and "Medication/drug" not in owners
    assert json.loads((tmp_path / "out/report.json").read_text()) == found
    assert (tmp_path / "out/report.json").stat().st_mode & 0o777 == 0o600 and (tmp_path / "out").stat().st_mode & 0o777 == 0o700


def test_earlier_schema(spark, tmp_path):
    index.ingest([put(tmp_path / "w.json", ward())], tmp_path / "out", spark=spark)
    place = tmp_path / "out/index-run.json"
    for version, fine in ((1, True), (2, True), (3, False)):
        place.write_text(json.dumps(json.loads(place.read_text()) | {"schema_version": version}))
        if fine:
            assert index.open_index(spark, tmp_path / "out")[1]["schema_version"] == version
        else:
            with pytest.raises(InputError):
                index.open_index(spark, tmp_path / "out")


def test_whole_export_issues(spark, tmp_path):
    cyclic = [doc("Encounter", x, partOf=ref(f"Encounter/{y}")) for x, y in (("e1", "e2"), ("e2", "e1"), ("e3", "e1"))]
    put(tmp_path / "in/a.ndjson", person("a"), person("b"), *cyclic, person("a"), person("a", gender="other"))
    put(tmp_path / "in/b.ndjson", doc("Encounter", "x", subject=ref("Patient/a")), observation("y", quantity(1), subject=ref("Patient/b"), encounter=ref("Encounter/x")), observation("z", quantity(1), subject=ref("Patient/none")))
    put(tmp_path / "in/c.ndjson", raw="{bad\n\n[]\n")
    put(tmp_path / "in/d.ndjson", doc("Patient", "m", contained=[doc("Medication", "k"), doc("Medication", "k")], meta={"versionId": "2"}), doc("MedicationAdministration", "q", contained=[doc("Medication", "k")], medicationReference=ref("#k"), subject=ref("Patient/m/_history/9")))
    found = index.ingest([tmp_path / "in"], tmp_path / "out", spark=spark)
    counts = {i["code"]: i["count"] for i in found["issues"]}
    assert found["status"] == "incomplete"
    assert counts["invalid_json"] == 1 and counts["invalid_resource"] == 1 and counts["source_without_resources"] == 1
    assert counts["duplicate_resource"] == 2 and counts["conflicting_resource_identity"] == 1
    # b.ndjson's own context doesn't know Patient/a, which is ambiguous elsewhere
    assert counts["ambiguous_reference"] == 1 and counts["unresolved_reference"] == 2
    assert counts["encounter_cycle_or_dependency"] == 3
    assert found["counts"]["resource_occurrences"] - found["counts"]["unique_resources"] == found["counts"]["duplicate_occurrences"] == 2
    with pytest.raises(InputError):
        index.open_index(spark, tmp_path / "out")


def test_conflicting_owners_and_local_names(spark, tmp_path):
    one = bundle((None, person("a")), (None, doc("Encounter", "e", subject=ref("Patient/a"))), (None, observation("o", quantity(1), encounter=ref("Encounter/e"), subject=ref("Patient/b"))), (None, person("b")))
    two = bundle((None, person("a", gender="male")), (None, doc("Condition", "c", subject=ref("Patient/a"))))
    put(tmp_path / "in/1.json", one), put(tmp_path / "in/2.json", two)
    found = index.ingest([tmp_path / "in"], tmp_path / "out", spark=spark)
    counts = {i["code"]: i["count"] for i in found["issues"]}
    assert counts == {"conflicting_patient_context": 1, "conflicting_resource_identity": 1}
    assert found["reference_status"] == {"resolved": 4}


def test_nothing_to_index(spark, tmp_path):
    found = index.ingest([put(tmp_path / "a.json", raw="")], tmp_path / "out", spark=spark)
    assert {i["code"] for i in found["issues"]} == {"invalid_json", "source_without_resources", "no_resources_ingested"}
    with pytest.raises(InputError):
        index.open_index(spark, tmp_path / "nowhere")
