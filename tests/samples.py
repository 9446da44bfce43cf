"""Invented documents for the tests."""

from __future__ import annotations

import gzip
import json
from pathlib import Path

UCUM = "http://unitsofmeasure.org"


def doc(kind: str, own: str | None = None, /, **fields) -> dict:
    return {"resourceType": kind, **({"id": own} if own else {}), **fields}


def ref(target: str) -> dict:
    return {"reference": target}


def quantity(value, code="mg/dL", system=UCUM) -> dict:
    return {"value": value, "system": system, "code": code, "unit": code}


def observation(own: str, value, /, **fields) -> dict:
    base = {"status": "final", "subject": ref("Patient/p"), "code": {"coding": [{"system": "urn:codes", "code": "c1"}]}, "valueQuantity": value}
    return doc("Observation", own, **(base | fields))


def person(own="p", /, **fields) -> dict:
    base = {"birthDate": "1980-05-06", "name": [{"family": "Muster", "given": ["Anna", "Eva"]}], "identifier": [{"system": "urn:test", "value": "123"}], "telecom": [{"system": "phone", "value": "555"}, {"system": "email", "value": "a@b"}]}
    return doc("Patient", own, **(base | fields))


def bundle(*entries, **fields) -> dict:
    return {"resourceType": "Bundle", "type": "collection", "entry": [{**({"fullUrl": url} if url else {}), "resource": resource} for url, resource in entries], **fields}


def ward() -> dict:
    """Two patients on a ward: visits in three levels, measurements, medication, consent, one shared location."""
    base = "https://example.invalid/fhir/"
    subject = lambda p: {"subject": ref(f"Patient/{p}")}
    day = lambda n: f"2024-03-{n:02d}T08:30:00+01:00"
    items = [
        person("a", birthDate="1950-01-02"), person("b", birthDate="1961-11-12"),
        doc("Location", "room", status="active", name="Room 1"),
        doc("Medication", "drug", code={"text": "drug"}),
        doc("Encounter", "house", status="finished", period={"start": day(1), "end": day(9)}, **subject("a")),
        doc("Encounter", "ward", status="finished", partOf=ref("Encounter/house"), period={"start": day(2)}),
        doc("Encounter", "unit", status="finished", partOf=ref("Encounter/ward"), location=[{"location": ref("Location/room")}]),
        doc("Encounter", "visit", status="finished", location=[{"location": ref("Location/room")}], **subject("b")),
        doc("Condition", "c1", onsetDateTime="2024-02", **subject("a")),
        observation("o1", quantity("@4.20@", "mmol/L"), encounter=ref("Encounter/unit"), subject=ref("Patient/a"), effectiveDateTime=day(3)),
        observation("o2", None, subject=ref("Patient/b"), component=[{"code": {"text": "s"}, "valueQuantity": quantity(120, "mm[Hg]")}, {"code": {"text": "d"}, "valueQuantity": quantity(80, "mm[Hg]")}], effectiveDateTime=day(4)),
        observation("o3", quantity(97, "%"), subject=ref("Patient/b"), effectiveDateTime=day(5)),
        {k: v for k, v in observation("o4", quantity("@70.0@", "kg"), encounter=ref("Encounter/unit")).items() if k != "subject"},
        doc("MedicationAdministration", "m1", status="completed", medicationReference=ref("Medication/drug"), effectiveDateTime=day(6), dosage={"dose": quantity(500, "mg")}, context=ref("Encounter/unit"), **subject("a")),
        doc("Consent", "k1", status="active", patient=ref("Patient/b"), dateTime="2024-01-01"),
    ]
    for item in items:
        if item.get("valueQuantity", 0) is None:
            del item["valueQuantity"]
    return bundle(*[(f"{base}{i['resourceType']}/{i['id']}", i) for i in items])


def text(value) -> str:
    """JSON in which numbers written as "@4.20@" keep their form."""
    return json.dumps(value, ensure_ascii=False).replace('"@', "").replace('@"', "")


def put(path: Path, *documents, raw: str | None = None) -> Path:
    body = raw if raw is not None else "\n".join(map(text, documents)) + "\n"
    path.parent.mkdir(parents=True, exist_ok=True)
    if path.name.endswith(".gz"):
        path.write_bytes(gzip.compress(body.encode()))
    else:
        path.write_text(body, encoding="utf-8")
    return path
