import hashlib
import hmac
from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilgraph.functions import canonical, dates, keyed, quantities, walk
from veilgraph.operators import perturb

KEY = bytes(range(32))


def test_canonical_text_keeps_written_numbers():
    text = '{"b": [4.20, 1E+4, -0.0, 12345678901234567890.0012300], "a": "\\u00e4\\n", "c": {"z": null, "y": true}}'
    assert canonical.render(canonical.parse(text)) == '{"a":"ä\\n","b":[4.20,1E+4,-0.0,12345678901234567890.0012300],"c":{"y":true,"z":null}}'
    assert canonical.path_text((("key", "a.b[0]"), ("index", 2), ("key", "value"))) == '[["key", "a.b[0]"], ["index", 2], ["key", "value"]]'
    assert canonical.pretty({"a": [Decimal("1.50")], "b": {}}) == '{\n  "a": [\n    1.50\n  ],\n  "b": {}\n}'


@pytest.mark.parametrize("text", ['{"a": NaN}', '{"a": 1, "a": 2}', '"\\ud800"', "{", "[" * 100_000, ""])
def test_strict_parsing_rejects(text):
    with pytest.raises(canonical.BadJson):
        canonical.parse(text)


def test_label_vector():
    assert keyed.label(KEY, "identifier", ["urn:test", "123"]) == "fce8bb733e64c6d82a824050f5fbdd9c5f8ef86a02dcfec15b9f9d8457e915b0"
    assert keyed.label(KEY, "x", (("key", "a"),)) == keyed.label(KEY, "x", [["key", "a"]])
    with pytest.raises(ValueError):
        keyed.label(b"short", "identifier", "x")


def test_bounded_draw_redraws_what_would_bias(monkeypatch):
    digests = iter([(1 << 256) - 1, 27])
    monkeypatch.setattr(keyed, "digest", lambda *a: next(digests).to_bytes(32, "big"))
    assert keyed.below(KEY, "p", "v", 10) == 7


def test_columns_agree_with_values(spark):
    rows = [("plain",), ('q"uo\\te',), ("line\nbreak\x01\x1f",), ("ünï",), ("",)]
    df = spark.createDataFrame(rows, "v string")
    j = keyed.json_string_col(F.col("v"))
    out = df.select("v", keyed.label_col(KEY, "name-text", j).alias("label"), *[keyed.below_col(KEY, "contact-number", j, u).alias(f"u{i}") for i, u in enumerate((2, 61, 10**10, 1 << 53))]).collect()
    for r in out:
        assert r["label"] == keyed.label(KEY, "name-text", r["v"])
        assert [r["u0"], r["u1"], r["u2"], r["u3"]] == [keyed.below(KEY, "contact-number", r["v"], u) for u in (2, 61, 10**10, 1 << 53)]
    drawn = keyed.with_draws(df, KEY, hex=("name-text", j, None), u=("contact-number", j, 61), p=("contact-number", j, 1 << 53)).collect()
    for r in drawn:
        assert (r["hex"], r["u"], r["p"]) == (keyed.label(KEY, "name-text", r["v"]), keyed.below(KEY, "contact-number", r["v"], 61), keyed.below(KEY, "contact-number", r["v"], 1 << 53))
    message = '["hmac-sha256-v1","name-text","plain",0]'
    assert out[0]["label"] == hmac.new(KEY, message.encode(), hashlib.sha256).hexdigest()


DATES = [("2020-02-29", "date"), ("2020-02-30", "date"), ("2020-02", "date"), ("2020", "dateTime"), ("2020-13", "date"), ("2020-01-01T10:00:00Z", "date"), ("2020-01-01T10:00:00Z", "instant"), ("2020-01-01", "instant"), ("2020-01-01T24:00:00Z", "dateTime"), ("2020-01-01T10:00", "dateTime"), ("2020-01-01T10:00:60.5-14:00", "dateTime"), ("2020-01-01T10:00:00+14:01", "dateTime"), ("0000-01-01", "date"), ("x", "date")]


def test_dates(spark):
    value = "2020-02-29T23:12:34.001230+05:30"
    assert dates.shift(value, 1) == "2020-03-01T23:12:34.001230+05:30"
    for kind in dates.DATE_TYPES:
        rows = [(v,) for v, k in DATES if k == kind]
        for r in spark.createDataFrame(rows, "v string").select("v", dates.classify_col(F.col("v"), kind).alias("c")).collect():
            day, why = dates.classify(r["v"], kind)
            assert r["c"] == ("full" if day else why), (r, kind)
    assert dates.classify("2020-02", "instant") == (None, dates.INVALID)
    moved = spark.createDataFrame([(value, -60), ("0999-12-31", 1)], "v string, d int").select(dates.shift_col(F.col("v"), F.col("d"))).collect()
    assert [r[0] for r in moved] == ["2019-12-31T23:12:34.001230+05:30", "1000-01-01"]


def test_factors_and_rounding(monkeypatch):
    s = Decimal("0.16")
    for n, up, expected in ((0, 1, "1.01"), (0, 0, "0.99"), (quantities.STEPS, 1, "1.16"), (quantities.STEPS, 0, "0.84")):
        monkeypatch.setattr(quantities.keyed, "below", lambda key, purpose, value, upper, n=n, up=up: n if upper > 2 else up)
        assert Fraction(*quantities.factor(KEY, "r", [], s)) == Fraction(expected)
    assert quantities.factor(KEY, "r", [], Decimal(0)) == (1, 1)
    assert quantities.scale(5, (11, 10)) == 6 and quantities.scale(15, (11, 10)) == 16 and quantities.scale(-15, (11, 10)) == -16
    assert [str(quantities.scale(Decimal(v), (11, 10))) for v in ("10.00", "-0.00", "1E+4", "0.5", "1E-7")] == ["11.00", "-0.00", "1E+4", "0.6", "1E-7"]
    assert quantities.relative_change(0, 0) is None and quantities.relative_change(-2, -3) == Decimal("-0.5")


@given(st.decimals(allow_nan=False, allow_infinity=False, min_value=-(10**12), max_value=10**12), st.integers(0, quantities.STEPS), st.booleans())
def test_scaling_is_exact(value, n, up):
    by = 1 + (1 if up else -1) * (Fraction(1, 100) + (Fraction("0.16") - Fraction(1, 100)) * Fraction(n, quantities.STEPS))
    out, step = quantities.scale(value, (by.numerator, by.denominator)), Fraction(10) ** value.as_tuple().exponent
    assert out.as_tuple().exponent == value.as_tuple().exponent and Fraction(out) == round(Fraction(value) * by / step) * step


@given(st.lists(st.decimals(allow_nan=False, allow_infinity=False, places=None), min_size=2, max_size=20))
def test_order_keys_sort_as_decimals(values):
    keys = [(quantities.order_key(str(v)), v) for v in values]
    for a, x in keys:
        for b, y in keys:
            assert (a < b) == (x < y) and (a == b) == (x == y)


def test_scaling_columns_are_exact(spark):
    rows = [(c, n, up) for c, n, up in ((0, 5, 1), (1234, 0, 0), (9999999, quantities.STEPS, 1), (705, 123456789012345, 0), (150, quantities.STEPS // 2, 1), (-150, 0, 1), (50, 0, 1), (150, 0, 1), (10**15 + 7, 77, 0))]
    df = spark.createDataFrame(rows, "cents long, n long, up long")
    for r in quantities.with_scaled(df, 16, out=(F.col("cents"), F.col("n"), F.col("up"))).collect():
        size = Fraction(1, 100) + Fraction(15, 100) * Fraction(r["n"], quantities.STEPS)
        assert r["out"] == round(r["cents"] * (1 + size if r["up"] else 1 - size))


def test_walk_types():
    t = walk.types()
    value = {"resourceType": "Observation", "_status": {"id": "x"}, "valueQuantity": {"value": 1}, "effectiveDateTime": "2020-01-01", "component": [{"valueQuantity": {"value": 2}, "valueAge": {"value": 3}}], "extension": [{"valueDate": "2020-01-01"}], "surprise": 1, "contained": [{"resourceType": "Patient", "name": [{"given": ["a"]}]}]}
    found = {walk.dotted(s.path): s for s in walk.walk(value, t)}
    kind = lambda p: found[p].datatype
    assert kind("effectiveDateTime") == "dateTime" and kind("component[0].valueQuantity.value") == "decimal" and kind("_status") == "Element"
    assert found["surprise"].reason == walk.UNKNOWN_FIELD and found["extension[0].valueDate"].reason == "extension_contents_preserved"
    assert found["component[0].valueAge"].reason == walk.UNKNOWN_FIELD
    assert found["contained[0].name[0].given[0]"].parent_type == "HumanName" and found["contained[0].name[0].given[0]"].reason is None
    nested = {"resourceType": "QuestionnaireResponse", "item": [{"item": [{"answer": [{"valueDate": "2020-01-01"}]}]}]}
    assert [s.datatype for s in walk.walk(nested, t) if s.key == "valueDate"] == ["date"]
    inline = {"resourceType": "Parameters", "parameter": [{"name": "n", "resource": {"resourceType": "Patient", "birthDate": "2020-01-01"}}]}
    assert [s.reason for s in walk.walk(inline, t) if s.key == "birthDate"] == [walk.EMBEDDED]
    odd = {"resourceType": "Unheard", "id": "x"}
    assert {s.reason for s in walk.walk(odd, t)} == {walk.UNKNOWN_TYPE}


def test_definitions_are_whole():
    """Each concrete resource of the standard has a definition, and every type that an element takes is one or is primitive."""
    t = walk.types()
    primitives = set("base64Binary boolean canonical code date dateTime decimal id instant integer markdown oid positiveInt string time unsignedInt uri url uuid xhtml".split())
    seen: set[int] = set()

    def check(elements):
        if id(elements) not in seen:
            seen.add(id(elements))
            for kinds, inner in elements.values():
                check(inner) if inner is not None else None
                assert inner is not None or set(kinds) <= primitives | t.definitions.keys() | {"Resource"}, kinds

    resources = [n for n, e in t.definitions.items() if "implicitRules" in e]
    for n in t.definitions:
        check(t.definitions[n])
    assert len(resources) == 146 and len(t.definitions) == 187


@pytest.mark.parametrize(
    ("value", "dates_at", "identifier_at"),
    [
        ({"resourceType": "DocumentReference", "date": "2020-01-01T10:00:00Z", "identifier": [{"system": "s", "value": "v"}], "context": {"period": {"start": "2020-01-01"}}}, [("date",), ("context", "period", "start")], ("identifier", 0, "value")),
        ({"resourceType": "Provenance", "recorded": "2020-01-01T10:00:00Z", "occurredDateTime": "2020-01-01", "entity": [{"what": {"identifier": {"value": "v"}}, "agent": [{"who": {"display": "x"}}]}]}, [("recorded",), ("occurredDateTime",)], ("entity", 0, "what", "identifier", "value")),
        ({"resourceType": "ExplanationOfBenefit", "created": "2020-01-01", "identifier": [{"value": "v"}], "item": [{"servicedDate": "2020-01-01", "locationAddress": {"city": "c"}}], "accident": {"date": "2020-01-01"}}, [("created",), ("item", 0, "servicedDate"), ("accident", "date")], ("identifier", 0, "value")),
        ({"resourceType": "Task", "authoredOn": "2020-01-01", "identifier": [{"value": "v"}], "input": [{"valueDateTime": "2020-01-01"}]}, [("authoredOn",), ("input", 0, "valueDateTime")], ("identifier", 0, "value")),
        ({"resourceType": "ValueSet", "date": "2020-01-01", "identifier": [{"value": "v"}], "compose": {"include": [{"filter": [{"value": "x"}]}]}, "expansion": {"timestamp": "2020-01-01"}}, [("date",), ("expansion", "timestamp")], ("identifier", 0, "value")),
    ],
)
def test_dates_and_identifiers_of_all_types(value, dates_at, identifier_at):
    import json

    member = {"resource_id": 1, "resource_type": value["resourceType"], "old_id": None, "new_id": "pert-1", "patient_id": 1, "days": 3}
    out = perturb.perturb_root({"root_id": 1, "payload": canonical.render(value), "members": [member], "edges": []}, KEY, Decimal("0.16"))
    after = json.loads(out["line"])
    at = lambda path: __import__("functools").reduce(lambda v, k: v[k], path, after)
    assert all(at(p)[:10] == "2020-01-04" for p in dates_at) and at(identifier_at).startswith("pert-")
    assert not [a for a in out["actions"] if a["reason"].startswith("unknown")]


def test_contact_kinds():
    assert perturb.contact(KEY, "phone", "1").startswith("000") and len(perturb.contact(KEY, "sms", "1")) == 13
    assert perturb.contact(KEY, "email", "1").endswith("@example.invalid") and perturb.contact(KEY, "url", "1").startswith("https://example.invalid/")
    assert len(perturb.contact(KEY, None, "1")) == 16 == len(perturb.contact(KEY, ["odd"], "1"))
    assert perturb.identifier(KEY, "urn:ietf:rfc:3986", "urn:oid:1.2").startswith("urn:oid:2.25.")
    assert perturb.identifier(KEY, "urn:ietf:rfc:3986", "urn:uuid:x").startswith("urn:uuid:")
