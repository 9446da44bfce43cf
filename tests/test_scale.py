"""Work that grows with the input in many tasks, and does not repeat what documents have in common."""

import json
from collections import Counter

from pyspark.sql import functions as F

from veilgraph.functions import walk


def test_node_counts_walk_once_for_each_outline(spark, monkeypatch):
    documents = [{"resourceType": "Order", "key": i, "line": [{"number": j} for j in range(i % 3)], "note": [None, "x", True][i % 3]} for i in range(90)]
    df = spark.createDataFrame([(json.dumps(d),) for d in documents], "payload string").coalesce(1)
    found = {tuple(r)[:3]: r["n"] for r in walk.node_counts(df, "payload").groupBy("type", "path", "kind").agg(F.sum("n").alias("n")).collect()}
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null", int: "number"}
    expected = Counter(("Order", walk.shown(walk.statistical(s.path)), kinds[type(s.value)]) for d in documents for s in walk.walk(d, walk.types(), context=False))
    assert found == expected
    assert len({walk.sketch(d) for d in documents}) == 3
    assert walk.sketch({"a": ""}) != walk.sketch({"a": "x"}) and walk.sketch({"a": [1]}) != walk.sketch({"a": 1}) and walk.sketch({"resourceType": "A"}) != walk.sketch({"resourceType": "B"})


def test_measurements_are_dealt_out(spark):
    from veilgraph.plans import function_queries

    df = function_queries.measurement_eligibility(spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_large_files_are_written_in_parts_and_read_by_members(spark, tmp_path, monkeypatch):
    """Both are what one task makes; a member that is not whole is left to the reader of whole files."""
    import gzip
    from hashlib import sha256

    from veilgraph.sources import exports, layout
    from veilgraph.sources.files import Entry, Place

    monkeypatch.setattr(layout, "ROOTS", 40)
    monkeypatch.setattr(exports, "CUT", 10)
    line = lambda k: ("﻿" if k < 3 else "") + (" " if k % 10 == 7 else json.dumps({"id": k}))
    rows = spark.createDataFrame([(1 + k % 3, k, line(k)) for k in range(600) if k % 3 < 2 or k < 9], "source_id int, root_id long, line string").repartition(7)
    plans = [{"source_id": i, "file": name, "records": n, "compressed": name.endswith(".gz")} for i, name, n in ((1, "a.ndjson.gz", 200), (2, "b.ndjson", 200), (3, "c.ndjson.gz", 3))]
    manifest = layout.write(rows, plans, Place(spark, tmp_path / "out"))
    again = layout.write(rows.repartition(3), plans, Place(spark, tmp_path / "again"))
    assert again == manifest and [p.name for p in sorted((tmp_path / "out").iterdir())] == ["a.ndjson.gz", "b.ndjson", "c.ndjson.gz"]
    for entry, source in zip(manifest, (1, 2, 3)):
        raw = (tmp_path / "out" / entry["file"]).read_bytes()
        assert raw == (tmp_path / "again" / entry["file"]).read_bytes()
        body = gzip.decompress(raw) if entry["compressed"] else raw
        assert body.decode() == "".join(line(k) + "\n" for k in range(source - 1, 600 if source < 3 else 9, 3)) and entry["uncompressed_sha256"] == sha256(body).hexdigest()
    path = str(tmp_path / "out/a.ndjson.gz")
    size = (tmp_path / "out/a.ndjson.gz").stat().st_size
    assert len(exports.members(path, size)) == 15 and exports.members(str(tmp_path / "out/c.ndjson.gz"), 1) is None
    df = exports.scan(spark, [Entry(path, size)])
    assert df.rdd.getNumPartitions() >= 15
    expected = sorted((1, *d) for d in exports.documents_of(path, (tmp_path / "out/a.ndjson.gz").read_bytes()))
    assert sorted(tuple(r) for r in df.collect()) == expected and len(expected) == 180
    # broken in the middle
    raw = bytearray((tmp_path / "out/a.ndjson.gz").read_bytes())
    raw[exports.members(path, size)[7][0] + 40] ^= 255
    (tmp_path / "broken.ndjson.gz").write_bytes(raw)
    found = sorted(tuple(r) for r in exports.scan(spark, [Entry(str(tmp_path / "broken.ndjson.gz"), size)]).collect())
    assert found == sorted((1, *d) for d in exports.documents_of("broken.ndjson.gz", bytes(raw))) and found[-1][-1] is None


def test_measurements_are_judged_without_an_edit(monkeypatch):
    """The reasons are those that an edit gives, and nothing is drawn, written or kept for a ledger."""
    from decimal import Decimal

    from veilgraph.functions import canonical, keyed
    from veilgraph.operators import perturb

    key, unit = bytes(range(32)), {"system": "http://unitsofmeasure.org", "code": "mg"}
    quantities = [{"value": 1, **unit}, {"value": Decimal("2.50"), **unit}, {"value": "3", **unit}, {"value": 4, "code": "mg"}, {"value": 5, **unit, "code": "%"}, {"value": "", **unit}, {"value": 6, "system": ["x"], "code": "mg"}, {"value": True, **unit}]
    for quantity in quantities:
        for owned in (True, False):
            document = {"resourceType": "Observation", "id": "m", "valueQuantity": quantity, "component": [{"valueQuantity": {"value": 7, **unit}}], "extension": [{"url": "u", "valueQuantity": {"value": 8, **unit}}]}
            member = {"resource_id": 1, "resource_type": "Observation", "old_id": "m", "new_id": "pert-m", "patient_id": 9 if owned else None, "days": 0}
            made = perturb.perturb_root({"root_id": 1, "payload": canonical.render(document), "members": [member], "edges": []}, key, Decimal("0.16"))
            for path, reason in perturb.measurement_reasons(document, key, owned):
                shape = canonical.path_text(tuple(("item", None) if kind == "index" else (kind, name) for kind, name in canonical.parse(path)))
                assert reason in {a["reason"] for a in made["actions"] if a["path"] == shape}
    monkeypatch.setattr(keyed, "digest", None)
    for quantity in quantities:
        assert len(list(perturb.measurement_reasons({"resourceType": "Observation", "valueQuantity": quantity, "component": [{"valueQuantity": {"value": 7, **unit}}]}, key, True))) == 2


def test_measurements_that_differ_in_digits_are_judged_once(monkeypatch):
    """And each has the reasons that it has by itself."""
    import pyarrow as pa

    from veilgraph.functions import canonical
    from veilgraph.operators import perturb

    unit = '"system": "http://unitsofmeasure.org", "code": "mg"'
    shape = '{"resourceType": "Observation", "valueQuantity": {"value": %s, %s}, "note": [%s]}'
    values = ["12", "-340", "0.50", "0", "-0.5", "1E+4", "10.25e-3", '"12"', '"a\\"1 22"', "null", "true", "7" * 40]
    units = [unit, unit.replace("mg", "mg12"), unit.replace("mg", "mg13"), '"code": "mg"']
    texts = [shape % (v, u, n) for v in values for u in units for n in ("11, 22.5", '"12 \\\\"', '{"text": "x 1, 2"}')]
    owned = [i % 2 == 0 for i in range(len(texts))]
    each = [list(perturb.measurement_reasons(canonical.parse(t), bytes(32), o)) for t, o in zip(texts, owned)]
    found = lambda texts, owned: perturb.measurement_reasons_of(pa.array(texts), bytes(32), pa.array(owned))
    assert [list(x) for x in found(texts, owned)] == each and len({x[0][1] for x in each if x}) > 3
    long = shape % ("5", unit, f'"{"y" * perturb.LONG}"')
    assert found([long], [True]) == [(each[0][0],)]
    calls, one = [], perturb.measurement_reasons
    monkeypatch.setattr(perturb, "measurement_reasons", lambda *a: calls.append(a) or one(*a))
    assert len(found([shape % (f"{9000 + i}.4{i}", unit, "8") for i in range(500)], [True] * 500)) == 500 and len(calls) == 1
    for bad in ("012", "1.2.3", "1.", "1e5.3", "- 1", "1 2", ".5", "1" * 5000, "-", "+1"):
        for text in (shape % (bad, unit, "1"),):
            try:
                found([text], [True])
            except canonical.BadJson:
                continue
            raise AssertionError(bad)


def test_digits_are_left_out_by_column():
    """Only digits of numbers go, and a text has the same values but for these, or is no JSON, as before, whatever its neighbours in the batch."""
    import random
    from decimal import Decimal

    import pyarrow as pa

    from veilgraph.functions import canonical
    from veilgraph.operators import perturb

    short = lambda texts: perturb.without_digits(pa.array(texts, pa.string())).to_pylist()
    written = ['{"a":[12.34,-500,0.050,0]}', '["12\\"34",56]', '["\\\\",78,"90"]', "1E+45", "10e-12", "012", "99", "77", "[]", None, '"é11",22', "7" * perturb.LONG]
    assert short(written) == ['{"a":[1.3,-5,0.05,0]}', '["12\\"34",5]', '["\\\\",7,"90"]', "1E+45", "1e-12", "01", "9", "7", "[]", "", '"é11",2', "7" * perturb.LONG]
    assert short(["5"]) == ["5"] and short([]) == [] and short(["[]"]) == ["[]"] and short(["[12]", '"']) == ["[12]", '"']
    sliced = perturb.without_digits(pa.array(["11", "22", "33"]).slice(1, 1))
    assert sliced.to_pylist() == ["2"]

    def kinds(text):
        sort = lambda v: [sort(x) for x in v] if isinstance(v, list) else (type(v), v > 0, v == 0) if type(v) in (int, Decimal) else v
        try:
            return sort(canonical.parse(text))
        except canonical.BadJson:
            return None

    draw = random.Random(5)
    number = lambda: draw.choice(["", "-", "0"]) + "".join(draw.choices("0123456789", k=draw.randint(1, 3))) + draw.choice(["", ".0", ".050", ".12", "e12", "E-20", "."])
    string = lambda: '"' + "".join(draw.choices(["1", "23", "\\\\", '\\"', ":", "[", "e1"], k=draw.randint(0, 4))) + '"'
    texts = ["[" + ",".join(draw.choice([number, string])() for _ in range(draw.randint(0, 4))) + "]" for _ in range(4000)]
    found = short(texts)
    assert [kinds(t) for t in found] == [kinds(t) for t in texts] and 500 < sum(kinds(t) is None for t in texts) < 3500
    assert [short([t])[0] for t in texts[:500]] == found[:500] and sum(a != b for a, b in zip(found, texts)) > 1000
    unit = '"system": "http://unitsofmeasure.org", "code": "mg"'
    group, reasons = perturb.measurement_groups(pa.array([f'{{"resourceType": "Observation", "valueQuantity": {{"value": {5000 + i}.{i % 9 + 100}, {unit}}}}}' for i in range(900)]), bytes(32), pa.array([i % 3 == 0 for i in range(900)]))
    assert [reasons[g][0][1] for g in group.tolist()] == ["field_quantity_scale" if i % 3 == 0 else "shared_or_unassigned" for i in range(900)] and len(reasons) == 2


def test_references_are_found_by_a_walk_for_each_outline(monkeypatch):
    """Documents of one outline share a walk; values still tell fragments from other canonicals, and empty references from literals."""
    from veilgraph.operators import unpack

    walks = []
    monkeypatch.setattr(unpack, "walk", lambda *a, **k: walks.append(1) or walk.walk(*a, **k))
    monkeypatch.setattr(unpack, "_places", {})
    found = []
    for literal, canonical in (("Patient/1", "#c"), ("Patient/2", "http://h/p"), ("", "#"), ("#c", "#d")):
        one = unpack.Unpacker(1, None)
        one.text(json.dumps({"resourceType": "Observation", "id": "o", "subject": {"reference": literal}, "performer": [{"identifier": {"value": "v"}}]}), "line:1")
        one.text(json.dumps({"resourceType": "CarePlan", "id": "p", "instantiatesCanonical": [canonical]}), "line:2")
        found.append(([(r["path"], r["literal"]) for o in one.occurrences for r in o["refs"]], [i["code"] for i in one.issues]))
    fault = "logical_reference_unresolved"
    logical = (found[0][0][1][0], None)
    assert found == [
        ([("subject.reference", "Patient/1"), logical, ("instantiatesCanonical[0]", "#c")], [fault]),
        ([("subject.reference", "Patient/2"), logical], [fault]),
        ([logical], ["invalid_reference", fault]),
        ([("subject.reference", "#c"), logical, ("instantiatesCanonical[0]", "#d")], [fault]),
    ]
    assert len(walks) == 3  # an empty reference is an outline of its own


def test_numbers_of_the_index_come_from_places_and_keys_alone(spark, tmp_path, monkeypatch):
    """Payloads, names and references are in no table that is sorted for numbers, and are shuffled once."""
    from veilgraph.plans import index

    seen, shuffled, number, write = [], [], index.numbered, index.materialise

    def written(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        shuffled.append(("Join" in plan, "payload" in df.columns))
        return write(df)

    monkeypatch.setattr(index, "numbered", lambda df, *a: seen.append(set(df.columns)) or number(df, *a))
    monkeypatch.setattr(index, "materialise", written)
    visit = {"resourceType": "Observation", "id": "o", "subject": {"reference": "Patient/p"}, "device": {"reference": "#d"}, "contained": [{"resourceType": "Device", "id": "d"}]}
    lines = [{"resourceType": "Patient", "id": "p"}, visit, visit, {**visit, "id": "o2", "subject": {"reference": "Patient/lost"}}]
    (tmp_path / "a.ndjson").write_text("".join(json.dumps(x) + "\n" for x in lines))
    found = index.ingest([tmp_path / "a.ndjson"], tmp_path / "out", spark=spark)
    assert len(seen) == 2 and not any(x & {"payload", "names", "refs", "locator", "digest"} for x in seen)
    assert sum(wide for joined, wide in shuffled if joined) == 1
    assert found["counts"]["unique_resources"] == 5 and found["counts"]["duplicate_occurrences"] == 2 and found["reference_status"] == {"resolved": 5, "unresolved": 1}
    rows = spark.read.parquet(f"{tmp_path}/out/index/resources").orderBy("id").collect()
    assert [(r["identity"], r["root_id"]) for r in rows] == [("Patient/p", 1), ("Observation/o", 2), ("contained:2#d", 2), ("Observation/o2", 4), ("contained:4#d", 4)]
    owners = spark.read.parquet(f"{tmp_path}/out/index/patient_memberships").orderBy("resource_id").collect()
    assert [tuple(r) for r in owners] == [(1, 1, "direct"), (2, 1, "direct"), (3, 1, "inferred_from_context")]


def test_documents_are_rendered_by_the_compiled_encoder(monkeypatch):
    """And as the plain one does it, also where strings look like its marks."""
    from decimal import Decimal

    from veilgraph.functions import canonical

    odd = ["", "\0", 'x"\0', '"', "\\", "é", "\n\t", "\u2028", "\x7f", "😀", "\\u0000", '\\"\0"']
    for text in odd:
        for number in (Decimal("4.20"), Decimal("1E+4"), Decimal("-0.00"), 7, True, None):
            document = {"b": [text, {"z": number, text: text}, []], "a": {}, text: number}
            assert canonical.render(document) == canonical._object(document)
            assert canonical.parse(canonical.render(document)) == document
    plain = {"b": [1, {"z": Decimal("4.20")}], "a": "x"}
    monkeypatch.setattr(canonical, "_object", None)
    assert canonical.render(plain) == '{"a":"x","b":[1,{"z":4.20}]}'


def test_rows_are_scaled_in_batches_as_one_by_one(spark):
    """Ids, draws and rounding are those of the functions for single values; nothing to scale stays nothing."""
    from decimal import Decimal

    from veilgraph.functions import keyed, quantities

    key, strength, names = bytes(range(32)), Decimal("0.16"), ["plain", 'qu"ote', "back\\slash", "tab\t", "ä", ""]
    rows = [(i, names[i % 6] + str(i) * (i > 5), None if i == 7 else (i - 20) * 12_345_678_901) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, name string, cents long")
    found = {r["k"]: r for r in quantities.scaled_rows(df, key, strength, "root", "name", {"cents": "field"}, ["k"]).collect()}
    assert len(found) == len(rows)
    for k, name, cents in rows:
        root = "pert-" + keyed.label(key, "resource", [name, keyed.sha256(name)])[:32]
        assert found[k]["root"] == root
        assert found[k]["field_after"] == (None if cents is None else quantities.scale(cents, quantities.factor(key, root, [["key", "field"]], strength)))
    texts = [f"[{i}]" for i in range(500)]
    assert keyed.draws(key, "contact-number", [*texts, None], 61) == [*(keyed.below(key, "contact-number", [i], 61) for i in range(500)), None]
    most = (1 << 255) + 1  # nearly every second digest is not fair
    assert keyed.draws(key, "x", texts[:50], most) == [keyed.below(key, "x", [i], most) for i in range(50)]


def test_quantiles_of_values_without_a_sort(spark):
    """Plain values are summed up without sorting whole groups; a missing value counts and has the highest rank, as in SQL."""
    from veilgraph.operators import statistics

    rows = [("a", v, n) for v, n in ((3, 2), (1, 1), (9, 4), (None, 3))] + [("b", 5, 1)]
    found = statistics.nearest_rank(spark.createDataFrame(rows, "g string, v long, c long"), ["g"], ["v"], "v", "c")
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["g"]: tuple(r)[1:] for r in found.collect()} == {"a": (10, 1, 9, 1, 3, 9, None, None), "b": (1, 5, 5, 5, 5, 5, 5, 5)}


def test_hierarchies_send_no_table_through_the_driver(spark):
    """The rounds of pointers and of peeling shuffle both sides, however small, so that what reaches the driver doesn't grow with the nodes."""
    from veilgraph.operators import graph, hot

    many, few = spark.range(50).selectExpr("id AS k", "id % 3 AS x"), spark.range(40).selectExpr("id AS j", "id AS y")
    plan = lambda **how: hot.join(many, few, [("k", "j")], "left", unique=True, **how)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan() and "Broadcast" not in plan(shuffled=True)
    edges = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (7, 4), (7, 6), (8, 6), (8, 5), (9, 8)]
    found = graph.tangled(spark.createDataFrame(edges, "child long, parent long"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["node"] for r in found.collect()} == {1, 2, 3, 4, 7}


def test_shuffle_files_and_intermediate_tables_go_when_they_are_done_with(spark, tmp_path):
    """Queries of a tidy session leave no shuffle behind, and a run's tables last as long as their scope, or stay with the scope outside."""
    from pathlib import Path

    from veilgraph.plans.storage import materialise, plain, scope, tidy

    def ids():
        return set(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString("\n").splitlines())

    shuffles = lambda: sum("shuffle" in i for i in ids())
    before, own = shuffles(), tidy(spark)
    wide = own.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    wide.write.parquet(str(tmp_path / "t"))
    assert len(wide.collect()) == 10 and len(wide.collect()) == 10
    assert own.read.parquet(str(tmp_path / "t")).repartition(3).count() == 10
    assert shuffles() <= before and not spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "true"
    folder = lambda df: Path(plain(df.inputFiles()[0]))
    with scope(own):
        with scope(own) as keep:
            gone, kept = materialise(own.range(5)), keep(lambda: materialise(own.range(6)))
            assert kept.join(gone, "id").count() == 5
            places = folder(gone), folder(kept)
        assert not places[0].exists() and places[1].exists() and kept.count() == 6
    assert not places[1].exists()


def test_texts_of_one_form_are_edited_and_undone_without_a_parser(monkeypatch):
    """By the same rules: lines, ledgers, actions and numbers are those of the parser; odd texts are left to it, and what was tampered with is found."""
    from decimal import Decimal

    import pyarrow as pa
    import pytest
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    from veilgraph.errors import PerturbationError
    from veilgraph.functions import canonical, keyed
    from veilgraph.operators import perturb

    key, strength = bytes(range(32)), Decimal("0.16")
    given = lambda **columns: T.StructType([T.StructField(n, T.LongType() if k is int else T.StringType()) for n, k in columns.items()])
    schema = T.StructType([T.StructField("root_id", T.LongType()), T.StructField("payload", T.StringType()), T.StructField("members", T.ArrayType(given(resource_id=int, resource_type=str, old_id=str, new_id=str, patient_id=int, days=int))), T.StructField("edges", T.ArrayType(given(owner_id=int, path=str, literal=str, replacement=str, target_id=int, fault=str)))])
    numbers = ["1.50", "-0.00", "7", "1E+4", "0.1234567", "12345678901234567890.5", "-3", "0"]
    rows = []
    for i in range(1200):
        unit = '"code":"%s","system":"http://unitsofmeasure.org"' % ["mg", "%", "mg/dL"][i // 5 % 3]
        inner = '"contained":[{"id":"d","resourceType":"Device","status":"x"}],' if i % 5 == 0 else ""
        when = ["2020-01-31T10:00:00Z", "2020-01", "never", "9999-12-31"][i // 4 % 4]
        text = '{"code":{"coding":[{"code":"%s"}]},"component":[{"valueQuantity":{%s,"value":%s}}],%s"effectiveDateTime":"%s","id":"o%d","resourceType":"Observation","subject":{"reference":"%s"},"valueInteger":%d,"valueQuantity":{%s,"value":%s}}' % (["a", "b\\\"", "ä", ""][i // 7 % 4], unit, numbers[(i + 3) % 8], inner, when, i, ["Patient/p", "Patient/\\n"][i // 11 % 2], i % 3, unit, numbers[i // 2 % 8])
        assert canonical.render(canonical.parse(text)) == text or "-0.00" not in text
        members = [{"resource_id": 2 * i, "resource_type": "Observation", "old_id": f"o{i}", "new_id": f"pert-{i}", "patient_id": 9 if i % 6 else None, "days": -(i % 3) if i % 6 else None}]
        members += [{"resource_id": 2 * i + 1, "resource_type": "Device", "old_id": "d", "new_id": f"pert-d{i}", "patient_id": None, "days": None}] if inner else []
        edges = [{"owner_id": 2 * i, "path": "subject.reference", "literal": "Patient/p", "replacement": "Patient/pert-p" if i % 4 else None, "target_id": 5 if i % 4 else None, "fault": None}]
        rows.append({"root_id": 2 * i, "payload": text, "members": members, "edges": edges})
    parsed = []
    inside = perturb._edit
    monkeypatch.setattr(perturb, "_forms", [])
    monkeypatch.setattr(perturb, "_outlines", {})
    monkeypatch.setattr(perturb, "_edit", lambda *a: parsed.append(1) or inside(*a))
    batch = pa.RecordBatch.from_pylist(rows, to_arrow_schema(schema))
    made = [r for part in perturb.perturb_batch(batch, key, strength, 64) for r in part.to_pylist()]
    assert 150 < len(rows) - len(parsed) < len(rows)  # most have something odd
    alone = [perturb.perturb_root(row, key, strength) for row in rows]
    assert [(r["line"], r["changes"], r["resource_type"]) for r in made] == [(r["line"], r["changes"], r["resource_type"]) for r in alone]
    for field, name in (("actions", ("path", "datatype", "action", "reason")), ("numbers", ("context", "path", "datatype", "phase", "value", "sort_key"))):
        sums = [Counter(), Counter()]
        for total, found in zip(sums, (made, alone)):
            for entry in (e for r in found for e in r[field]):
                total[tuple(entry[n] for n in name)] += entry["frequency"]
        assert sums[0] == sums[1]

    def check(row, out, **other):
        known = {"root_id": row["root_id"], "line": out["line"], "changes": out["changes"], "members": row["members"], "digest": keyed.sha256(canonical.render(canonical.parse(row["payload"]))), "targets": {5: "Patient/pert-p"}}
        return perturb.check_root(known | other, key, strength)

    undone = []
    slow = canonical.parse
    monkeypatch.setattr(perturb.canonical, "parse", lambda text: undone.append(1) or slow(text))
    found = [check(row, out) for row, out in zip(rows, made)]
    find = perturb.match
    monkeypatch.setattr(perturb, "match", lambda text: None)
    assert found == [check(row, out) for row, out in zip(rows, made)]
    monkeypatch.setattr(perturb, "match", find)
    nth = next(i for i, r in enumerate(rows) if "2020-01-30T" in made[i]["line"] and perturb.match(r["payload"]) and perturb.match(made[i]["line"]) and {"patient_date_shift", "reference_rewritten"} <= {c["reason"] for c in made[i]["changes"]})
    row, out = rows[nth], made[nth]
    for old, new in (("2020-01-30", "2020-01-29"), ("Patient/pert-p", "Patient/pert-q"), (f'"id":"pert-{nth}"', f'"id":"pert-x"')):
        with pytest.raises(PerturbationError):
            check(row, out, line=out["line"].replace(old, new))
        with pytest.raises(PerturbationError):  # in the ledger, too
            check(row, out, line=out["line"].replace(old, new), changes=[c | {"new_json": c["new_json"].replace(old.removeprefix('"id":'), new.removeprefix('"id":'))} for c in out["changes"]])
    for drop in range(len(out["changes"])):
        with pytest.raises(PerturbationError):
            check(row, out, changes=[c for i, c in enumerate(out["changes"]) if i != drop])


def test_columns_as_lists():
    """As `to_pylist` has them, nulls, slices and long numbers too."""
    import pyarrow as pa

    from veilgraph.functions import canonical
    from veilgraph.functions.columns import listed

    for values, kind in ((["a", None, "", "é"], pa.string()), ([b"a", None, b""], pa.binary()), ([True, None, False], pa.bool_()), ([1, None, (1 << 62) + 1, -1], pa.int64()), ([(1 << 62) + 1, 2], pa.int64()), ([], pa.int64()), ([[1], None], pa.list_(pa.int64())), ([None, None], pa.string())):
        column = pa.array(values, kind)
        for part in (column, column[1:], column[:1]):
            assert listed(part) == part.to_pylist() and [type(v) for v in listed(part)] == [type(v) for v in part.to_pylist()]
    for text in ('"a"', '""', '"é"', '"\\""', "1", "-0", "0.10", "-12.50", "1E+4", "12345678901234567890", "null", "true"):
        found = canonical.scalar(text)
        assert canonical.render(found) == canonical.render(canonical.parse(text)) and type(found) is type(canonical.parse(text))
    for text in ('"a"b"', "01", "1.", "", '"', "nul", '"\n"'):
        try:
            assert canonical.scalar(text) is None
        except canonical.BadJson:
            pass


def test_only_roots_with_dates_near_the_ends_are_taken_apart_for_ranges(spark):
    """Whether a date can narrow a range shows in its year; a range of many years is looked for in all roots."""
    from veilgraph.functions import dates
    from veilgraph.plans import perturbation

    days = 400
    texts = ["0001-01-01", "0002-12-31", "0003-01-01", "1997-03-04", "9997-12-31", "9998-06-01", "9999-12-31T10:00:00Z", "\\u0039999-12-31"]
    df = spark.createDataFrame([(t, f'{{"birthDate":"{t}","x":"a0001-b"}}') for t in texts], "day string, payload string")
    kept = {r["day"] for r in df.filter(perturbation.near_the_ends(days)).collect()}
    for text in texts[:-1]:
        low, high = dates.bounds(dates.classify(text, "dateTime")[0])
        assert text in kept or (low <= -days and high >= days)
    assert "1997-03-04" not in kept and "0003-01-01" not in kept and texts[-1] in kept
    assert perturbation.near_the_ends(30_000) is None and perturbation.near_the_ends(0) is not None


def test_sums_are_taken_once(spark, monkeypatch):
    """Quantiles of a table that is summed up are those of its rows; digests of rows are made once, however many levels there are."""
    from veilgraph.operators import statistics
    from veilgraph.plans import perturbation

    rows = [("a", v, n) for v, n in ((3, 2), (1, 1), (9, 4), (None, 3))] + [("b", 5, 1)]
    df = spark.createDataFrame(rows, "g string, v long, c long")
    both = [sorted(map(tuple, statistics.nearest_rank(df, ["g"], ["v"], "v", "c", summed=s).collect())) for s in (False, True)]
    assert both[0] == both[1]
    plans, write = [], perturbation.materialise
    monkeypatch.setattr(perturbation, "LEAVES", 4)
    monkeypatch.setattr(perturbation, "materialise", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    rows = spark.range(1, 60).selectExpr("id", "CAST(id AS STRING) AS t")
    digest = perturbation.ordered_digest(rows, ["id", "t"], "id")
    assert len(plans) == 2 and sum("Range" in p for p in plans) == 1 and digest == perturbation.ordered_digest(rows.repartition(5), ["id", "t"], "id")
