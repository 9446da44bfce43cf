"""Index files in SQLite, of both schemas, against the same index in Parquet."""

import json
import sqlite3

import pytest

from veilgraph.errors import InputError
from veilgraph.plans import index, perturbation
from veilgraph.sources import sqlite_index
from veilgraph.sources.files import Place

from tests.samples import doc, observation, person, put, quantity, ref, ward

#: Columns of the file's tables, with those that one schema has and the other hasn't.
FILE = {
    "run": "status, schema_version, fhir_version",
    "sources": "id INTEGER PRIMARY KEY, path",
    "resources": "id INTEGER PRIMARY KEY, identity, digest, resource_type, logical_id, version_id, full_url, contained, payload",
    "occurrences": "id INTEGER PRIMARY KEY, resource_id, source_id, locator, context, full_url, root_resource_id, parent_resource_id",
    "aliases": "alias, resource_id, context, kind",
    "resource_references": "id INTEGER PRIMARY KEY, occurrence_id, source_resource_id, path, literal, kind, target_resource_id, status",
    "patient_memberships": "resource_id INTEGER PRIMARY KEY, patient_resource_id, basis",
    "issues": "id INTEGER PRIMARY KEY, severity, code, source_id, locator, resource_id, detail",
}


def write_file(tables, path, version=2, status="completed"):
    base = sqlite3.connect(path)
    for name, columns in FILE.items():
        base.execute(f"CREATE TABLE {name} ({columns}{', scope' if version == 1 and name == 'resources' else ''})")
    if version == 1:
        base.execute("CREATE TABLE profiles (resource_id, canonical)")
    base.execute("INSERT INTO run VALUES (?, ?, '4.0.1')", (status, version))
    for name in FILE:
        if name in tables:
            columns = [c.split()[0] for c in FILE[name].split(", ")]
            have = [c for c in columns if c in tables[name].columns]
            rows = [tuple(int(v) if isinstance(v, bool) else v for v in r) for r in tables[name].select(*have).collect()]
            base.executemany(f"INSERT INTO {name} ({', '.join(have)}) VALUES ({', '.join('?' * len(have))})", rows)
    base.commit()
    base.close()
    return path


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """A Parquet index, and the run on it."""
    folder = tmp_path_factory.mktemp("both")
    put(folder / "in/ward.json", ward())
    inner = observation("oi", quantity("@4.20@"), encounter=ref("Encounter/none"), contained=[doc("Specimen", "inside")], specimen=ref("#inside"), subject=ref("Patient/z"))
    put(folder / "in/more.ndjson.gz", person("z"), inner, person("z"))
    index.ingest([folder / "in"], folder / "index", spark=spark)
    header = perturbation.perturb(folder / "index", folder / "out", spark=spark)
    return folder, header


@pytest.mark.parametrize("version", [1, 2])
def test_a_run_on_a_file_equals_that_on_parquet(spark, both, tmp_path, version, monkeypatch):
    folder, header = both
    monkeypatch.setattr(sqlite_index, "PART", 3)
    tables = {name: spark.read.parquet(str(folder / "index/index" / name)) for name in index.TABLES}
    path = write_file(tables, tmp_path / "odd %20 #index?.sqlite", version, "completed_with_warnings")
    before = path.read_bytes()
    found, run = index.open_index(spark, path)
    assert run["schema_version"] == version
    for name, columns in index.NEEDED.items():
        rows = lambda df: sorted(map(str, df.select(*sorted(columns)).collect()))  # noqa: B023, E731
        assert rows(found[name]) == rows(tables[name])
    again = perturbation.perturb(path, tmp_path / "out", reuse_key_from=folder / "out/intermediates", spark=spark)
    assert again == header
    for file in header["export"]["files"]:
        assert (tmp_path / "out/result/fhir" / file["file"]).read_bytes() == (folder / "out/result/fhir" / file["file"]).read_bytes()
    assert (tmp_path / "out/result/reports/perturbation-report.json").read_bytes() == (folder / "out/result/reports/perturbation-report.json").read_bytes()
    assert path.read_bytes() == before and sorted(p.name for p in tmp_path.iterdir()) == [path.name, "out"]


def test_parts_and_columns(spark, both, tmp_path):
    folder, _ = both
    tables = {name: spark.read.parquet(str(folder / "index/index" / name)) for name in index.TABLES}
    path = write_file(tables, tmp_path / "a.sqlite")
    found = sqlite_index.open_file(spark, Place(spark, path), part=4)
    assert found["resources"].rdd.getNumPartitions() == -(-tables["resources"].count() // 4)
    assert found["issues"].filter("severity = 'error'").count() == 0
    options = {"table": "resources", "state": sqlite_index.stamp(str(path)), "path": str(path)}
    few = spark.read.format("veilgraph_index_file").options(**options).schema("resource_type string, id long").load()
    assert few.columns == ["resource_type", "id"] and {tuple(r) for r in few.collect()} == {tuple(r) for r in tables["resources"].select("resource_type", "id").collect()}
    # a change between planning and reading is no silent mixture
    with sqlite3.connect(path) as base:
        base.execute("UPDATE resources SET resource_type = 'Basic'")
    base.close()
    with pytest.raises(Exception, match="changed while it was read"):
        found["resources"].collect()


def test_files_that_are_no_index(spark, both, tmp_path):
    folder, _ = both
    tables = {name: spark.read.parquet(str(folder / "index/index" / name)) for name in index.TABLES}
    fine = write_file(tables, tmp_path / "fine.sqlite")
    (tmp_path / "link.sqlite").symlink_to(fine)
    (tmp_path / "text.sqlite").write_text("not a database")
    cut = tmp_path / "cut.sqlite"
    cut.write_bytes(fine.read_bytes()[:3000])
    open_ = write_file(tables, tmp_path / "open.sqlite")
    (tmp_path / "open.sqlite-wal").write_bytes(b"x")
    bad = [tmp_path / "none.sqlite", tmp_path / "link.sqlite", tmp_path / "text.sqlite", cut, open_, write_file(tables, tmp_path / "v3.sqlite", 3), write_file(tables, tmp_path / "half.sqlite", 2, "in_progress"), write_file({}, tmp_path / "empty.sqlite"), write_file({**tables, "issues": spark.createDataFrame([("error", "invalid_json")], "severity string, code string")}, tmp_path / "faulty.sqlite")]
    for path in bad:
        with pytest.raises(InputError):
            index.open_index(spark, path)
    with sqlite3.connect(fine) as base:
        base.execute("ALTER TABLE resources RENAME COLUMN payload TO body")
    base.close()
    with pytest.raises(InputError):
        index.open_index(spark, fine)
    assert json.loads((folder / "index/index-run.json").read_text())["schema_version"] == 2
