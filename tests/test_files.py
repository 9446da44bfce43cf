"""Runs on file systems that only Spark reaches, and attempts of one task side by side."""

import gzip
import json
import os
import socket
import subprocess
import sys
import time
from pathlib import Path

import pytest

from veilgraph.errors import InputError
from veilgraph.functions import walk
from veilgraph.plans import index, perturbation, workflow
from veilgraph.sources import exports, layout
from veilgraph.sources.files import Place, file_of, same_file

from tests.samples import observation, person, put, quantity, ref, ward

ROOT = str(Path(__file__).resolve().parent.parent)


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """A URI that Python can't open, and the folder behind it."""
    folder = tmp_path_factory.mktemp("far")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.veil.link./data", f"file://{folder}")
    return "viewfs://veil/data", folder


def test_places(spark, far, tmp_path):
    for base in (far[0], str(tmp_path)):
        place = Place(spark, f"{base}/odd %20[1]/x y").make_folder()
        assert place.is_folder() and place.exists() and not (place / "no").exists()
        (place / "a{1}?.json").write_text("{}")
        with pytest.raises(Exception):
            (place / "a{1}?.json").write_text("{}")
        (place / "a{1}?.json").replace_text("[]")
        assert (place / "a{1}?.json").read_text() == "[]" and [(p.rsplit("/", 1)[-1], n, link) for p, n, link in place.walk() if not p.endswith(".crc")] == [("a{1}?.json", 2, False)]
        assert place.within(place.parent) and not place.parent.within(place)
        (place / "a{1}?.json").rename(place / "b")
        assert (place / "b").exists() and not (place / "a{1}?.json").exists()
        place.delete()
        assert not place.exists()
    assert same_file("file:///a%20b") == same_file("file:/a%20b") == file_of("/a b") and file_of("viewfs://veil/a%20b") == same_file("viewfs://veil/a%2520b")


def test_a_run_that_only_spark_reaches(spark, far, monkeypatch):
    uri, folder = far
    put(folder / "in/ward [1].json", ward())
    put(folder / "in/x/more.ndjson.gz", person("z"), observation("zo", quantity("@1.50@"), subject=ref("Patient/z")), person("z"))
    put(folder / "in/x/empty.ndjson", raw="")
    walk.types()  # of the package, and kept
    for name in ("open", "read_text", "read_bytes", "write_text", "write_bytes"):
        monkeypatch.setattr(Path, name, lambda *a, **k: pytest.fail("pathlib touches data"))
    header = workflow.run_export([f"{uri}/in"], f"{uri}/out", spark=spark)
    monkeypatch.undo()
    assert header["status"] == "completed_with_warnings" and header["validation"]["roots_checked"] == 17
    assert {f["file"]: f["records"] for f in header["export"]["files"]} == {"ward [1].ndjson": 15, "x/empty.ndjson": 0, "x/more.ndjson.gz": 2}
    lines = list(perturbation.iter_export_lines(f"{uri}/out", spark))
    assert len(lines) == 17 and all(json.loads(line) for line in lines)
    written = folder / "out/result/fhir"
    assert "".join(lines) == (written / "ward [1].ndjson").read_text() + gzip.decompress((written / "x/more.ndjson.gz").read_bytes()).decode() and (written / "x/empty.ndjson").read_bytes() == b""
    assert not [p for p in written.rglob("*") if "part-" in p.name or "_temporary" in p.name]
    # the same key makes the same bytes, here and on this machine's own paths
    perturbation.perturb(f"{uri}/out/intermediates", f"{uri}/again [2]", reuse_key_from=f"{uri}/out/intermediates", spark=spark)
    assert (folder / "again [2]/result/fhir/x/more.ndjson.gz").read_bytes() == (written / "x/more.ndjson.gz").read_bytes()
    with pytest.raises(InputError):
        index.ingest([f"{uri}/in"], f"{uri}/out", spark=spark)
    with pytest.raises(InputError):
        index.ingest([f"{uri}/in"], f"{uri}/in/out", spark=spark)
    again = index.ingest([f"{uri}/out/result/fhir"], f"{uri}/index", spark=spark)
    assert again["counts"]["unique_resources"] == 17 + header["counts"]["contained_resources"]


def test_files_of_two_systems(spark, far):
    with pytest.raises(InputError):
        layout.plan([(1, "/a/b.json"), (2, "viewfs://veil/data/c.json")], {})


def test_a_large_file_is_scanned_by_many_tasks(spark, far):
    uri, folder = far
    put(folder / "large/a.ndjson", *[person(f"p{i}") for i in range(500)])
    files, _ = exports.discover(spark, f"{uri}/large", f"{uri}/none")
    found = exports.scan(spark, files, part_bytes=10_000)
    assert found.rdd.getNumPartitions() > 10
    assert sorted((r["ordinal"], json.loads(r["text"])["id"]) for r in found.collect()) == [(i + 1, f"p{i}") for i in range(500)]


#: The first attempt at a file stops half way until a second, speculative one, on the other host, is as far.
TWO_ATTEMPTS = """
import hashlib, sys, time
from pathlib import Path
sys.path.insert(0, {root!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession
from veilgraph.sources import layout
from veilgraph.sources.files import Place

conf = {{"spark.speculation": "true", "spark.speculation.interval": "100ms", "spark.speculation.multiplier": "1.1", "spark.speculation.quantile": "0.1", "spark.speculation.minTaskRuntime": "0", "spark.speculation.efficiency.enabled": "false"}}
conf |= {{"spark.executor.memory": "500m", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.driver.host": "127.0.0.1", "spark.executorEnv.PYTHONPATH": {root!r}}}
spark = SparkSession.builder.master({master!r}).config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
attempts = {attempts!r}

class Slow:
    def __init__(self):
        self.inner, self.n = hashlib.sha256(), 0
    def update(self, data):
        self.n += 1
        if self.n == 3000 and b"slow" in data and (me := TaskContext.get()) is not None:
            mine = Path(attempts) / f"{{me.stageId()}}-{{me.partitionId()}}-{{me.attemptNumber()}}"
            mine.touch()
            other = mine.with_name(f"{{me.stageId()}}-{{me.partitionId()}}-{{1 - me.attemptNumber()}}")
            for _ in range(300):
                if other.exists():
                    break
                time.sleep(0.1)
        self.inner.update(data)
    def hexdigest(self):
        return self.inner.hexdigest()

layout.sha256 = Slow
rows = spark.range(0, 20000).selectExpr("cast(1 + id % 4 as int) AS source_id", "id AS root_id", "concat(if(id % 4 = 2, 'slow ', 'line '), id) AS line")
plans = [{{"source_id": i, "file": f"f{{i}}.ndjson" + ".gz" * (i % 2), "records": 5000, "compressed": bool(i % 2)}} for i in range(1, 5)]
manifest = layout.write(rows, plans, Place(spark, {out!r}))
print(len(manifest))
spark.stop()
"""


@pytest.fixture
def two_hosts(tmp_path):
    """The address of a cluster of two workers that have hosts of their own: a second attempt goes to another host only."""
    import pyspark

    home = Path(pyspark.__file__).parent
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_WORKER_DIR": str(tmp_path / "work"), "PYSPARK_PYTHON": sys.executable, "SPARK_DAEMON_MEMORY": "300m"}
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        port = str(s.getsockname()[1])
    started = []

    def start(*args):
        log = (tmp_path / f"log{len(started)}").open("w")
        started.append(subprocess.Popen([str(home / "bin/spark-class"), *args], env=env, stdout=log, stderr=log))

    start("org.apache.spark.deploy.master.Master", "--host", "127.0.0.1", "--port", port, "--webui-port", "0")
    time.sleep(4)
    for host in ("127.0.0.1", "127.0.0.2"):
        start("org.apache.spark.deploy.worker.Worker", "--host", host, "--webui-port", "0", "-c", "2", "-m", "800m", f"spark://127.0.0.1:{port}")
    yield f"spark://127.0.0.1:{port}"
    for process in reversed(started):
        process.terminate()
        process.wait(20)


def test_two_attempts_of_one_task_write_one_whole_file(tmp_path, two_hosts):
    (tmp_path / "attempts").mkdir()
    script = tmp_path / "run.py"
    script.write_text(TWO_ATTEMPTS.format(root=ROOT, master=two_hosts, attempts=str(tmp_path / "attempts"), out=str(tmp_path / "out")))
    done = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=240, cwd=tmp_path)
    assert done.returncode == 0 and done.stdout.split()[-1] == "4", done.stderr[-3000:]
    tried = {tuple(p.name.rsplit("-", 1)) for p in (tmp_path / "attempts").iterdir()}
    assert any((task, "1") in tried for task, attempt in tried if attempt == "0")  # both were half way at once
    for i in range(1, 5):
        path = tmp_path / "out" / (f"f{i}.ndjson" + ".gz" * (i % 2))
        body = gzip.decompress(path.read_bytes()) if i % 2 else path.read_bytes()
        assert body.decode().splitlines() == [f"{'slow' if i == 3 else 'line'} {k}" for k in range(20000) if 1 + k % 4 == i]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"f{i}.ndjson" + ".gz" * (i % 2) for i in range(1, 5)] and not (tmp_path / ".out.staging").exists()
