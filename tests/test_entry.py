import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(folder: Path) -> list[str]:
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"}, check=True)
    return done.stdout.split()


def test_entry_works_without_the_corpus_part(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=lambda folder, found: {".git", "tests", "llm", "corpus_pipeline.py", "__pycache__"} & set(found))
    kept = names(copy)
    assert "resolve_references" in kept and not any(n.startswith("op") or n == "pipeline" for n in kept)
