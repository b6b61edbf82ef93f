"""The driver contract, with the training-data operators and without them."""

import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
PROBE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q)"


@pytest.mark.parametrize("gone", [("siltworks/llm",), ("siltworks/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_the_rest_imports_without_them(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__", *(pathlib.Path(g).name for g in gone)))
    out = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert out.returncode == 0, out.stderr[-2000:]
    total, operators, pipeline = out.stdout.split()
    assert int(total) > 180 and pipeline == "False"
    assert (int(operators) > 0) == ("siltworks/llm" not in gone and (ROOT / "siltworks" / "llm").exists())
