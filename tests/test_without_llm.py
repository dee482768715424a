"""The rest works without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_llm(tmp_path):
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "arcwise", tmp_path / "arcwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'aon_flow' in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ":".join(p for p in sys.path if "site-packages" in p)})


def test_other_tests_without_llm(tmp_path):
    """The other tests are all there, and import, without the folders of the training-data operators."""
    skip = shutil.ignore_patterns("llm", "__pycache__", "corpus_pipeline.py", ".git", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    out = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", "tests"], cwd=tmp_path / "repo", check=True, capture_output=True, text=True).stdout
    assert "test_network.py::test_braess_equilibrium" in out and "tests/llm" not in out
