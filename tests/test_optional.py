"""The rest works where the corpus operators have been deleted."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
names = set(e.queries())
assert names and set(e.oracle_sql()) <= names, names
assert not any(n == "pipeline" or n.startswith("op") for n in names), names
print(len(names))
"""


def test_without_the_corpus_operators(tmp_path):
    shutil.copytree(REPO, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    run = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "copy", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""}, timeout=120)
    assert run.returncode == 0, run.stderr
    os.makedirs(tmp_path / "copy/beamloom/llm/__pycache__")
    run = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "copy", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""}, timeout=120)
    assert run.returncode == 0, run.stderr
