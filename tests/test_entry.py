"""The entry point with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": folder})
    queries, oracles = run.stdout.strip().split("\n")
    return set(queries.split()), set(oracles.split())


def test_queries_without_the_training_data_operators(tmp_path):
    folder = str(tmp_path / "repo")
    shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    queries, oracles = names(folder)
    assert len(queries) > 100 and oracles <= queries
    assert not any(n.startswith("op") and n[2].isdigit() for n in queries) and "pipeline" not in queries


def test_oracles_belong_to_queries():
    queries, oracles = names(ROOT)
    assert oracles <= queries
