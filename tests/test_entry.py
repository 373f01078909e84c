"""The driver contract: names, the flagship query, and the package without its training-data part."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_its_query():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(f) for f in queries.values())


def test_entry_has_one_row_a_size(spark):
    if not os.path.isdir(__spark_entry__.FLAGSHIP_DIR):
        return
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 3 and all(r.pairs == r.n * (r.n - 1) // 2 for r in rows)


def test_imports_without_the_training_data_part(tmp_path):
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "tests")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(x.startswith('op1_') or x == 'pipeline' for x in q), set(e.oracle_sql()) <= set(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True)
    n, has, covered = out.stdout.split()
    assert int(n) > 40 and has == "False" and covered == "True", out.stderr
