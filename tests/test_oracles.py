"""Every query of the reference's operators against its SQL."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from corpusloom.plans.oracles import ORACLES
from corpusloom.plans.queries import QUERIES

WITHOUT_SQL: set[str] = set()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLES[name])


def test_every_query_has_sql_but_those_that_cannot():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_without_the_optional_subpackage(tmp_path):
    """The registry of a copy that lacks the training-data folders, with and without the pipeline's file, has the other queries and runs one."""
    root = Path(__file__).resolve().parents[1]
    copy = tmp_path / "copy"
    shutil.copytree(root / "corpusloom", copy / "corpusloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, copy)
    code = """
import __spark_entry__ as entry
from pyspark.sql import SparkSession
assert not any(n.startswith("op") or n == "pipeline" for n in (*entry.queries(), *entry.oracle_sql()))
assert entry.entry.__module__ == "__spark_entry__" and len(entry.queries()) == len(entry.QUERIES)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert entry.queries()["inventory_totals"](spark, "/root/testdata/sf0.001").count() == 1
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for _ in range(2):
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
