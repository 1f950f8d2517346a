import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "6g",
        "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('checkpoints')}",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    def check(query, sql):
        got = query(spark, DATA)
        names = sorted(got.columns)
        rel = duck.sql(sql)
        assert sorted(rel.columns) == names
        want = duck.sql("select " + ", ".join(f'"{c}"' for c in names) + f" from ({sql})").fetchall()
        rows = [tuple(r) for r in got.select(*[f"`{c}`" for c in names]).collect()]
        assert sorted(map(repr, rows)) == sorted(map(repr, want))

    return check
