import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(shared / "warehouse")).config("spark.checkpoint.dir", f"file://{shared}/work").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """Rows of a DuckDB query over the tables of one scale."""
    import duckdb

    def run(sql: str, sf: str = "sf0.001"):
        con = duckdb.connect()
        for table in TABLES:
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{sf}/{table}.parquet'")
        rows = con.sql(sql)
        return sorted(rows.columns), rows.arrow().read_all().to_pylist() if hasattr(rows.arrow(), "read_all") else rows.arrow().to_pylist()

    return run


def plain(rows: list[dict], columns: list[str]) -> list[str]:
    def one(v):
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted(repr(tuple(one(r[c]) for c in columns)) for r in rows)
