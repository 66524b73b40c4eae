from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = Path(os.environ.get("TEST_DATA", "/root/testdata"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{base}")
        .config("spark.sql.warehouse.dir", f"{base}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    if value is None or str(value) in ("<NA>", "nan"):
        return None
    if isinstance(value, float):  # a whole number may come as either, if its column has nulls
        return int(value) if value.is_integer() else round(value, 6)
    return bytes(value) if isinstance(value, bytearray) else value


def rows_of(frame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(repr([plain(v) for v in row]) for row in frame.astype(object).values.tolist())


@pytest.fixture(scope="session")
def compare():
    """Spark rows and DuckDB rows of a query over the tables in a folder are the same."""

    def check(df, sql: str, folder) -> int:
        db = duckdb.connect()
        for t in TABLES:
            if Path(folder, f"{t}.parquet").exists():
                db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        ours, theirs = df.toPandas(), db.sql(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert rows_of(ours) == rows_of(theirs)
        return len(ours)

    return check


@pytest.fixture(scope="session")
def data():
    return DATA
