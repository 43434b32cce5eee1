"""One local Spark session, and a comparison with DuckDB over the driver's tables."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = Path(os.environ.get("LODESTONE_DATA", "/root/testdata"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def duck_rows(sql: str, sf_dir: str):
    """The oracle's rows as a frame."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        where = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{where}')")
    return con.execute(sql).df()


def canonical(frame) -> list[tuple]:
    """Rows with columns in name order and sorted, for a comparison that ignores order."""
    import pandas as pd

    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        x = x.item() if hasattr(x, "item") else x
        return int(x) if isinstance(x, float) and x.is_integer() else x

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, row)) for row in frame.itertuples(index=False)), key=repr)


@pytest.fixture
def same_as_duckdb(spark):
    """Assert that a query's rows equal its oracle's."""

    def check(query, sql: str, sf: str = "sf0.001"):
        sf_dir = f"{DATA}/{sf}"
        got, want = canonical(query(spark, sf_dir).toPandas()), canonical(duck_rows(sql, sf_dir))
        assert len(got) == len(want), (len(got), len(want))
        for g, w in zip(got, want):
            assert g == w
        return len(got)

    return check
