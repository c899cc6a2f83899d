from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """Runs DuckDB SQL over the tables of a scale."""
    import duckdb

    def run(sql: str, sf: str = SF) -> list[tuple]:
        c = duckdb.connect()
        c.sql("SET TimeZone = 'UTC'")
        for p in Path(sf).glob("*.parquet"):
            c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        found = c.sql(sql)
        return sorted(found.columns), found.fetchall(), found.columns

    return run
