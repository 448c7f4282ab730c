import os
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false")
               .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in Path(SF).iterdir():
        con.sql(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    """Rows in order, with columns by name and numbers of one kind."""
    def value(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return ""
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, bool):
            return str(x)
        return f"{float(x):.6f}" if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else str(x)
    return sorted(tuple(value(x) for x in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="session")
def same_rows():
    def check(spark_rows, sql_rows):
        a, b = spark_rows.toPandas(), sql_rows.df()
        assert sorted(a.columns) == sorted(b.columns)
        assert plain(a) == plain(b)
    return check
