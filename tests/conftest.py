import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"{base}/checkpoints", "spark.local.dir": str(base), "spark.sql.warehouse.dir": f"{base}/warehouse", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.default.parallelism": "4",
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else p / '*.parquet'}')")
    return con


def rows_of(frame):
    """The rows of a pandas frame with columns by name, ready to compare: no NaN, floats to 6 digits, sorted."""
    import pandas as pd

    def plain(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, list):
            return tuple(map(plain, x))
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        return round(float(x), 6) + 0.0 if isinstance(x, (int, float)) else x if isinstance(x, str) else str(x)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(plain(x) for x in r) for r in frame.itertuples(index=False)), key=repr)
