from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tallyfold.session import local_session

    session = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    return con


def rows(frame) -> list[tuple]:
    """Rows with columns in order of name, numbers rounded, sorted."""
    import pandas as pd

    frame = frame[sorted(frame.columns)]

    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return None
        return round(float(x), 4) if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iufb" else str(x)

    return sorted((tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False, name=None)), key=repr)
