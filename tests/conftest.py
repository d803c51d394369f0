"""A session for all tests, and helpers to compare tables."""

from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    s = SparkSession.builder.master("local[4]").appName("tests").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    """A value that compares across engines."""
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return v.item() if hasattr(v, "item") else v


def rows_of(df) -> list[tuple]:
    """Rows of a pandas frame with columns and rows in one order; whole numbers and text decide before fractions."""
    names = sorted(df.columns)
    rows = [tuple(plain(v) for v in r) for r in df[names].itertuples(index=False)]
    return sorted(rows, key=lambda r: ([repr(v) for v in r if not isinstance(v, float) or v.is_integer()], [round(v, 2) for v in r if isinstance(v, float)]))


def same(a: list[tuple], b: list[tuple]) -> bool:
    """Whether two lists of rows agree up to the last digits of fractions."""
    close = lambda x, y: math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6) if isinstance(x, float) and isinstance(y, float) else x == y
    return len(a) == len(b) and all(close(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))
