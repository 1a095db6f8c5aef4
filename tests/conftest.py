"""One local session for all tests, and a comparison of rows."""

from __future__ import annotations

import os
import tempfile

import pytest

os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH")]))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[2]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from parley.shipping import ship

    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    """A value as both engines give it, for comparison."""
    import decimal

    if isinstance(value, decimal.Decimal):
        value = int(value) if value == int(value) else float(value)
    if isinstance(value, float):
        return round(value, 5)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return bytes(value) if isinstance(value, bytearray) else value


def same_rows(df, con, sql: str) -> None:
    """Asserts that a frame and a statement have the same columns and rows."""
    names = sorted(df.columns)
    got = con.execute(sql)
    theirs = [c[0] for c in got.description]
    assert sorted(theirs) == names
    order = [theirs.index(n) for n in names]
    a = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)
    assert a == b
