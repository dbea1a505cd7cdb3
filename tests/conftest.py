"""A local session, the tables, and the comparison of a query with its SQL."""

from __future__ import annotations

import math
import os
import sys
import tempfile
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    tmp = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tmp)
        .config("spark.checkpoint.dir", f"file://{tmp}/shared")
        .config("spark.sql.warehouse.dir", f"{tmp}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return TABLES


def plain(value):
    """A value that Spark and DuckDB agree on; floating point to nine digits."""
    if isinstance(value, (float, Decimal)):
        return "nan" if math.isnan(value) else float(f"{float(value):.9g}")
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="session")
def agrees(spark, sf):
    """Assert that a query and its SQL return the same columns and rows."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")

    def check(query, sql: str) -> None:
        df = query(spark, sf)
        names = sorted(df.columns)
        cursor = con.execute(sql)
        theirs = [d[0] for d in cursor.description]
        assert sorted(theirs) == names
        places = [theirs.index(n) for n in names]
        expected = sorted(repr(tuple(plain(r[i]) for i in places)) for r in cursor.fetchall())
        assert sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect()) == expected

    return check
