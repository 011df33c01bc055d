"""Each harness query against its DuckDB twin."""

import glob
import math
import os

import duckdb
import pytest

from planimeter.plans import assess, harness, layout, rooms  # noqa: F401 (the others register their queries with harness)

DATA = os.environ.get("PLANIMETER_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    def value(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 4) + 0.0
        return float(x) if type(x).__name__ == "Decimal" else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(harness.ORACLES))
def test_twin(spark, duck, name):
    got = harness.QUERIES[name](spark, DATA)
    want = duck.sql(harness.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got.collect(), got.columns), plain(want.fetchall(), want.columns)
    assert len(a) == len(b)
    assert a == b
    assert a or name in ("polygon_overlap",)


@pytest.mark.parametrize("name", sorted(set(harness.QUERIES) - set(harness.ORACLES)))
def test_runs(spark, name):
    harness.QUERIES[name](spark, DATA).collect()
