"""Every query's rows equal those of its SQL statement over the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from trendloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and getattr(x, "ndim", 0):
        return [plain(y) for y in x]
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(str([plain(r[k]) for k in order]) for r in data)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    found = got.collect()
    if sql := registry.ORACLES.get(name):
        want = db.execute(sql)
        columns = [c[0] for c in want.description]
        assert rows(got.columns, [tuple(r) for r in found]) == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(registry.QUERIES) <= set(entry.queries())
