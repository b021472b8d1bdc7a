"""Every registered query that has SQL against DuckDB on the smallest tables; the others must run."""

import datetime
import decimal
import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tidemill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.date().isoformat() if v.time() == datetime.time() else v.isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


def ordered(rows):
    return sorted((tuple(plain(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered(df.select(*columns).collect())
    if name not in registry.oracle_sql():
        assert got or name in ("deal_matches", "refit_curve")
        return
    rel = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == ordered([r[i] for i in at] for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
