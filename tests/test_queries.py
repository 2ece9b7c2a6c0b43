"""Every registered query of the library against its SQL in DuckDB, over the whole smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from embedlens.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def value(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    return tuple(map(value, v)) if isinstance(v, (list, tuple)) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    r = db.execute(SQL[name])
    want = table([c[0] for c in r.description], r.fetchall())
    assert got == want
    assert want[1], "an oracle without rows shows nothing"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
