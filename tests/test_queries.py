"""Every registered query against its SQL twin, run by DuckDB on the same files."""

import os

import duckdb
import pytest

from maskwright.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def value(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted("|".join(value(r[c]) for c in columns) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert got == sorted("|".join(value(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall())


def test_flagship(spark, sf_dir):
    rows = registry.flagship(spark, sf_dir).collect()
    assert rows and sum(r.n_changed for r in rows) > 0
