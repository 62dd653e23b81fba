"""Every registered query of the library against its SQL on DuckDB, at the smallest scale."""

import duckdb
import pytest

from tripline.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def value(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    found = duck.execute(registry.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    expected = sorted(tuple(value(r[names.index(c)]) for c in order) for r in found.fetchall())
    assert sorted(tuple(value(r[c]) for c in order) for r in got.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
