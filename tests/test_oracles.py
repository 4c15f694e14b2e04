"""Every query of the catalogue against its DuckDB form, over the small tables."""

import duckdb
import pytest

from tamarack import catalog, catalog_reports

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in catalog.ORACLES:
        return
    other = duck.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(other.columns)
    place = [other.columns.index(c) for c in columns]
    shown = lambda v: repr(float(v)) if isinstance(v, float) else repr(v)
    assert sorted([shown(r[c]) for c in columns] for r in rows) == sorted([shown(r[i]) for i in place] for r in other.fetchall())
