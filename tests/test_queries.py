"""Every query with SQL against DuckDB, and the entry point."""

import duckdb
import pytest
from biblion.plans import queries, source_queries  # noqa: F401  registered on import
from biblion.plans import registry as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, con, name):
    ours = plans.QUERIES[name](spark, SF).toPandas()
    assert len(ours)
    if name not in plans.SQL:
        return
    theirs = con.sql(plans.SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (ours, theirs))
    assert a.equals(b)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
