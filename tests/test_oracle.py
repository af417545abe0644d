"""Every registered query with an oracle matches DuckDB at sf0.001, and
the flagship entry runs."""
import duckdb
import pytest

from tools.oracle_check import TABLES, digest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_all_oracle_queries_match(spark, con):
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    bad = []
    for name, text in sql.items():
        df = qs[name](spark, SF)
        rows = [tuple(r) for r in df.collect()]
        res = con.execute(text)
        ocols = [d[0] for d in res.description]
        orows = res.fetchall()
        if sorted(df.columns) != sorted(ocols) or digest(df.columns, rows)[0] != digest(ocols, orows)[0]:
            bad.append(name)
    assert bad == []


def test_entry_flagship(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert len(df.columns) == 427
    assert df.count() == 1500
