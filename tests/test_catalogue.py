"""Every registered query of the store against its SQL in DuckDB."""

from functools import partial

import duckdb
import pandas as pd
import pytest

from kvlake.plans import catalogue

D = "/root/testdata/sf0.001"


def rows(df):
    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return None
        return int(x) if isinstance(x, float) and x == int(x) else x.item() if hasattr(x, "item") else x

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_agrees_with_its_sql(spark, duck, name):
    assert rows(catalogue.QUERIES[name](spark, D).toPandas()) == rows(duck.sql(catalogue.SQL[name]).df())


#: Queries of a store whose batches, at larger tables, reach the size at which it flushes itself.
FLUSH_THEMSELVES = ["store_crash_recovery", "ttl_cleanup", "store_snapshot_scan", "ttl_after_flush_and_compaction", "entries_with_tombstones", "iterator_ordered", "store_round_trip"]


@pytest.mark.parametrize("name", FLUSH_THEMSELVES)
def test_query_agrees_with_its_sql_if_its_batches_flush_themselves(spark, monkeypatch, name):
    """Every batch is over the size of a memory table; no flush may judge by the wall clock what is read as of an earlier time."""
    monkeypatch.setattr(catalogue, "StoreConfig", partial(catalogue.StoreConfig, mem_table_max_size_bytes=4096))
    d = D.replace("0.001", "0.01")  # the smallest table at which each of them has a row that is live as of that time
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
    assert rows(catalogue.QUERIES[name](spark, d).toPandas()) == rows(c.sql(catalogue.SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
