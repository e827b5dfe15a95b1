import math

import duckdb
import pytest

import __spark_entry__ as entry
from korral import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple("nan" if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_against_oracle(spark, sf, con, name):
    df = plans.QUERIES[name](spark, sf)
    want = con.sql(plans.ORACLES[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 7
    assert set(entry.oracle_sql()) <= set(entry.queries())
