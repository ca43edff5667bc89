"""Every query against its SQL in DuckDB on the small tables."""

import os

import duckdb
import pytest

from tallywright import plans


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf_dir, oracle, name):
    got = plans.QUERIES[name](spark, sf_dir).toPandas()
    if name in plans.ORACLE:
        want = oracle.sql(plans.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    else:
        assert len(got)
