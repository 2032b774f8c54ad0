"""Every query against its SQL twin on the smallest tables."""

import math

import duckdb
import pytest

from stormshift.plans import queries
from stormshift.registry import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: None if isinstance(x, float) and math.isnan(x) else x + 0.0 if isinstance(x, float) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def catalogs():
    """The queries' catalogs, prepared once for this file: the tables don't change while it runs."""
    made, plain_ = {}, queries.catalog
    queries.catalog = lambda spark, sf_dir, shifted=False: made.get(shifted) or made.setdefault(shifted, plain_(spark, sf_dir, shifted))
    yield made
    queries.catalog = plain_


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query(spark, catalogs, name):
    con = duckdb.connect()
    for t in ("lineitem", "events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = QUERIES[name](spark, SF_DIR)
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    got = plain(df.collect(), df.columns)
    assert got and got == plain(want.fetchall(), columns)
