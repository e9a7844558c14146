"""Each query with DuckDB text gives the rows of that text on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

from gaugeworks.jobs import queries as jobs  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(float(x), 5) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(jobs.ORACLE_SQL))
def test_rows(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(jobs.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    df = jobs.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    rows = lambda x: sorted((tuple(map(plain, r)) for r in x), key=repr)
    assert rows(tuple(r) for r in df.select(*columns).collect()) == rows(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(jobs.QUERIES) - set(jobs.ORACLE_SQL)))
def test_runs(spark, name):
    """Queries that SQL can't repeat run on the smallest tables, where pruning leaves no response at all."""
    df = jobs.QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0
