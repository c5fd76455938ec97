"""Every query against its SQL."""

import datetime
import math
import os

import duckdb
import pytest

from tremor.plans import archives, catalogue, displays, models, polylines, report, streams, tracks  # noqa: F401  (the others add their queries)

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    return v.isoformat() if isinstance(v, datetime.datetime) else str(float(v)) if type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, sql, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = sql.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [want.columns.index(c) for c in order]
    assert mine == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
