"""Every query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from quillspark.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "customer events documents embeddings labels conversations lineitem orders pages benchmark".split()


def canon(v):
    if v is None or v != v:
        return "-"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(canon, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query(spark, name):
    got = QUERIES[name](spark, DATA)
    rows = got.collect()
    if name not in SQL:
        assert rows
        return
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    r = c.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    want = sorted(canon([dict(zip(names, x))[k] for k in order]) for x in r.fetchall())
    assert sorted(canon([x[k] for k in order]) for x in rows) == want
