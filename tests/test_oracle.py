"""Every query with SQL against DuckDB on the smallest tables, and the others for rows and determinism."""

import math
from pathlib import Path

import duckdb
import pytest

from tessera.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(int(v)) if v == int(v) else repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows_as_duckdb(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(catalogue.ORACLE[name])
    names = [x[0] for x in cur.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(names) == cols
    assert got == want
    assert got


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_rows_without_sql(spark, name):
    assert not catalogue.QUERIES[name](spark, DATA).isEmpty()


def test_streaming_form_equals_batch(spark):
    a = {tuple(r)[:2]: r["score"] for r in catalogue.QUERIES["ownership_decay"](spark, DATA).collect()}
    b = {tuple(r)[:2]: r["score"] for r in catalogue.QUERIES["streaming_ownership"](spark, DATA).collect()}
    assert a.keys() == b.keys()
    assert max(abs(a[k] - b[k]) for k in a) < 1e-3
