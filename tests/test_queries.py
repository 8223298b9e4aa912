"""Every query with SQL against DuckDB on the same tables, order aside."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SKIP = {"pipeline"} | {q for q in entry.queries() if q.startswith("op")}


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 5) + 0.0
    if isinstance(v, (bool, str, int)):
        return v
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def close(a, b):
    return a == b or isinstance(a, (int, float)) and isinstance(b, (int, float)) and abs(a - b) <= 2e-5 * max(1, abs(a))


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SKIP))
def test_query(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, cur.fetchall())
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want, strict=True) if not all(map(close, g, w))]
    assert not bad, bad[:3]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert os.path.exists(entry.__file__)
