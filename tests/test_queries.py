"""Every registered query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from utterlake import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return "nan" if isinstance(v, float) and math.isnan(v) else v


def equal(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b or str(a) == str(b)


@pytest.mark.parametrize("name", sorted(plans.oracles()))
def test_query_equals_sql(spark, sf, con, name):
    df = plans.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    ran = con.execute(plans.oracles()[name])
    there = [x[0] for x in ran.description]
    assert sorted(there) == cols
    want = sorted((tuple(plain(r[there.index(c)]) for c in cols) for r in ran.fetchall()), key=repr)
    assert len(got) == len(want)
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if not all(equal(x, y) for x, y in zip(a, b, strict=True))]
    if wrong:  # floats may sort differently by their text
        key = lambda r: tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r)
        got, want = sorted(got, key=key), sorted(want, key=key)
        wrong = [(a, b) for a, b in zip(got, want, strict=True) if not all(equal(x, y) for x, y in zip(a, b, strict=True))]
    assert not wrong[:3]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
