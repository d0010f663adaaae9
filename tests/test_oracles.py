"""Every query with an oracle gives DuckDB's rows; the others give rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lexmill import catalog

SLOW = {"glide_prune", "glide_rank"}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else int(value) if value == int(value) and abs(value) < 1e15 else round(value, 9)
    return value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(str(plain(r[i])) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, expected = rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
    assert got == expected, (list((got - expected).items())[:3], list((expected - got).items())[:3])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - SLOW))
def test_rows(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() >= 0


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "next_word_topk" in e.queries()
