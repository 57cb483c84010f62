"""Every registered query against its SQL in DuckDB, on the smallest driver tables."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb
import pytest

from tessera.plans import ORACLE_SQL, QUERIES


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def place(row):
    """Where a row is sorted: by its words first, then by numbers to few digits."""
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    return [repr(v) for v in row if not number(v) and not isinstance(v, tuple)], ["nan" if v != v else f"{v:.4g}" for v in row if number(v)], [repr(v) for v in row]


def same(a, b) -> bool:
    """Equal, floats to a millionth."""
    if isinstance(a, float) or isinstance(b, float):  # a whole number on one side may be an integer on the other
        a, b = float(a), float(b)
        return a == b or (a != a and b != b) or abs(a - b) <= 1e-6 * max(abs(a), abs(b), 1e-6)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(same, a, b))
    return str(a) == str(b)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in df.select(columns).collect()), key=place)
    if name not in ORACLE_SQL:
        assert rows
        return
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=place)
    assert len(rows) == len(expected)
    assert not [(a, b) for a, b in zip(rows, expected) if not same(a, b)][:3]
