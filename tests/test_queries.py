"""Every query against its SQL, over whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tools.check import connect, rows_of, same

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        want = rows_of(columns, result.fetchall())
        assert len(got) == len(want)
        assert [(a, b) for a, b in zip(got, want, strict=True) if not same(a, b)] == []


def test_comparison_sees_a_millionth():
    assert same((1, 0.5, "x"), (1, 0.5 + 1e-9, "x"))
    assert not same((1, 0.5, "x"), (1, 0.5 + 1e-6, "x")) and not same((1,), (2,)) and not same((True,), (1,))


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"doc_id", "stratum", "quality"}
