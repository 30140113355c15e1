"""Every registered query against its SQL on the smallest tables; those without SQL must give a stable schema."""

from collections import Counter

import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

CORE = {k: f for m in entry.MODULES if not m.__name__.endswith("llm.queries") for k, f in m.QUERIES.items()}
SQL = {k: s for m in entry.MODULES for k, s in m.SQL.items()}


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 7)
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return v


def rows(table):
    names = sorted(table.column_names)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    got = CORE[name](spark, DATA).toArrow()
    if name in SQL:
        want = duck.sql(SQL[name]).arrow()
        want = want.read_all() if hasattr(want, "read_all") else want
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
