"""Every registered query: against its SQL where it has one, else that it returns rows."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest

from .oracle import compare, connect

SQL = entry.oracle_sql()

@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


# the queries of the training-data operators are tested with them
OWN = [n for n in entry.queries() if n in entry.catalog.QUERIES]


# 135 fits take minutes; tests/test_order.py runs the same search on a small grid
LONG = {"r12_text_baseline"}


@pytest.mark.parametrize("name", [n for n in OWN if n in SQL and n not in LONG])
def test_same_as_sql(name, spark, sf_dir, con):
    assert compare(entry.queries()[name](spark, sf_dir), con, SQL[name]) == []


def test_every_query_has_sql():
    assert [n for n in OWN if n not in SQL] == []


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark, sf_dir):
    assert entry.entry(spark).columns == ["author", "influence", "hate_ratio", "comments", "communities"]
