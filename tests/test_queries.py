"""Every registered query of the code-audit operators against its SQL, at the smallest scale."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from orewell.plans import registry

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, (decimal.Decimal, float)):
        return round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    return x


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    rows = sorted_rows(got.columns, got.collect())
    if name in registry.ORACLE_SQL:
        found = duck.execute(registry.ORACLE_SQL[name])
        want = sorted_rows([c[0] for c in found.description], found.fetchall())
        assert rows[0] == want[0]
        assert rows[1] == want[1]


def test_the_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == registry.QUERIES["scan_category_scores"](spark, SF).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
