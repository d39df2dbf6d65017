"""Every query against its SQL, at the smallest scale (check.py does the others)."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from anchorline.catalogue import ORACLES, QUERIES
from check import TABLES, canonical
from tests.support import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = Path(SF) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(ORACLES[name])
    want = canonical([d[0] for d in cursor.description], cursor.fetchall())
    assert got == want


def test_entry_is_the_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["period", "persons", "events", "person_years", "rate"] and df.count() == 2


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
