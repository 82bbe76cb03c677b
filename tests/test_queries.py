"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from compare import cell

from corpusloom import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    sql = registry.oracles().get(name)
    if sql is None:
        assert got
        return
    cursor = con.execute(sql)
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == columns
    want = sorted(tuple(cell(r[theirs.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(registry.oracles()) <= set(registry.queries())
