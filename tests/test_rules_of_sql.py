"""Queries whose SQL names fewer rules than the library has, and shares of nothing, on tables made for it."""

import duckdb
import pytest
from compare import cell

from corpusloom import registry

SAID = ["a teacher of mine", "speak as my friend", "ñfriend friendé", "Prophet", "the prophet", "trump", "pretend to be an imam", "talk\x0blike you", "talk like you", "eli5", "DEEPER", "aſk my friend ſimple", "simple words, like a friend", "be my mentor", None, ""]


@pytest.fixture()
def tables(tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, 'user', ?)", [(c, t, x) for c in (3, 4) for t, x in enumerate([x for x in SAID for _ in range(7)])])
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (1::BIGINT, 'one fish two', 'en', 's', 12::BIGINT), (2, 'red fish', 'en', 's', 8)) t(doc_id, text, lang, source, n_chars)")
    con.execute("CREATE TABLE benchmark AS SELECT 7::BIGINT AS item_id, 'fish' AS text")
    for name in ("conversations", "documents", "benchmark"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    return con, str(tmp_path)


@pytest.mark.parametrize("name", ["mentor_turns", "roles_and_levels", "false_positive_rates"])
def test_it_gives_the_rows_of_its_sql(spark, tables, name):
    con, at = tables
    cur = con.execute(registry.oracles()[name])
    columns = [c[0] for c in cur.description]
    want = sorted(tuple(map(cell, r)) for r in cur.fetchall())
    assert sorted(tuple(cell(r[c]) for c in columns) for r in registry.queries()[name](spark, at).collect()) == want
