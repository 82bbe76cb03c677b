"""Dumps that many tasks read: a block's header reaches its rows over any number of splits."""

import random
import re

import pytest

from corpusloom.sources import dumps as D


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def mysql_dump(rng, rows):
    """Lines of a dump, and the rows of `posts` by line number."""
    lines, want = ["-- dump", ""], {}
    for table in ("users", "posts", "users", "posts"):
        lines.append(f"INSERT INTO `{table}` (`id`, `said`) VALUES")
        for i in range(rows):
            said = rng.choice(["it''s", "a\\'b", "c\\\\", "d;e", "é\\n", "(1, ''x'');", "x" * rng.randint(0, 90)])
            lines.append(f"({i}, '{said}')" + (";" if i == rows - 1 else ","))
            if table == "posts":
                want[len(lines) - 1] = [str(i), D.unescaped(said)]
        lines += ["", "UNLOCK TABLES;", "(77, 'in no block'),"]
    return lines, want


@pytest.mark.parametrize("sent", [D.SENT_SPLITS, 0])
def test_mysql_blocks_over_splits(spark, small_splits, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(D, "SENT_SPLITS", sent)
    rng, want = random.Random(2), {}
    for name, rows in (("one", 150), ("two", 1), ("three", 40)):
        lines, own = mysql_dump(rng, rows)
        (tmp_path / f"{name}.sql").write_text("\n".join(lines) + "\n")
        want.update({(name, no): v for no, v in own.items()})
    lines = D.numbered_lines(spark, f"file://{tmp_path}")
    assert lines.select("file", "split").distinct().count() > 20 and lines.rdd.getNumPartitions() > 3
    rows = D.mysql_rows(lines, "posts").collect()
    assert {(re.search(r"(\w+)\.sql", r.file)[1], r.no): r.vals for r in rows} == want and len(rows) == len(want)
    assert all(r.columns == ["id", "said"] for r in rows)


def test_copy_blocks_over_splits(spark, small_splits, tmp_path):
    lines = ["SET x = 0;", "\\restrict abc"]
    for table, n in (("docs", 300), ("empty", 0), ("users", 50)):
        lines += [f"COPY public.{table} (id, body) FROM stdin;", *(f"{i}\tbody {i}" for i in range(n)), "\\."]
    (tmp_path / "d.sql").write_text("\n".join(lines) + "\n")
    read = D.without_noise(D.numbered_lines(spark, f"file://{tmp_path}"))
    assert {r.table: r.n for r in D.copy_counts(read).collect()} == {"docs": 300, "users": 50}
    assert sorted(int(r.row["id"]) for r in D.copy_rows(read, "docs").collect()) == list(range(300))


def test_dumps_without_lines_or_blocks(spark, tmp_path):
    (tmp_path / "a.sql").write_text("")
    (tmp_path / "b.sql").write_text("(1, 'no header'),\n")
    assert D.mysql_rows(D.numbered_lines(spark, f"file://{tmp_path}"), "posts").count() == 0


@pytest.mark.parametrize(("said", "means"), [("it''s", "it's"), ("a\\'b", "a'b"), ("c\\\\", "c\\"), ("\\\\'' \\0\\%\\_\\q", "\\' \0\\%\\_q"), ("''''", "''"), ("\\n''\\\\n", "\n'\\n"), ("", "")])
def test_escapes(said, means):
    assert D.unescaped(said) == means
