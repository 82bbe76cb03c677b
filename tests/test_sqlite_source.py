"""SQLite files read by ranges of row numbers and written by tasks."""

import sqlite3
from pathlib import Path

import pytest

from corpusloom.sources.sqlite import SqliteFiles


@pytest.fixture
def source(spark):
    spark.dataSource.register(SqliteFiles)
    return spark


def test_ranges_types_and_odd_cells(source, tmp_path):
    path = str(tmp_path / "a b.sqlite")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "the table" (id INTEGER PRIMARY KEY, "na""me" TEXT, x REAL, extra)')
        db.executemany('INSERT INTO "the table" VALUES (?, ?, ?, ?)', [(i * 3 + 1, f"n{i}", i / 2, b"\xff") for i in range(1000)] + [(9001, None, "no number", None), (9002, 7, None, "é"), (9003, b"bytes", 2, 1)])
    read = source.read.format("sqlite_files").schema('id long, `na"me` string, x double').option("table", "the table")
    df = read.option("rows_per_task", 100).load(path)
    assert df.rdd.getNumPartitions() > 25
    got = {r.id: (r[1], r.x) for r in df.collect()}
    assert got == {i * 3 + 1: (f"n{i}", i / 2) for i in range(1000)} | {9001: (None, None), 9002: ("7", None), 9003: ("bytes", 2.0)}
    assert sorted(r.id for r in read.option("key", "id").option("after", "9000").load(path).collect()) == [9001, 9002, 9003]
    assert read.option("key", "id").option("after", "99999").load(path).count() == 0


def test_written_and_read_again(source, tmp_path):
    at = str(tmp_path / "out")
    df = source.range(1000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN concat('n', id) END AS name").repartition(3)
    df.write.format("sqlite_files").option("table", "t").mode("append").save(at)
    read = lambda: sorted(map(tuple, source.read.format("sqlite_files").schema("id long, name string").option("table", "t").load(at).collect()))
    assert read() == sorted(map(tuple, df.collect())) and len([f for f in Path(at).iterdir() if f.suffix == ".sqlite"]) == 3
    df.limit(10).write.format("sqlite_files").option("table", "t").mode("overwrite").save(at)
    assert len(read()) == 10
    source.createDataFrame([], "id long, name string").write.format("sqlite_files").option("table", "t").mode("append").save(at)
    assert len(read()) == 10


def test_only_shared_file_systems(source):
    with pytest.raises(Exception, match="SQLite reads no hdfs files"):
        source.read.format("sqlite_files").schema("id long").option("table", "t").load("hdfs://x/y.sqlite").count()
