"""Operators on fixtures small enough to work out by hand."""

from pyspark.sql import functions as F

from corpusloom.operators import cleaning as C
from corpusloom.operators import evaluation as E
from corpusloom.operators import ingest as I
from corpusloom.operators import retrieval as R


def test_fusion(spark):
    lists = [("q", i, r, k) for i, keys in enumerate((["a", "b"], ["b", "c"], ["b"])) for r, k in enumerate(keys, 1)]
    df = spark.createDataFrame(lists, "query string, list_no int, rank int, key string")
    assert [r.key for r in R.fused(df, "query", "key").orderBy("rank").collect()] == ["b", "a", "c"]


def test_cap(spark):
    rows = [("q", r, p, s) for r, (p, s) in enumerate([("p1", 0.9), ("p1", 0.8), ("p1", 0.7), ("p2", 0.6), ("p3", 0.5)], 1)]
    df = spark.createDataFrame(rows, "query string, rank int, page string, score double")
    assert [r.score for r in R.capped(df, "query", "page", 2, 4).orderBy("rank").collect()] == [0.9, 0.8, 0.6, 0.5]
    assert R.capped(df, "query", "page", 0, 4).count() == 4


def test_gates(spark):
    df = spark.createDataFrame([("q", 1, 0.4), ("q", 2, 0.9), ("q", 3, None)], "query string, rank int, rerank_score double")
    assert [r.rank for r in R.gate_each(df, 0.5).collect()] == [2]
    assert R.gate_first(df, "query", 0.5).count() == 0


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "x", 1), ("q", "g", 2)], "query string, key string, rank int")
    gold = spark.createDataFrame([("q", "g"), ("q", "h"), ("q", "g"), ("r", "z")], "query string, key string")
    got = {(r.query, r.k): r for r in E.metrics_at(ranked, gold, "query", "key", [1, 5]).collect()}
    assert (got["q", 5].hit, got["q", 5].recall, got["q", 5].mrr, got["q", 5].precision) == (1.0, 0.5, 0.5, 0.5)
    assert (got["q", 1].hit, got["r", 5].recall) == (0.0, 0.0)


def test_canonical(spark):
    rows = [(1, "h", False, "x"), (2, "h", False, "main"), (3, "h", True, "main"), (4, "k", False, "x"), (5, "k", False, "x"), (6, "solo", False, "x")]
    df = spark.createDataFrame(rows, "id long, digest string, excluded boolean, source string")
    got = {r.digest: r for r in C.canonical_rows(df, "id", "digest", "excluded", F.col("source") == "main").collect()}
    assert (got["h"].canonical, got["h"].ambiguous) == (2, False)
    assert (got["k"].canonical, got["k"].blocked) == (4, True) and "solo" not in got
    named = spark.createDataFrame([("k", 5), ("h", 99)], "digest string, canonical_id long")
    got = {r.digest: r for r in C.canonical_rows(df, "id", "digest", "excluded", F.col("source") == "main", named).collect()}
    assert (got["k"].canonical, got["k"].blocked, got["h"].canonical, got["h"].overridden) == (5, False, 2, False)


def test_upsert_twice_changes_nothing(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    old = spark.createDataFrame([(1, "a", "published"), (2, "b", "draft")], "id int, t string, status string").withColumn("updated_at", F.lit("2020-01-01").cast("timestamp"))
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, None)], "id int, t string")
    first = I.upserted(old, new, ["id"], ["t"], now, False)
    assert {r.id: r.action for r in first.collect()} == {1: "unchanged", 2: "updated", 3: "inserted"}
    again = I.upserted(first.drop("action"), new, ["id"], ["t"], now, False)
    assert {r.action for r in again.collect()} == {"unchanged"}


def test_near_duplicates_match_all_pairs(spark):
    sets = [(i, "x", [f"w{(i * 7 + j) % 23}" for j in range(8 + i % 3)]) for i in range(40)]
    df = spark.createDataFrame(sets, "id int, cls string, w array<string>")
    got = {(r.a, r.b) for r in C.near_duplicate_pairs(df, "id", "w", "cls", 0.5).collect()}
    s = {i: set(w) for i, _, w in sets}
    assert got == {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.5}


def test_canonical_rows_with_nulls(spark):
    rows = [(1, "a", None, "main"), (2, "a", False, "other"), (3, "a", False, "other"), (4, "b", None, "main"), (5, "b", None, "main"), (6, "c", False, "main")]
    df = spark.createDataFrame(rows, "id long, digest string, excluded boolean, source string")
    got = {r.digest: (r.n, r.canonical, r.ambiguous, r.blocked) for r in C.canonical_rows(df, "id", "digest", "excluded", F.col("source") == "main").collect()}
    assert got == {"a": (3, 2, True, True), "b": (2, None, False, False)}
    named = spark.createDataFrame([("a", 1), ("b", 6)], "digest string, canonical_id long")
    got = {r.digest: (r.canonical, r.overridden, r.blocked) for r in C.canonical_rows(df, "id", "digest", "excluded", F.col("source") == "main", named).collect()}
    assert got == {"a": (1, True, False), "b": (None, False, False)}
