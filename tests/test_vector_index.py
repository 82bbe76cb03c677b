"""The inverted-file index of vectors against comparing every query with every vector."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval as R
from corpusloom.operators import vector_index as VI

DATA = "/root/testdata/sf0.1"


def brute(rows, asked, k):
    """(query, key, rank) of the k best by numpy, scores rounded as the operators do."""
    norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    keys, x = np.array([r[0] for r in rows]), norm(np.array([r[1] for r in rows], np.float64))
    out = {}
    for q, v in asked:
        s = np.round(x @ norm(np.array([v], np.float64))[0], 6)
        for rank, i in enumerate(np.lexsort((keys, -s))[:k], 1):
            out[q, rank] = (int(keys[i]), pytest.approx(float(s[i]), abs=2e-6))
    return out


def found(df):
    return {(r[0], r["rank"]): (r[1], r.score) for r in df.collect()}


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors around 40 centres, one of which holds a third of all rows, many of them equal; a vector of zeros."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24))
    cell = np.where(rng.random(6000) < 0.33, 0, rng.integers(0, 40, 6000))
    x = centres[cell] + rng.normal(size=(6000, 24)) * 0.3
    x[cell == 0] = np.where(rng.random((int((cell == 0).sum()), 1)) < 0.5, centres[0], x[cell == 0])
    x[17] = 0
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, v array<float>").withColumns({c: F.lit(7) for c in ("cell", "n", "score", "vector", "codes")})
    return rows, df


def test_index_is_stored_and_loaded_and_exact(spark, clustered, tmp_path, monkeypatch):
    rows, df = clustered
    monkeypatch.setattr(VI, "BLOCK_ROWS", 512)
    monkeypatch.setattr(VI, "PACK", 20)
    index = VI.stored(df, "id", "v", str(tmp_path))
    assert index.cells.agg(F.sum("n")).first()[0] == len(rows)
    assert index.codes.groupBy("cell").count().agg(F.max("count")).first()[0] >= 3  # the hot cell is several blocks
    monkeypatch.setattr(VI, "build", None)
    index = VI.stored(df, "id", "v", str(tmp_path))  # loaded: nothing is built
    asked = df.filter("id % 100 = 0 OR id = 17").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    some = [(i, v) for i, v in rows if i % 100 == 0 or i == 17]
    want = brute(rows, some, 10)
    assert found(VI.search_exact(index, asked, "q", "qv", 10)) == want
    near = found(VI.search(index, asked, "q", "qv", 10))
    hit = len({(q, d) for (q, _), (d, _) in near.items()} & {(q, d) for (q, _), (d, _) in want.items()})
    assert hit >= 0.9 * len(want) and index.cells.first().probes <= 20 and index.cells.count() > 60  # clusters: few cells are enough
    few = VI.search_exact(index, asked, "q", "qv", 10, probes=1)
    assert found(few) == want


def test_recall_on_the_given_vectors(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    index = VI.stored(e, "vec_id", "embedding", str(tmp_path))
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    want = R.top_k(R.dense_scores(asked, e.select("vec_id", F.col("embedding").alias("cv")), "q", "vec_id"), "q", "vec_id", 10)
    want = {(r.q, r.vec_id): r.score for r in want.collect()}
    exact = {(r.q, r.vec_id): r.score for r in VI.search_exact(index, asked, "q", "qv", 10).collect()}
    assert exact == want
    near = {(r.q, r.vec_id): r.score for r in VI.search(index, asked, "q", "qv", 10).collect()}
    print("recall", len(near.keys() & want.keys()) / len(want), "cells", index.cells.count(), "probed", index.cells.first().probes)
    assert len(near.keys() & want.keys()) >= 0.9 * len(want)
    plan = VI.search(index, asked, "q", "qv", 10)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_odd_rows(spark, tmp_path):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 1.0]), (4, [1.0, 0.0]), (4, [0.0, 2.0])], "id long, v array<float>")
    index = VI.stored(few, "id", "v", str(tmp_path))
    asked = spark.createDataFrame([("a", [2.0, 0.0]), ("b", None), ("z", [0.0, 0.0])], "q string, qv array<float>")
    for got in (VI.search_exact(index, asked, "q", "qv", 3), VI.search(index, asked, "q", "qv", 3)):
        rows = [tuple(r) for r in got.orderBy("q", "rank").collect()]
        assert [r[:2] for r in rows if r[0] == "a"] == [("a", 1), ("a", 4), ("a", 2)] and {r[0] for r in rows} == {"a", "z"} and all(r[2] == 0 for r in rows if r[0] == "z")
    none = VI.stored(few.filter("false"), "id", "v", str(tmp_path))
    assert VI.search_exact(none, asked, "q", "qv", 3).count() == 0 and VI.search(none, asked, "q", "qv", 3).count() == 0
    assert VI.search(index, asked.filter("false"), "q", "qv", 3).count() == 0
