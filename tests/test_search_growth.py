"""The searches that FINDINGS_r03 names, on a table three times as long: what they write is lists of the found, a few rows a
question, and no vector is paired with every query by a join."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom import registry
from corpusloom.operators import graphs, lexical_index, vector_index

SMALL = "/root/testdata/sf0.001"
LEXICAL = ["overlap_report", "batch_answers", "ablation_delta", "gate_first_citation", "mean_metrics", "rerank_topn", "per_source_cap", "breakdown_grouping_sets", "retrieval_trace"]
DENSE = ["dense_min_similarity", "dense_topk", "first_hit_per_page"]


@pytest.fixture(scope="module")
def longer(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("longer")
    for name, key in (("documents", "doc_id"), ("embeddings", "vec_id")):
        rows = spark.read.parquet(f"{SMALL}/{name}.parquet")
        step = rows.agg(F.max(key)).first()[0] + 1
        times = spark.range(3).select((F.col("id") * step).alias("_by"))
        rows.crossJoin(times).withColumn(key, F.col(key) + F.col("_by")).drop("_by").write.parquet(f"{at}/{name}.parquet")
    os.symlink(f"{SMALL}/benchmark.parquet", f"{at}/benchmark.parquet")
    return str(at)


@pytest.mark.parametrize("name", LEXICAL + DENSE)
def test_what_is_written_does_not_grow_with_the_corpus(spark, monkeypatch, tmp_path, longer, name):
    for module in (graphs, lexical_index, vector_index):
        monkeypatch.setattr(module, "shared_dir", lambda _: f"file://{tmp_path}", raising=False)
    from corpusloom.plans import retrieval

    monkeypatch.setattr(retrieval, "shared_dir", lambda _: f"file://{tmp_path}")
    found = registry.queries()[name](spark, longer)
    assert found.count() > 0
    written = sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(tmp_path) for f in files)
    assert written < 100_000, written  # the documents are three times 290 kB
    if name in DENSE:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
