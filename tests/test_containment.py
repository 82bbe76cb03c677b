"""Patterns in texts by automata against looking for every pattern in every text."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import containment as C


@pytest.mark.parametrize("shard_chars", [C.SHARD_CHARS, 40])
def test_against_every_pair(spark, monkeypatch, shard_chars):
    monkeypatch.setattr(C, "SHARD_CHARS", shard_chars)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abকé😀 ") for _ in range(rng.randint(1, 5)))
    texts = [(i, "".join(word() for _ in range(rng.randint(0, 12)))) for i in range(120)] + [(500, None), (501, ""), (7, "abab"), (None, "ab" * 50_000)]
    patterns = [(i % 25, word()) for i in range(60)] + [(90, ""), (91, None), (92, "ab"), (93, "ab"), (None, "ba")]
    t = spark.createDataFrame(texts, "id long, text string").withColumns({c: F.lit(7) for c in ("_name", "name", "pattern")})
    p = spark.createDataFrame(patterns, "name long, pattern string")
    want = {(i, n) for i, x in texts for n, q in patterns if x is not None and q and q in x}
    got = C.contained(t, "id", "text", p, "name", "pattern")
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    least = sorted(((r.id, r.name) for r in C.contained(t, "id", "text", p, "name", "pattern", least=True).filter("id IS NOT NULL").collect()), key=str)
    best = {i: min((n for j, n in want if j == i and n is not None), default=None) for i, _ in texts}
    assert {r for r in least} == {(i, best[i]) for i, _ in texts if i is not None} and len(least) == len(texts) - 1


def test_nothing(spark):
    t, p = spark.createDataFrame([(1, "a")], "id long, text string"), spark.createDataFrame([(1, "a")], "name long, pattern string")
    assert C.contained(t.filter("false"), "id", "text", p, "name", "pattern").count() == 0
    assert C.contained(t, "id", "text", p.filter("false"), "name", "pattern").count() == 0
    assert [tuple(r) for r in C.contained(t, "id", "text", p.filter("false"), "name", "pattern", least=True).collect()] == [(1, None)]
    plan = C.contained(t, "id", "text", p, "name", "pattern")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
