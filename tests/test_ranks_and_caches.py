"""Distributed places, order statistics and caches against plain versions."""

import math
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import caches, ranks
from corpusloom.operators.cleaning import interleaved


def test_places(spark):
    rng = random.Random(1)
    values = [rng.randrange(10**6) for _ in range(5000)] + [None]
    df = spark.createDataFrame([(v, "x") for v in values], "v long, place string").drop("place").repartition(9)
    got = {(r.v, r.place) for r in ranks.placed(df, ["v"]).collect()}
    assert sorted(p for _, p in got) == list(range(len(values)))
    assert [v for v, _ in sorted(got, key=lambda x: x[1])] == sorted(values, key=lambda v: (v is not None, v))
    assert ranks.placed(df.filter("false"), ["v"]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_order_statistics(spark, seed):
    rng = random.Random(seed)
    groups = {"hot": [rng.choice([0.0, 1.0, 2.5]) for _ in range(3000)], "own": [rng.gauss(0, 1) for _ in range(1001)], "one": [7.0], "none": [float("nan"), None], None: [1.0, 2.0, float("inf"), -math.inf]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    for name, at in (("least", lambda n: 0), ("upper median", lambda n: n // 2), ("last", lambda n: n - 1)):
        index = {"least": F.lit(0), "upper median": F.floor(F.col("n") / 2), "last": F.col("n") - 1}[name]
        want = {g: sorted(x for x in vs if x is not None and not math.isnan(x)) for g, vs in groups.items()}
        assert {r.g: r.v for r in ranks.selected(df, "g", "v", index).collect()} == {g: vs[at(len(vs))] for g, vs in want.items() if vs}


def test_interleaving(spark):
    rows = [(i, "a" if i % 3 else None, i % 2) for i in range(300)] + [(1000 + i, "hot", 1) for i in range(400)]
    got = interleaved(spark.createDataFrame(rows, "id long, g string, h long"), ["g", "h"], "id").collect()
    by: dict = {}
    for i, g, h in rows:
        by.setdefault((g, h), []).append(i)
    turn = {i: n for ids in by.values() for n, i in enumerate(sorted(ids), 1)}
    first = {i: min(ids) for ids in by.values() for i in ids}
    order = sorted(turn, key=lambda i: (turn[i], first[i], i))
    assert {r.id: (r.turn, r.place) for r in got} == {i: (turn[i], p) for p, i in enumerate(order, 1)}


def plain_lru(keys, capacity):
    held, out = OrderedDict(), []
    for k in keys:
        hit = k is not None and k in held
        out.append(hit)
        if k is not None:
            held[k] = held.pop(k, None)
            if len(held) > capacity:
                del held[next(iter(held))]
    return out


@pytest.mark.parametrize(("capacity", "stretch", "span"), [(5, 7, 2), (20, 50, 3), (512, 100_000, 256), (1, 1000, 2), (30, 10, 4)])
def test_lru(spark, capacity, stretch, span):
    rng = random.Random(capacity)
    keys = [None if rng.random() < 0.02 else f"k{int(rng.expovariate(0.08))}" for _ in range(600)] + ["same"] * 100
    df = spark.createDataFrame([(i, k, 1) for i, k in enumerate(keys)], "i long, k string, no long").repartition(5)
    got = {r.i: r.hit for r in caches.least_recently_used(df, ["i"], "k", capacity, stretch, span).collect()}
    assert [got[i] for i in range(len(keys))] == plain_lru(keys, capacity)


def test_lru_of_no_requests(spark):
    assert caches.least_recently_used(spark.createDataFrame([], "i long, k string"), ["i"], "k").count() == 0
