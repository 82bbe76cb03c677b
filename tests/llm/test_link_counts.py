"""Numbers of links against every pair of sets."""

import random

import numpy as np
import pytest

from corpusloom.llm import link_counts as C


def words_of(text):
    return (text or "").lower().split()


def brute(rows):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    every = {s for i, s in sets.items() if s and i is not None}
    linked = {s: {o for o in every if o != s and 100 * len(s & o) >= 75 * len(s | o)} for s in every}
    component = {}
    for i, s in sorted((i, s) for i, s in sets.items() if i is not None):
        if i in component:
            continue
        component[i] = i
        seen, todo = {s}, [s] if s else []
        while todo:
            for o in linked[todo.pop()] - seen:
                seen.add(o)
                todo.append(o)
        for j, o in sets.items():
            if s and o in seen and j is not None:
                component.setdefault(j, i)
    copies = lambda s: sum(o == s for i, o in sets.items() if i is not None)
    return {(i, len(sets[i]), component.get(i), copies(sets[i]) if sets[i] and i is not None else 0, len(linked[sets[i]]) if sets[i] and i is not None else 0) for i, _ in rows}


@pytest.mark.parametrize("block", [3, 256])
def test_counts_are_those_of_every_pair(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "COLUMNS", 50)
    rng = random.Random(11)
    rows = []
    for family, size in enumerate([14, 5, 3, 1]):
        base = [f"w{family}x{k}" for k in range(rng.choice([40, 60]))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = rng.choice("abc")
            own += [f"t{k}" for k in range(rng.choice([0, 0, 8, 14]))]
            rows.append(" ".join(own))
    rows += rows[:6] + [rows[0]] * 8 + ["", None, " \n", "too short", "TOO short", "x " * 300, "x " * 400]
    rng.shuffle(rows)
    docs = [(i, t) for i, t in enumerate(rows)] + [(None, rows[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n_links", "2 AS class").repartition(3)
    got = [tuple(r) for r in C.count_links(df).collect()]
    assert len(got) == len(docs) and set(got) == brute(docs) and max(r[4] for r in got) > 4


def test_overlaps_in_parts(monkeypatch):
    monkeypatch.setattr(C, "COLUMNS", 7)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(9)]
    got = C.overlaps(sets[:4], sets[4:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]
    assert C.overlaps([np.array([1], np.uint64)], [np.array([2], np.uint64)]).tolist() == [[0]]


def test_no_rows_and_no_links(spark):
    assert C.count_links(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = C.count_links(spark.createDataFrame([(1, None), (None, "a b"), (2, "a b")], "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == {(1, 0, 1, 0, 0), (None, 1, None, 0, 0), (2, 1, 2, 1, 0)}
