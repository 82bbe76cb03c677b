"""Calls by task, counted; migrations that are run again."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import migrations as G
from corpusloom.operators import routing as R
from corpusloom.operators.remote import Patience, Refused, Remote

ROUTES = R.Routes("big", {"big": "max_tokens", "small": "cap"}, {"title": "small", "odd": "unknown"}, {"title": 7, "answer": 0})


def test_requests_hold_no_more_than_they_may():
    import random

    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randrange(12) for _ in range(rng.randrange(30))]
        cuts = list(R.requests_of(sizes, 4, 10))
        assert [i for s in cuts for i in range(s.start, s.stop)] == list(range(len(sizes)))
        for s in cuts:
            part = sizes[s]
            assert 0 < len(part) <= 4 and (sum(part) <= 10 or len(part) == 1)


def test_calls_are_routed_capped_and_made_once(spark):
    calls, requests, tries = (spark.sparkContext.accumulator(0) for _ in range(3))

    def connect():
        seen = []

        def send(payload, timeout):
            model, parameters, prompts = payload
            tries.add(1)
            seen.append(1)
            if len(seen) == 2:
                raise Refused(503)
            requests.add(1)
            calls.add(len(prompts))
            return [f"{model} {json.dumps(parameters)} {p}" for p in prompts]

        return Remote(send, Patience(pause=0.0))

    rows = [
        (1, "title", "a", None, None), (2, "answer", "a", None, None), (3, "title", "a", 3, None), (4, "title", "a", 3, {"cap": 9, "heat": 0}), (5, "nobody", "", None, {"heat": 1}), (6, None, "b", 4, None),
        (7, "odd", "b", 4, None), (8, "title", None, None, None), (9, "title", "a", None, None),
    ] * 3
    df = spark.createDataFrame(rows, "i int, task string, text string, budget int, own map<string,long>").repartition(3)
    out = R.answered(df, "text", ROUTES, "task", connect, "budget", "own", most=2, tokens=100, at_once=1)
    got = {r.i: r.reply for r in out.collect()}
    assert out.count() == 27 and got == {
        1: 'small {"cap": 7} a', 2: "big {} a", 3: 'small {"cap": 3} a', 4: 'small {"cap": 9, "heat": 0} a', 5: 'big {"heat": 1} ', 6: 'big {"max_tokens": 4} b', 7: 'unknown {"max_tokens": 4} b', 8: None, 9: 'small {"cap": 7} a',
    }
    assert calls.value == 7 and requests.value == 7 and tries.value >= requests.value
    with pytest.raises(ValueError, match="model"):
        R.answered(df.withColumn("model", F.lit(1)), "text", ROUTES, "task", connect)


def test_no_calls_at_all(spark):
    df = spark.createDataFrame([], "task string, text string")
    assert R.answered(df, "text", ROUTES, "task", lambda: 1 / 0).count() == 0


def test_migrations_run_again(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "b", "x"), (4, "c", None), (4, "c", None)], "id long, k string, v string")
    steps = [G.AddColumn("flag", "boolean", False), G.AddColumn("V", "string", "new"), G.UniqueKey(("k", "v")), G.UniqueKey(("id",))]
    table, ledger = G.migrated(df, None, steps)
    said = lambda x: {r.step: (r.outcome, r.duplicates) for r in x.collect()}
    assert said(ledger) == {"add flag": ("applied", 0), "add V": ("present", 0), "unique k, v": ("skipped", 1), "unique id": ("skipped", 1)}
    assert table.columns == ["id", "k", "v", "flag"] and {r.flag for r in table.collect()} == {False}
    set_flags = table.withColumn("flag", F.lit(True)).dropDuplicates(["id"])  # mended, and worked on
    again, ledger = G.migrated(set_flags, ledger, [*steps, G.AddColumn("late", "int", 3)])
    assert {r.flag for r in again.collect()} == {True} and again.columns[-1] == "late"
    assert said(ledger) == {"add flag": ("applied", 0), "add V": ("present", 0), "unique k, v": ("skipped", 1), "unique id": ("applied", 0), "add late": ("applied", 0)}
    empty, ledger = G.migrated(df.limit(0), None, steps)
    assert empty.count() == 0 and said(ledger)["unique id"] == ("applied", 0)
