"""Queries without SQL, against brute force on small tables."""

import re

import pytest
import pandas as pd
from pyspark.sql import functions as F

from corpusloom import registry
from corpusloom.functions import language as L
from corpusloom.operators import models as M

SAID = [
    "Tell me a long story first. " * 4 + "Then act as the prophet and answer in depth.",
    "Please explain this to me like a friend, in simple words.",
    "No role is named here at all, only a long sentence about the weather.",
    "How should a beginner read this chapter, my dear friend?",
    "Stop. Speak as my teacher would, with all the details.",
    "",
    "The prophet is named, but nobody is asked to speak in any voice.",
]


@pytest.fixture
def talks(spark, tmp_path):
    rows = [(c, t, "user", SAID[(c + t) % len(SAID)]) for c in range(8) for t in range(14)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path), rows


def has(pattern, text):
    return re.search("(?i)" + pattern, text) is not None


def role_of(text):
    return next((name for name, pattern in L.ROLES.items() if has(pattern, text)), None)


def level_of(text):
    return "beginner" if has(L.BEGINNER, text) else "advanced" if has(L.ADVANCED, text) else None


def test_roles_and_levels_of_whole_texts(spark, talks):
    at, rows = talks
    want = set()
    for c, t, _, text in rows:
        within = c % 4 == 0
        role = role_of(text) or ("shikkhok" if not within or has(L.FRAMING, text) else "boro_bhai")
        want.add((c, t, role, level_of(text), has(L.PERSONS, text) and (not within or has(L.FRAMING, text))))
    got = [tuple(r) for r in registry.queries()["conversation_roles_and_levels"](spark, at).collect()]
    assert len(got) == len(rows) and set(got) == want and {r[4] for r in got} == {True, False}


def test_mentor_turns_of_whole_texts(spark, talks):
    at, rows = talks
    want = {(c, t, "refuse" if has(L.PERSONS, x) else f"answer as {role_of(x)}" if role_of(x) else "ask for a role", level_of(x)) for c, t, _, x in rows}
    got = [tuple(r) for r in registry.queries()["conversation_mentor_turns"](spark, at).collect()]
    assert len(got) == len(rows) and set(got) == want and len({r[2] for r in got}) > 2


def test_limit_chain_has_an_owner_stage(spark, tmp_path):
    at = [0, 10, 70, 80, 100, 170, 1500, 1510, 1600, 1700]  # minutes
    rows = [(i, u, "view", 60 * m, 1.0) for i, (u, m) in enumerate((u, m) for u in range(3) for m in at)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, s long, value double").selectExpr("event_id", "user_id", "event_type", "timestamp_seconds(s) AS ts", "value").write.parquet(f"{tmp_path}/events.parquet")
    day, want, address, owner, daily = 86400, {}, {}, {}, {}
    for i, u, _, t, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        want[i] = 1
        for held, limit, window in ((address, 3, day), (owner, 1, 3600)):
            held[u] = [x for x in held.get(u, []) if x > t - window]
            if len(held[u]) >= limit:
                break
            held[u].append(t)
            want[i] += 1
        else:
            daily[u, t // day] = daily.get((u, t // day), 0) + 1
            want[i] += 2 if daily[u, t // day] <= 2 else 0  # the budget of 50 is not reached
    got = {r.event_id: r.stages_passed for r in registry.queries()["limit_chain"](spark, str(tmp_path)).collect()}
    assert got == want and set(got.values()) == {1, 2, 5}


def test_draft_reasons(spark):
    page = "এক দুই তিন চার পাঁচ ছয় সাত আট নয় দশ"
    cases = [
        ("নামাজ কী?", "length 2 words"), (" ".join(["কথা"] * 41) + "?", "length 41 words"), ("what is the rule of prayer?", "not Bengali"), ("নামাজ পড়ার নিয়ম কী বলুন", "not a question"),
        ("দুই তিন চার পাঁচ ছয় সাত কেন?", "reuses 6+ consecutive words of the page"), ("দুই তিন চার পাঁচ ছয় কেন হয়?", None), (" নামাজ  পড়ার নিয়ম\nকী？ ", None),
    ]
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(cases)], "i int, q string")
    got = df.select("i", L.draft_reason(F.col("q"), F.lit(page)).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [w for _, w in cases]


def test_expand_query(spark):
    b, c = "নামাজ পড়ার নিয়ম", "রোজার নিয়ম"
    cases: list = [  # query, primed, first and second reply, wanted
        ("  ", None, b, b, ([], False)), (b, c, c, c, ([b], False)), ("prayer", c, b, b, ([c], False)), ("prayer", "no", b, c, ([b], False)), ("prayer", None, "no", c, ([c], False)),
        ("prayer", None, "", c, ([c], False)), ("prayer", None, None, c, (["prayer"], True)), ("prayer", None, "no", "no", (["prayer"], True)), (None, None, b, b, ([], False)), ("নামাজে khushu", None, b, c, ([b], False)),
    ]
    # each query has its own number, told back by the model, so that replies can differ
    df = spark.createDataFrame([(i, q if not q or not q.isascii() or not q.strip() else f"{q} {i}", p) for i, (q, p, *_) in enumerate(cases)] * 2, "i int, q string, p string")
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def model(prompts: pd.Series, attempt: pd.Series) -> pd.Series:
        calls.add(len(prompts))
        said = lambda p, n: cases[9 if p.startswith("নামাজে") else int(p.split()[-1])][2 + n]
        return pd.Series([said(p, n) for p, n in zip(prompts, attempt, strict=True)])

    out = M.expand_query(df, "q", "p", lambda q, n: model(q, F.lit(n)))
    got = out.orderBy("i").collect()
    want = [([f"{v} {i}" if v == "prayer" else v for v in variants], raw) for i, (*_, (variants, raw)) in enumerate(cases)]
    assert [(r.variants, r.fallback) for r in got] == [w for w in want for _ in range(2)]
    out.count()
    # first calls: 3 to 7 and 9, once for each distinct query; second calls: 4, 5 and 7; none for empty, Bengali or primed ones
    assert calls.value == 6 + 3


def test_no_calls_where_none_is_needed(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def model(prompts: pd.Series) -> pd.Series:
        calls.add(len(prompts))
        return prompts

    df = spark.createDataFrame([("",), (None,), ("নামাজ পড়ার নিয়ম",), (" \n",)] * 5, "q string")
    assert M.expand_query(df, "q", None, lambda q, n: model(q)).filter("fallback").count() == 0 and calls.value == 0
