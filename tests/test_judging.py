"""Judging, key caps, serial numbers and the patient client, on small cases."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import judging as J
from corpusloom.operators import remote as R


def test_judge_sees_labels_only_and_invents_nothing(spark):
    c = spark.createDataFrame([(k, m, f"{m} " * n) for k in range(40) for m, n in (("one", 1), ("two", 2), ("three", 3))], "k int, model string, answer string")
    asked = {}

    def judge(key, rows):
        asked["type"] = True
        return F.map_from_entries(F.concat(F.transform(F.slice(rows, 1, 2), lambda x: F.struct(x["label"].alias("l"), F.length(x["answer"]).cast("long").alias("s"))), F.array(F.struct(F.lit("Z").alias("l"), F.lit(99).cast("long").alias("s")))))

    got = J.judged(c, "k", "model", "answer", judge, seed=1).collect()
    assert len(got) == 120 and {r.label for r in got} == {"A", "B", "C"} and all((r.score is None) == (r.label == "C") for r in got)
    assert len({tuple(r.label for r in sorted(got, key=lambda r: (r.k, r.model)) if r.k == k) for k in range(40)}) > 3  # shuffled
    again = J.anonymised(c, "k", "model", 1).collect()
    assert {(r.k, r.model): r.label for r in again} == {(r.k, r.model): r.label for r in got}
    assert {(r.k, r.model): r.label for r in J.anonymised(c, "k", "model", 2).collect()} != {(r.k, r.model): r.label for r in got}


@pytest.mark.parametrize("per_task", [1, 7, 50_000])
def test_serials(spark, per_task):
    rows = [("hot" if i % 3 else f"k{i % 5}", i * i) for i in range(60)]
    got = {(r.key, r.n): r.serial for r in J.serials(spark.createDataFrame(rows, "key string, n long"), "key", "n", per_task).collect()}
    for key in {k for k, _ in rows}:
        own = sorted(n for k, n in rows if k == key)
        assert [got[key, n] for n in own] == list(range(1, len(own) + 1))
    assert J.serials(spark.createDataFrame([], "key string, n long"), "key", "n").count() == 0


def test_capped_keys(spark):
    rows = spark.createDataFrame([(1, 100), (2, 90), (3, 90), (4, 50), (5, 10)], "k int, at long")
    got = {r.k: r.state for r in J.capped_keys(rows, "k", "at", F.lit(100), 80, 2).collect()}
    assert got == {1: "kept", 2: "kept", 3: "evicted", 4: "evicted", 5: "idle"}


class Service:
    def __init__(self, *answers):
        self.answers, self.now, self.slept, self.timeouts = list(answers), 0.0, [], []

    def send(self, payload, timeout):
        self.timeouts.append(timeout)
        answer = self.answers.pop(0)
        if isinstance(answer, (int, type(None))):
            raise R.Refused(answer)
        return answer

    def sleep(self, s):
        self.slept.append(s)
        self.now += s

    def remote(self, **more):
        return R.Remote(self.send, R.Patience(warm=3, cold=20, warm_for=60, tries=3, pause=1, **more), clock=lambda: self.now, sleep=self.sleep)


def test_overload_and_silence_are_tried_again():
    s = Service(503, None, ["ok"])
    assert s.remote()("x") == ["ok"] and s.slept == [1, 2] and s.timeouts == [20, 20, 20]
    for last in (500, 429, None):
        s = Service(500, 500, last)
        with pytest.raises(R.Refused):
            s.remote()("x")
        assert len(s.timeouts) == 3
    s = Service(400, ["never"])
    with pytest.raises(R.Refused):
        s.remote()("x")
    assert s.timeouts == [20] and not s.slept


def test_a_warm_service_gets_less_time():
    s = Service(["a"], ["b"], ["c"], ["d"])
    call = s.remote()
    call("x"), call("x"), call("x", least=9.0)
    s.now += 61
    call("x")
    assert s.timeouts == [20, 3, 9, 20]


def test_texts_go_in_requests_of_bounded_size():
    sizes = []
    run = R.in_requests(lambda: R.Remote(lambda p, t: sizes.append(len(p)) or [x.upper() for x in p]), most=4)
    out = list(run(iter([pd.Series(["a", None, "c", "d", "e"]), pd.Series([], dtype=object)])))
    assert sizes == [4, 1] and out[0].tolist() == ["A", None, "C", "D", "E"] and len(out[1]) == 0
    with pytest.raises(ValueError):
        list(R.in_requests(lambda: R.Remote(lambda p, t: []))(iter([pd.Series(["a"])])))
