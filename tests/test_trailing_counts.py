"""Counts over stretches of time against one window a key; no window takes a key alone."""

from corpusloom.operators import state as S


def test_stretches_give_the_counts_of_one_window(spark):
    rows = [(i, "ab"[i % 2], None if i % 17 == 0 else (i * 37) % 101 - 40) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k string, us long")
    want = {tuple(r) for r in df.select("id", S.trailing_count("k", "us", 10).alias("n")).collect()}
    got = S.trailing_counts(df, "k", "us", 10)
    assert sorted(tuple(r) for r in got.select("id", "n").collect()) == sorted(want)
    assert "_at" in got._jdf.queryExecution().optimizedPlan().toString()
