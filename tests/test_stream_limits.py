"""State of keys over several batches of a stream: decisions as over the whole log, and keys that stay away are forgotten."""

from pyspark.sql import functions as F

from corpusloom.streaming import limits, ordered
from corpusloom.streaming.sinks import ROCKS, STORE, drained, setting

MINUTE = 60_000_000
START = 170_000 * 100 * MINUTE  # some day of 2002; a multiple of what counts as a day below


def batches(spark, tmp_path, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "user_id long, event_id long, us long").coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
    read = spark.readStream.schema("user_id long, event_id long, us long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    return read.withColumn("ts", F.timestamp_micros("us"))


def test_limits_over_batches(spark, tmp_path):
    rows = [(u, u * 1000 + i, START + (i * 7 + u) * MINUTE) for u in range(3) for i in range(60)]
    parts = [[r for r in rows if lo <= r[2] - START < lo + 60 * MINUTE] for lo in range(0, 480 * MINUTE, 60 * MINUTE)]
    stream = batches(spark, tmp_path, [p for p in parts if p])
    got = {r.event_id: r.accepted for r in drained(limits.sliding_limit(stream, 2, 30 * MINUTE, "61 minutes")).collect()}
    want, held = {}, {}
    for u, e, t in sorted(rows, key=lambda r: r[2]):
        own = held.setdefault(u, [])
        own[:] = [x for x in own if x > t - 30 * MINUTE]
        want[e] = len(own) < 2
        own += [t] * want[e]
    assert got == want
    daily = {r.event_id: r.accepted for r in drained(limits.daily_counter(stream, 4, 100 * MINUTE, "61 minutes")).collect()}
    seen: dict = {}
    for u, e, t in sorted(rows, key=lambda r: r[2]):
        n = seen[u, t // (100 * MINUTE)] = seen.get((u, t // (100 * MINUTE)), 0) + 1
        assert daily[e] == (n <= 4)


def test_late_requests_count_for_their_own_day(spark, tmp_path):
    day = 1440 * MINUTE
    parts = [[(1, 1, START + day), (1, 2, START + day + MINUTE)], [(1, 3, START + day - MINUTE)], [(1, 4, START + day + 3 * MINUTE), (1, 5, START + day - 2 * MINUTE), (1, 6, START + day - 3 * MINUTE), (2, 7, START + day)]]
    day0 = START - START % day + day
    parts = [[(u, e, t - START % day) for u, e, t in p] for p in parts]
    assert all((t // day) in (day0 // day, day0 // day - 1) for p in parts for _, _, t in p)
    got = {r.event_id: r.accepted for r in drained(limits.daily_counter(batches(spark, tmp_path, parts), 2, day, "1 day")).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True, 7: True}  # 6 comes before 5 in its batch


def test_late_requests_and_sliding_windows(spark, tmp_path):
    at = lambda *minutes: [(1, m, START + m * MINUTE) for m in minutes]
    stream = batches(spark, tmp_path, [at(100, 150, 200), at(140), at(145, 205, 210), at(301)])
    got = {r.event_id: (r.accepted, r.wait_us // MINUTE) for r in drained(limits.sliding_limit(stream, 2, 100 * MINUTE, "1 day")).collect()}
    assert got == {100: (True, 0), 150: (True, 0), 200: (True, 0), 140: (False, 60), 145: (False, 55), 205: (False, 45), 210: (False, 40), 301: (True, 0)}


def test_windows_never_hold_more_than_the_limit():
    import random

    rng = random.Random(1)
    for _ in range(200):
        held, limit, window = [], rng.randint(1, 4), rng.randint(1, 30)
        for t in [rng.randrange(100) for _ in range(60)]:
            ok, wait = limits.admits(held, t, limit, window)
            new = sorted([*held, t])
            assert ok == all(sum(x - window < y <= x for y in new) <= limit for x in new) and (ok or wait > 0 or t < max(held))
            held = new if ok else held


def plain_chain(rows, stages):
    """One request after the other: the stage that rejects each, or None."""
    said, spent = {}, {}
    for u, e, t in sorted(rows, key=lambda r: (r[2], r[1])):
        said[e] = None
        for n, (key, limit, window, by_day) in enumerate(stages):
            own = spent.setdefault((n, key(u)), [])
            if sum(x // window == t // window if by_day else x > t - window for x in own) >= limit:
                said[e] = n
                break
            own.append(t)
    return said


def test_chained_limits_over_batches_with_late_requests(spark, tmp_path):
    import random

    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), i, START + rng.randrange(600) * MINUTE) for i in range(260)]
    rows += [(9, 1000, START + 600 * MINUTE), (9, 1001, START + 700 * MINUTE)]
    comes = sorted(rows, key=lambda r: r[2] // MINUTE + (0 if r[1] >= 1000 else rng.randrange(55)))  # up to 55 minutes late
    parts = [comes[i : i + 40] for i in range(0, len(comes), 40)]
    day, user = 200 * MINUTE, F.col("user_id")
    stages = [
        ordered.Stage(user, ordered.Sliding(6, 60 * MINUTE)), ordered.Stage(user % 2, ordered.Sliding(4, 20 * MINUTE)), ordered.Stage(user, ordered.Daily(14, day)), ordered.Stage(F.lit("all"), ordered.Daily(25, day), dealt=3),
    ]
    plain = [(lambda u: u, 6, 60 * MINUTE, False), (lambda u: u if u is None else u % 2, 4, 20 * MINUTE, False), (lambda u: u, 14, day, True), (lambda u: 0, 25, day, True)]
    with setting(spark, STORE, ROCKS):
        out = drained(ordered.chained(batches(spark, tmp_path, parts).select("ts", "us", "event_id", "user_id"), stages, "60 minutes"))
    got = [(r.event_id, r.rejected_by) for r in out.collect()]
    want = plain_chain(rows, plain)
    past = START + 640 * MINUTE
    assert len(got) == len(dict(got)) and dict(got) == {e: want[e] for _, e, t in rows if t <= past}
    assert set(want.values()) == {None, 0, 1, 2, 3} and spark.conf.get(STORE) != ROCKS
