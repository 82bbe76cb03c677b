"""Sessions, histories, limits and quotas, in batch: windows where acceptance depends on order alone, ordered folds per
key where it depends on what was accepted before."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_turns(messages: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n messages of each conversation; `place` counts them in ascending order."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    kept = messages.withColumn("_b", back).filter(F.col("_b") <= n)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order))).drop("_b")


def beyond_newest(rows: DataFrame, owner: str, newest: list[Column], keep: Column | int) -> DataFrame:
    """Rows that are over an owner's cap, oldest beyond the newest `keep`."""
    place = F.row_number().over(Window.partitionBy(owner).orderBy(*newest))
    return rows.withColumn("_p", place).filter(F.col("_p") > keep).drop("_p")


def first_n(rows: DataFrame, by: list[Column | str], order: list[str], limit: int) -> Column:
    """Whether a request is among the first `limit` of its window (0 or less: no limit)."""
    if limit <= 0:
        return F.lit(True)
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)) <= limit


def trailing_counts(rows: DataFrame, key: str, micros: str, window_us: int) -> DataFrame:
    """`rows` with n, as `trailing_count` has it. A row also stands in the stretch of time behind its own, so that a task
    holds two stretches of a key, not all of its rows."""
    own = rows.withColumns({"_at": F.floor(F.col(micros) / window_us), "_own": F.lit(True)})
    behind = own.filter(F.col(micros).isNotNull()).withColumns({"_at": F.col("_at") + 1, "_own": F.lit(False)})
    n = F.count(F.lit(1)).over(Window.partitionBy(key, "_at").orderBy(micros).rangeBetween(-(window_us - 1), 0))
    return own.unionByName(behind).withColumn("n", n).filter("_own").drop("_at", "_own")


def trailing_count(key: str, micros: str, window_us: int) -> Column:
    """Requests of the key in (t - window, t], this one included."""
    return F.count(F.lit(1)).over(Window.partitionBy(key).orderBy(micros).rangeBetween(-(window_us - 1), 0))


Step = Callable[[int], tuple[bool, int]]


def sliding_log(limit: int, window_us: int) -> Step:
    """Accepted, and microseconds to wait: a request counts only if fewer than `limit` accepted ones lie in (t - w, t]."""
    held: deque[int] = deque()

    def step(t: int) -> tuple[bool, int]:
        while held and held[0] <= t - window_us:
            held.popleft()
        if len(held) < limit:
            held.append(t)
            return True, 0
        return False, held[0] + window_us - t if held else window_us

    return step


def anchored_window(limit: int, window_us: int) -> Step:
    """Accepted, and the count taken: a window opens at the first request after the last one ran out."""
    start, taken = None, 0

    def step(t: int) -> tuple[bool, int]:
        nonlocal start, taken
        if start is None or start <= t - window_us:
            start, taken = t, 0
        ok = taken < limit
        taken += ok
        return ok, taken

    return step


def folded(rows: DataFrame, key: str, micros: str, tie: str, fold: Callable[[], Step], extra: str) -> DataFrame:
    """Runs a fold over each key's requests in order: key, tie, accepted, extra. Requests are streamed in sorted
    partitions, so that memory holds the fold's state and one batch, however many requests a key has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, step = object(), fold()
        for pdf in batches:
            found = []
            for k, t in zip(pdf[key].tolist(), pdf[micros].tolist(), strict=True):
                if k != current:
                    current, step = k, fold()
                found.append(step(t))
            yield pd.DataFrame({key: pdf[key], tie: pdf[tie], "accepted": [a for a, _ in found], extra: [x for _, x in found]})

    kinds = dict(rows.dtypes)
    dealt = rows.select(key, micros, tie).repartition(key).sortWithinPartitions(key, micros, tie)
    return dealt.mapInPandas(run, f"{key} {kinds[key]}, {tie} {kinds[tie]}, accepted boolean, {extra} long")


def streaks(rows: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Adds streak: failures in a row up to this one, 0 after a success."""
    by = Window.partitionBy(key).orderBy(*order)
    island = F.sum((~failed).cast("int")).over(by)
    inner = Window.partitionBy(key, "_island").orderBy(*order)
    return rows.withColumn("_island", island).withColumn("streak", F.sum(failed.cast("int")).over(inner)).drop("_island")


def lock_seconds(failures: Column) -> Column:
    """Back-off from the tenth failure on, doubling from 30 s to at most 900 s."""
    return F.when(failures >= 10, F.least(F.lit(900), (30 * F.pow(F.lit(2.0), F.least(failures - 10, F.lit(10)))).cast("int"))).otherwise(0)


def liveness(at: Column) -> Column:
    """First reason why a session is not live, else 'live'. Ends count as over."""
    return (
        F.when(F.col("user_id").isNull(), "unknown").when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("absolute_expires") <= at, "absolute_expired")
        .when(F.col("idle_expires") <= at, "idle_expired").when(~F.col("is_active"), "inactive_user").otherwise("live")
    )


def majority_of_last(level: str, key: str, order: str, n: int = 3) -> Column:
    """Majority of the last n levels, ties to the most recent."""
    seen = F.collect_list(level).over(Window.partitionBy(key).orderBy(order).rowsBetween(-(n - 1), 0))
    size = lambda x: F.size(F.filter(seen, lambda y: y == x))
    scored = F.transform(seen, lambda x, i: F.struct(size(x).alias("n"), i.alias("i"), x.alias("level")))
    return F.array_max(scored)["level"]
