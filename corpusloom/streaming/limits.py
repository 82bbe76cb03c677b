"""Limits whose decisions depend on earlier decisions, as keyed state.

A key's state goes when the watermark has passed the time from which it says nothing more, so that keys which stay away
do not pile up. Requests that come later than `late` behind the newest one are too late for a decision and give none.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECISION = "user_id long, event_id long, accepted boolean, wait_us long"


def kept_until(state: GroupState, us: int, *values) -> None:
    """Keeps a key's state until the watermark has passed `us`; not at all if it has already."""
    ms = us // 1000 + 1
    if ms <= state.getCurrentWatermarkMs():
        state.remove()
    else:
        state.update(values)
        state.setTimeoutTimestamp(ms)


def admits(held: list[int], t: int, limit: int, window_us: int) -> tuple[bool, int]:
    """Whether a request at `t` may join the accepted times `held` (sorted), and how long it would have to wait: no window
    (x - window, x] may hold more than `limit`, windows that end after a late request included."""
    here = bisect_right(held, t)
    after = [*held[:here], t, *held[here:]]
    for i in range(max(0, here - limit), min(here + 1, len(after) - limit)):
        if after[i + limit] - after[i] < window_us:
            return False, after[i] + window_us - t
    return True, 0


def sliding_limit(requests: DataFrame, limit: int, window_us: int, late: str = "10 minutes") -> DataFrame:
    """Accepts a request if no window of `window_us` then holds more than `limit` accepted ones: for requests in order,
    if fewer than `limit` lie in (t - window, t]. A late one is also weighed against those accepted before it came.

    The state of a key is the sorted times of its accepted requests that a request may still meet: those not older than
    the watermark by more than a window, so at most `limit` for each window since the watermark."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        still = state.getCurrentWatermarkMs() * 1000 - window_us
        held = [x for x in (state.get[0] if state.exists else []) if x > still]
        rows = pd.concat([b[["us", "event_id"]] for b in batches]).sort_values(["us", "event_id"])
        out = []
        for event, t in zip(rows["event_id"].tolist(), rows["us"].tolist(), strict=True):
            ok, wait = admits(held, t, limit, window_us)
            out.append((key[0], event, ok, wait))
            if ok:
                insort(held, t)
        kept_until(state, max([*held[-1:], int(rows["us"].iloc[-1])]) + window_us, held)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DECISION.split(", ")])

    timed = requests.withWatermark("ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(decide, DECISION, "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def counts_of_days(days: list[int], taken: list[int], times: list[int], limit: int, day_us: int) -> tuple[dict[int, int], list[tuple[bool, int]]]:
    """The counts of all open days after requests at `times`, and what was decided: late ones count for their own day."""
    counts = dict(zip(days, taken, strict=True))
    said = []
    for t in times:
        day = t // day_us
        ok = counts.get(day, 0) < limit
        counts[day] = counts.get(day, 0) + ok
        said.append((ok, 0 if ok else (day + 1) * day_us - t))
    return counts, said


def daily_counter(requests: DataFrame, limit: int, day_us: int = 86_400_000_000, late: str = "10 minutes") -> DataFrame:
    """Accepts the first `limit` requests of each key and UTC day, in the order in which they come. A key's state holds a
    count for every day that the watermark has not passed, so that a late request counts for its own day and leaves the
    others alone."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        days, taken = state.get if state.exists else ([], [])
        rows = pd.concat([b[["us", "event_id"]] for b in batches]).sort_values(["us", "event_id"])
        counts, said = counts_of_days(list(days), list(taken), rows["us"].tolist(), limit, day_us)
        open_days = sorted(d for d in counts if (d + 1) * day_us > state.getCurrentWatermarkMs() * 1000)
        kept_until(state, (max(counts) + 1) * day_us, open_days, [counts[d] for d in open_days])
        yield pd.DataFrame([(key[0], e, *d) for e, d in zip(rows["event_id"].tolist(), said, strict=True)], columns=[c.split()[0] for c in DECISION.split(", ")])

    timed = requests.withWatermark("ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(decide, DECISION, "days array<long>, taken array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def new_or_changed(current: DataFrame, arrived: DataFrame, key: str, version: str) -> DataFrame:
    """For foreachBatch: the table after newer rows of a batch have replaced older ones of their key."""
    newest = current.unionByName(arrived).groupBy(key).agg(F.max_by(F.struct(*current.columns), version).alias("row"))
    return newest.select("row.*")
