"""Limits one behind the other on a stream, decided in the order of the requests' times.

A request waits until the watermark has passed it, so that however requests are spread over batches, and however late
they come within the watermark's delay, the decisions are those of the whole log in order. Those that come later than
that are dropped, as windows drop them, and those that the watermark has not passed yet have no decision yet.

The stages are stateful operators of one query: the watermark runs through all of them, and a request is decided by
every stage in the batch in which the first one decides it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SPREAD = 256
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
REJECTED = "rejected_by"


@dataclass(frozen=True)
class Sliding:
    """Accepts a request while fewer than `limit` accepted ones of its key lie in (t - window, t]."""

    limit: int
    window_us: int

    def step(self, held: list[int], t: int) -> tuple[bool, list[int]]:
        held = [x for x in held if x > t - self.window_us]
        ok = len(held) < self.limit
        return ok, [*held, t] if ok else held

    def until(self, held: list[int]) -> int:
        """From when on `held` says nothing more."""
        return held[-1] + self.window_us if held else 0


@dataclass(frozen=True)
class Daily:
    """Accepts the first `limit` requests of its key and day; what is held is the day and its count."""

    limit: int
    day_us: int = 86_400_000_000

    def step(self, held: list[int], t: int) -> tuple[bool, list[int]]:
        day = t // self.day_us
        n = held[1] if held and held[0] == day else 0
        return n < self.limit, [day, n + (n < self.limit)]

    def until(self, held: list[int]) -> int:
        return (held[0] + 1) * self.day_us if held else 0


@dataclass(frozen=True)
class Stage:
    """`key` names whose limit it is. With `dealt`, requests of one key are first thinned in that many groups, each of
    which lets through what the whole stage could accept at most: right for daily limits, where the first n of all are
    among the first n of each group, and what a key with a third of all requests needs."""

    key: Column
    rule: Sliding | Daily
    dealt: int = 1


class InOrder(StatefulProcessor):
    """State of a key: requests that wait (at most those of the watermark's delay and of one batch), and what the rule
    holds. One timer a key: for the earliest request that waits, else for the end of what is held."""

    def __init__(self, rule: Sliding | Daily, number: int, columns: list[str], kinds: str):
        self.rule, self.number, self.columns, self.kinds = rule, number, columns, kinds
        self.us, self.tie = columns.index("us"), columns.index("event_id")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = Row("ts", *self.columns, REJECTED)
        self.waiting = handle.getListState("waiting", self.kinds)
        self.held = handle.getValueState("held", "held array<long>")

    def wake(self, us: int, now_ms: int) -> None:
        """The key's timer, at the first millisecond that is not before `us`, unless one comes earlier. Timers up to the
        watermark do not count: they fire in this batch, and one that is firing is still listed."""
        at, timers = -(-us // 1000), [int(x) for x in self.handle.listTimers() if int(x) > now_ms]
        if not timers or min(timers) > at:
            for other in timers:
                self.handle.deleteTimer(other)
            self.handle.registerTimer(at)

    def out(self, row: tuple, rejected: int | None) -> Row:
        return self.row(EPOCH + timedelta(microseconds=row[self.us]), *row, rejected)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        asking = []
        for r in rows:
            row = tuple(r[c] for c in self.columns)
            if r[REJECTED] is None:
                asking.append(row)
            else:
                yield self.out(row, r[REJECTED])
        if asking:
            self.waiting.appendList(asking)
            self.wake(min(r[self.us] for r in asking), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        now = now_ms * 1000
        waiting = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[self.us], r[self.tie]))
        due = [r for r in waiting if r[self.us] <= now]
        later = waiting[len(due) :]
        held = list(self.held.get()[0]) if self.held.exists() else []
        said = []
        for r in due:
            ok, held = self.rule.step(held, r[self.us])
            said.append(None if ok else self.number)
        if due:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        open_until = self.rule.until(held)
        if later or open_until > now:
            self.held.update((held,))
            self.wake(later[0][self.us] if later else open_until, now_ms)
        else:
            self.held.clear()
        yield from map(self.out, due, said)

    def close(self) -> None:
        pass


def chained(requests: DataFrame, stages: list[Stage], late: str = "10 minutes") -> DataFrame:
    """`requests` (ts, us: its microseconds, event_id, and what the stages' keys need: numbers and strings) with
    rejected_by: the number, from 0, of the stage that rejected it, null where all accepted. What a stage rejects does
    not spend the later ones. Rejected requests go through the later stages spread over keys of their own, without
    state. Null keys are a key like others. A column named rejected_by is not allowed."""
    if REJECTED in requests.columns:
        raise ValueError(f"requests have a column {REJECTED} of their own")
    kept = [f for f in requests.schema if f.name != "ts"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    out = requests.select("ts", *[f"`{f.name}`" for f in kept]).withWatermark("ts", late).withColumn(REJECTED, F.lit(None).cast("int"))
    for number, stage in enumerate(stages):
        for groups in [stage.dealt, 1] if stage.dealt > 1 else [1]:
            asks = F.col(REJECTED).isNull()
            spread = F.xxhash64("event_id")
            keyed = out.withColumn("_key", F.when(asks, stage.key.cast("string"))).withColumn("_deal", F.when(asks, F.pmod(spread, F.lit(groups))).otherwise(-1 - F.pmod(spread, F.lit(SPREAD))))
            processor = InOrder(stage.rule, number, [f.name for f in kept], kinds)
            out = keyed.groupBy("_key", "_deal").transformWithState(processor, f"ts timestamp, {kinds}, {REJECTED} int", "append", "eventTime", eventTimeColumnName="ts")
    return out
