"""Calls to a model service from Python workers: in batches, with patience for a service that has to start first.

A worker keeps one `Remote`; what it knows of the service (when it last answered) is its own. What still fails after the
last try fails the task, and Spark tries the task again elsewhere.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd


class Refused(Exception):
    """The service's answer was an error; `status` is its code, None where there was no answer in time."""

    def __init__(self, status: int | None):
        super().__init__(f"status {status}")
        self.status = status


@dataclass(frozen=True)
class Patience:
    """Seconds to wait for an answer from a service that is warm, and from one that may have to start; for how long after
    an answer it counts as warm; tries in all; seconds before the second try, doubled before each further one."""

    warm: float = 30.0
    cold: float = 150.0
    warm_for: float = 240.0
    tries: int = 3
    pause: float = 1.0


class Remote:
    def __init__(self, send: Callable, patience: Patience = Patience(), clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.send, self.patience, self.clock, self.sleep = send, patience, clock, sleep
        self.answered: float | None = None

    def timeout(self, least: float = 0.0) -> float:
        p = self.patience
        warm = self.answered is not None and self.clock() - self.answered <= p.warm_for
        return max(p.warm if warm else p.cold, least)

    def __call__(self, payload, least: float = 0.0):
        """The answer. Overload, failures of the service and silence are tried again; a refusal of the request is not."""
        for left in reversed(range(self.patience.tries)):
            try:
                answer = self.send(payload, self.timeout(least))
            except Refused as e:
                again = e.status is None or e.status == 429 or e.status >= 500
                if not again or not left:
                    raise
                self.sleep(self.patience.pause * 2 ** (self.patience.tries - 1 - left))
            else:
                self.answered = self.clock()
                return answer
        raise ValueError("no tries")


def in_requests(connect: Callable[[], Remote], most: int = 256, least: float = 0.0) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    """The body of an iterator UDF: texts go in requests of at most `most`, empty batches in none. The service gets a
    list and answers with a list of the same length; nulls are sent as empty texts and stay null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        remote = connect()  # once a task
        for texts in batches:
            out: list = []
            for at in range(0, len(texts), most):
                part = texts.iloc[at : at + most]
                got = remote([t or "" for t in part], least)
                if len(got) != len(part):
                    raise ValueError(f"{len(part)} texts sent, {len(got)} answers")
                out += [None if t is None else g for t, g in zip(part, got, strict=True)]
            yield pd.Series(out, dtype=object)

    return run
