"""Rate limits and circuit breakers as streams: the rules of rillgraph.operators.events over keyed state.

Rows of a key wait in its state until the watermark has passed them, and are then judged in order of time. So the result is that
of the batch whatever triggers, restarts and disorder within the watermark there are; what comes later than the watermark is
dropped, and Spark's progress counts it. A timer wakes a key at its next waiting row and, when nothing waits, at the time from which its
state no longer matters: it is deleted then, so state is kept for active keys only.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rillgraph.operators.events import breaker_step, window_step

_EPOCH = datetime(1970, 1, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(t: datetime | None) -> int | None:
    return None if t is None else (t - _EPOCH) // timedelta(microseconds=1)


def _time(micros: int | None) -> datetime | None:
    return None if micros is None else _EPOCH + timedelta(microseconds=int(micros))


class Rule:
    """How a key's state goes on: step(state, time, flag) gives the next state and the row's values; forgotten(state) the time from
    which the state is as good as none, None if never."""

    state: str
    out: str

    def step(self, state: tuple | None, t: datetime, flag: bool | None) -> tuple:
        raise NotImplementedError

    def forgotten(self, state: tuple) -> datetime | None:
        raise NotImplementedError


class Window(Rule):
    """At most `limit` requests in windows that start at a client's first request later than `seconds` after the last start."""

    state, out = "start long, n long", "event_id long, allowed boolean"

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds = limit, seconds

    def step(self, state: tuple | None, t: datetime, flag: bool | None) -> tuple:
        (start, n), allowed = window_step(state and (_time(state[0]), state[1]), t, self.limit, self.seconds)
        return (_micros(start), n), allowed

    def forgotten(self, state: tuple) -> datetime | None:
        return _time(state[0]) + timedelta(seconds=self.seconds)


class Breaker(Rule):
    """A service is cut off after so many failures, until a call later than the reset after the last one."""

    state, out = "bad long, last long, open boolean", "event_id long, state string, passed boolean"

    def __init__(self, failures: int, reset_seconds: float):
        self.failures, self.reset = failures, reset_seconds

    def step(self, state: tuple | None, t: datetime, flag: bool | None) -> tuple:
        (bad, last, is_open), name, passed = breaker_step(state and (state[0], _time(state[1]), state[2]), t, flag, self.failures, self.reset)
        return (bad, _micros(last), is_open), name, passed

    def forgotten(self, state: tuple) -> datetime | None:
        bad, last, is_open = state
        if not bad:
            return _EPOCH
        return _time(last) + timedelta(seconds=self.reset) if is_open else None


class InOrder(StatefulProcessor):
    """Rows (event_id, t in microseconds, flag) of a key, judged by a rule in order of time once the watermark has passed them."""

    def __init__(self, rule: Rule):
        self.rule = rule
        self.names = [c.split()[0] for c in rule.out.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, event_id long, flag boolean")
        self.kept = handle.getValueState("kept", self.rule.state)

    def _wake(self, millis: int) -> None:
        self.handle.registerTimer(millis)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(int(t), int(e), None if f is None or pd.isna(f) else bool(f)) for part in rows for t, e, f in zip(part["t"], part["event_id"], part["flag"], strict=True)]
        self.waiting.appendList(new)
        self._wake(max(min(r[0] for r in new) // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        yield pd.DataFrame([], columns=self.names, dtype=object)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        state, out = tuple(self.kept.get()) if self.kept.exists() else None, []
        for t, event, flag in due:
            state, *made = self.rule.step(state, _time(t), flag)
            out.append((event, *made))
        if due:
            self.kept.update(state)
            self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self._wake(later[0][0] // 1000 + 1)
        elif state is not None and (gone := self.rule.forgotten(state)) is not None:
            at = _micros(gone) // 1000 + 1
            if at * 1000 <= passed:
                self.kept.clear()
            else:
                self._wake(at)
        yield pd.DataFrame(out, columns=self.names, dtype=object)


def judged(stream: DataFrame, rule: Rule, late: str = "1 minute") -> DataFrame:
    """The rule's values for each row of a stream (event_id, key, ts and, for a breaker, failed), once it is `late` behind the newest.

    The session's state store must be RocksDB (ROCKS), which holds more keys than memory does.
    """
    flag_of = F.col("failed") if "failed" in stream.columns else F.lit(None).cast("boolean")
    rows = stream.withWatermark("ts", late).select("key", "ts", F.unix_micros("ts").alias("t"), "event_id", flag_of.alias("flag"))
    return rows.groupBy("key").transformWithStateInPandas(InOrder(rule), rule.out, "Append", "EventTime")
