"""Structured Streaming forms: windowed counts with late data, debounced pushes, keyed rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events (ts, event_type, value) by type and window; what comes later than `late` is dropped."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def debounced(events: DataFrame, width: str = "300 milliseconds", late: str = "1 minute") -> DataFrame:
    """STR-15: one push a topic and window however many changes fall in it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "topic").agg(F.count("*").alias("changes")).select(F.col("window.end").alias("at"), "topic", "changes")


def rate_limited(calls: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """STR-14 on a stream: calls (key, at_ms, call_id) with allowed; the state of a key is its window's start and use."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, used = state.get if state.exists else (None, 0)
        rows = pd.concat(batches).sort_values(["at_ms", "call_id"])
        allowed = []
        for at in rows.at_ms:
            if opened is None or at - opened >= window_ms:
                opened, used = int(at), 0
            used += 1
            allowed.append(used <= limit)
        state.update((opened, used))
        yield pd.DataFrame({"key": key[0], "call_id": rows.call_id, "allowed": allowed})

    return calls.groupBy("key").applyInPandasWithState(step, "key long, call_id long, allowed boolean", "opened long, used int", "append", GroupStateTimeout.NoTimeout)


class CallLimiter(StatefulProcessor):
    """Judges a key's calls in the order of their times once the watermark has passed them, and forgets a window once it is over.

    State: the open window's start and use, and the calls that wait for the watermark. A timer for each waiting time judges
    what is due; one at the window's end clears it, so a key without calls holds no state.
    """

    def __init__(self, limit: int, window_ms: int) -> None:
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened long, used int")
        self.waiting = handle.getListState("waiting", "at_ms long, call_id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        came = pd.concat(list(rows))
        at = (came["at"].astype("datetime64[us]").astype("int64") // 1000).tolist()
        self.waiting.appendList(list(zip(at, came["call_id"].tolist(), strict=True)))
        for t in set(at):
            self.handle.registerTimer(t)
        yield pd.DataFrame({"key": [], "call_id": [], "allowed": []}).astype({"key": "int64", "call_id": "int64", "allowed": "bool"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted((int(a), int(c)) for a, c in self.waiting.get()) if self.waiting.exists() else []
        due, rest = [x for x in held if x[0] <= now], [x for x in held if x[0] > now]
        opened, used = map(int, self.window.get()) if self.window.exists() else (None, 0)
        allowed = []
        for at, _ in due:
            if opened is None or at - opened >= self.window_ms:
                opened, used = at, 0
            used += 1
            allowed.append(used <= self.limit)
        if due:
            self.window.update((opened, used))
            self.handle.registerTimer(opened + self.window_ms)
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        if opened is not None and now >= opened + self.window_ms and not rest:
            self.window.clear()
        yield pd.DataFrame({"key": pd.Series([key[0]] * len(due), dtype="int64"), "call_id": pd.Series([c for _, c in due], dtype="int64"), "allowed": pd.Series(allowed, dtype="bool")})

    def close(self) -> None:
        """Nothing is held outside the state."""


def limited_calls(calls: DataFrame, limit: int, window_ms: int, late: str = "1 minute") -> DataFrame:
    """STR-14 on a stream with late calls: key, call_id, allowed of calls (key, at, call_id), each once the watermark has passed it.

    A window begins with the first call after the last one ended, as in limits.rate_limit(), and calls that come out of order within
    `late` are judged in the order of their times; later ones are dropped. Needs the RocksDB state store.
    """
    rows = calls.select("key", "at", "call_id").withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(CallLimiter(limit, window_ms), "key long, call_id long, allowed boolean", "Append", "EventTime")


class Debounce(StatefulProcessor):
    """One push for all changes of a topic within so many milliseconds of the first one; then nothing is held."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("changes", "at_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        at = (pd.concat(list(rows))["at"].astype("datetime64[us]").astype("int64") // 1000).tolist()
        self.held.appendList([(t,) for t in at])
        self.handle.registerTimer(min(at) + self.quiet_ms)
        yield self._pushes(key, [])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        left, pushes = sorted(int(t[0]) for t in self.held.get()) if self.held.exists() else [], []
        while left and left[0] + self.quiet_ms <= now:
            end = left[0] + self.quiet_ms
            pushes.append((end, sum(t < end for t in left)))
            left = [t for t in left if t >= end]
        if left:
            self.held.put([(t,) for t in left])
            self.handle.registerTimer(left[0] + self.quiet_ms)
        else:
            self.held.clear()
        yield self._pushes(key, pushes)

    @staticmethod
    def _pushes(key: tuple, pushes: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"topic": pd.Series([key[0]] * len(pushes), dtype="object"), "at": pd.to_datetime(pd.Series([p[0] for p in pushes], dtype="int64"), unit="ms"), "changes": pd.Series([p[1] for p in pushes], dtype="int64")})

    def close(self) -> None:
        """Nothing is held outside the state."""


def pushes(changes: DataFrame, quiet_ms: int = 300, late: str = "1 minute") -> DataFrame:
    """STR-15: topic, at, changes: one push a topic for what happened within quiet_ms of the first change that no push had. changes: topic, at."""
    rows = changes.select("topic", "at").withWatermark("at", late)
    return rows.groupBy("topic").transformWithStateInPandas(Debounce(quiet_ms), "topic string, at timestamp, changes long", "Append", "EventTime")
