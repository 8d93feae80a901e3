"""The folds' twins on streams: keyed state, event by event, as Spark's stateful processors.

Events of a key must come in the order of time, as they do from an ordered source; within a batch they are sorted. With
``idle_ms`` the state of keys that nothing has written to for so long, by the clock, is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from webloom.functions import rules


class Breaker(StatefulProcessor):
    """State: failures in a row, whether open, time of the last failure."""

    def __init__(self, failures: int = rules.BREAKER_FAILURES, cooldown: int = rules.BREAKER_COOLDOWN, idle_ms: int | None = None):
        self.failures, self.cooldown, self.idle_ms = failures, cooldown, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("health", "failures int, is_open boolean, last_failure bigint", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count, is_open, last = self.state.get() if self.state.exists() else (0, False, 0)
        events, out = pd.concat(list(rows)).sort_values(["t", "n"]), []
        for e in events.itertuples():
            admitted = not is_open or e.t - last >= self.cooldown
            if admitted and e.ok is not None and not pd.isna(e.ok):
                if e.ok:
                    count, is_open = 0, False
                else:
                    count, last = count + 1, int(e.t)
                    is_open = is_open or count >= self.failures
            out.append((key[0], int(e.n), int(e.t), admitted, count, is_open, None if e.ok is None or pd.isna(e.ok) else bool(e.ok)))
        self.state.update((count, is_open, last))
        yield pd.DataFrame(out, columns=["backend", "n", "t", "admitted", "failures_after", "open_after", "ok"])

    def close(self) -> None:
        pass


class Limiter(StatefulProcessor):
    """State: the time from which the key owes nothing."""

    def __init__(self, period: int, burst: int, idle_ms: int | None = None):
        self.period, self.burst, self.idle_ms = period, burst, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tat", "tat bigint", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tat, out = self.state.get()[0] if self.state.exists() else -(1 << 62), []
        for e in pd.concat(list(rows)).sort_values(["t", "n"]).itertuples():
            at = max(int(e.t), tat - (self.burst - 1) * self.period)
            tat = max(tat, at) + self.period
            out.append((key[0], int(e.n), int(e.t), at))
        self.state.update((tat,))
        yield pd.DataFrame(out, columns=["backend", "n", "t", "admitted_at"])

    def close(self) -> None:
        pass


class Cache(StatefulProcessor):
    """State: when the entry was stored. Its age is judged by event time."""

    def __init__(self, ttl: int = rules.CACHE_TTL, idle_ms: int | None = None):
        self.ttl, self.idle_ms = ttl, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stored", "stored_at bigint", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored, out = self.state.get()[0] if self.state.exists() else None, []
        for e in pd.concat(list(rows)).sort_values(["t", "n"]).itertuples():
            hit = stored is not None and e.t - stored < self.ttl
            stored = stored if hit else int(e.t)
            out.append((key[0], int(e.n), int(e.t), hit, stored))
        self.state.update((stored,))
        yield pd.DataFrame(out, columns=["key", "n", "t", "hit", "stored_at"])

    def close(self) -> None:
        pass


SCHEMAS = {
    Breaker: "backend string, n long, t long, admitted boolean, failures_after int, open_after boolean, ok boolean",
    Limiter: "backend string, n long, t long, admitted_at long",
    Cache: "key string, n long, t long, hit boolean, stored_at long",
}


def apply(events: DataFrame, key: str, processor: StatefulProcessor) -> DataFrame:
    """Run a processor over a stream of events by key. The session needs the RocksDB state store."""
    return events.groupBy(key).transformWithStateInPandas(processor, SCHEMAS[type(processor)], "Append", "None")


def request_lines(spark, path: str) -> DataFrame:
    """Lines of request files as a stream, one column line."""
    return spark.readStream.text(path).withColumnRenamed("value", "line")
