"""Circuits over long pasts: what a bin of time does to any state that it can be entered with, and its rows for the one it was.

A circuit that opens stays so for a cooldown, so a bin is passed through by jumps: from where it opens to the first event
after the cooldown, and from a success to where failures in a row open it next. States of open circuits differ only in
when they are over, and that only by the first event from then on, which lies in the bin's first cooldown.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Before all times; what is not timed comes first.
EARLY = -(1 << 61)
#: How a bin is left: closed, open with a count of its own, open with a count on top of what there was, as it was entered.
CLOSED, OPEN, MORE, SAME = range(4)


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by time, number and outcome; times; outcomes (1, 0, or -1 if unknown)."""
    t = table.column("t").fill_null(EARLY).to_numpy()
    n = table.column("n").fill_null(-(1 << 63)).to_numpy()
    ok = table.column("ok").cast(pa.int8()).fill_null(-1).to_numpy()
    order = np.lexsort((ok, n, t))
    return order, t[order], ok[order]


def _failures(good: np.ndarray) -> np.ndarray:
    """Failures in a row up to each event."""
    at = np.arange(1, len(good) + 1)
    return at - np.maximum.accumulate(np.where(good, at, 0))


def summary(t: np.ndarray, good: np.ndarray, failures: int, cooldown: int) -> tuple[list, list, list, list]:
    """What known outcomes do. kind, count, since: of entries closed with 0, 1, ... failures, then of open ones by ``upto``, the
    latest end of a cooldown that has this outcome (the last one's is without bound if no event is late enough)."""
    m = len(t)
    streak = _failures(good)
    opens = np.flatnonzero(streak == failures)
    run = int(np.argmax(good)) if good.any() else m  # failures before the first success
    late = int(np.searchsorted(t, t[0] + cooldown)) if m else 0
    tried = np.arange(min(late + 1, m))
    tried = tried[(tried == 0) | (t[tried] > t[tried - 1])]
    size = failures + len(tried)
    at = np.full(size, m)  # the next event that is admitted while open
    kind, count, since = np.full(size, MORE, np.int8), np.zeros(size, np.int64), np.zeros(size, np.int64)
    at[failures:] = tried
    end = streak[-1] if m else 0

    def opened(rows: np.ndarray, i: np.ndarray) -> None:
        since[rows] = t[i]
        at[rows] = np.maximum(np.searchsorted(t, t[i] + cooldown), i + 1)

    def closed(rows: np.ndarray, after: np.ndarray) -> None:
        """Closed with nothing counted from ``after``: where it opens next."""
        k = np.searchsorted(opens, after)
        found = k < len(opens)
        kind[rows], count[rows], at[rows] = OPEN, failures, m
        kind[rows[~found]], count[rows[~found]] = CLOSED, end
        if found.any():
            opened(rows[found], opens[k[found]])

    for c in range(failures):
        own = np.array([c])
        if c + run >= failures:
            kind[c], count[c] = OPEN, failures
            opened(own, np.array([failures - c - 1]))
        elif run == m:
            kind[c], count[c] = CLOSED, c + m
        else:
            closed(own, np.array([run]))
    live = np.flatnonzero(at < m)
    while len(live):
        j = at[live]
        won = good[j]
        count[live[~won]] += 1
        opened(live[~won], j[~won])
        closed(live[won], j[won])
        live = live[at[live] < m]
    # Ends of cooldowns that lie side by side and come to the same are one.
    keep = np.ones(len(tried), bool)
    own = slice(failures, None)
    keep[:-1] = (np.diff(kind[own]) != 0) | (np.diff(count[own]) != 0) | (np.diff(since[own]) != 0)
    chosen = np.r_[np.arange(failures), failures + np.flatnonzero(keep)].astype(int)
    out = [x[chosen].tolist() for x in (kind, count, since)]
    upto = t[tried[keep]].tolist()
    if late >= m:
        for x, y in zip(out, (SAME, 0, 0), strict=True):
            x.append(y)
    return (*out, upto)


def replay(t: np.ndarray, ok: np.ndarray, state: tuple[bool, int, int], failures: int, cooldown: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """admitted, and the state after each event: count, open, since. ``state`` is the one before: open, count, since."""
    open_, c, f = state
    known = ok >= 0
    times, good = t[known], ok[known] == 1
    m = len(times)
    streak = _failures(good)
    if not open_:
        streak[: int(np.argmax(good)) if good.any() else m] += c
    opens = np.flatnonzero(streak == failures)
    # Of events with known outcome; first, what there was before.
    counts, opened, since = np.empty(m + 1, np.int64), np.zeros(m + 1, bool), np.zeros(m + 1, np.int64)
    counts[0], opened[0], since[0], counts[1:] = c, open_, f, streak
    at = 0
    while at < m:
        if not open_:
            k = int(np.searchsorted(opens, at))
            if k == len(opens):
                break
            at, open_, c = int(opens[k]), True, failures
            f = int(times[at])
            at += 1
        else:
            j = max(int(np.searchsorted(times, f + cooldown)), at)
            counts[at : j + 1], opened[at : j + 1], since[at : j + 1] = c, True, f
            if j == m:
                break
            at = j + 1
            if good[j]:
                open_ = False
                continue
            c, f = c + 1, int(times[j])
        counts[at], opened[at], since[at] = c, True, f
    place = np.cumsum(known)  # state after each event
    before = place - known
    admitted = ~opened[before] | (t - since[before] >= cooldown)
    return admitted, counts[place], opened[place], since[place]


def passed(events: DataFrame, key: str, failures: int, cooldown: int, width: int) -> DataFrame:
    """From events (key, t, n, ok): key, n, t, ok, admitted, count, open, since (of open circuits the time of the last failure).

    Events are cut into bins of ``width``, each a group. A row a bin tells what it does to any state; a key's rows are gone
    through in order for the states that its bins begin with, and with these the bins give their rows.
    """
    kind = events.schema[key].dataType
    rows = events.select(F.col(key).alias("_key"), F.floor(F.col("t") / width).alias("_bin"), F.col("t").cast("long").alias("t"), F.col("n").cast("long").alias("n"), F.col("ok").cast("boolean").alias("ok"))
    bins = rows.groupBy("_key", "_bin")
    head = [T.StructField("_key", kind), T.StructField("_bin", T.LongType())]
    many = [T.StructField("kind", T.ArrayType(T.ByteType())), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("count", "since", "upto"))]
    begun = T.StructType([*head, T.StructField("_open", T.BooleanType()), T.StructField("_count", T.LongType()), T.StructField("_since", T.LongType())])
    told = bins.applyInArrow(_told(failures, cooldown), T.StructType([*head, *many]))
    starts = told.groupBy("_key").applyInArrow(_starts(failures, cooldown), begun)
    shape = "n long, t long, ok boolean, admitted boolean, count long, open boolean, since long"
    out = bins.cogroup(starts.groupBy("_key", "_bin")).applyInArrow(_rows(failures, cooldown), T.StructType([head[0], *T._parse_datatype_string(shape).fields]))
    return out.withColumnRenamed("_key", key)


def _told(failures: int, cooldown: int) -> Callable[[pa.Table], pa.Table]:
    def told(table: pa.Table) -> pa.Table:
        _, t, ok = _sorted(table)
        out = summary(t[ok >= 0], ok[ok >= 0] == 1, failures, cooldown)
        first = table.select(["_key", "_bin"]).slice(0, 1)
        for name, values, of in zip(("kind", "count", "since", "upto"), out, (pa.int8(), pa.int64(), pa.int64(), pa.int64()), strict=True):
            first = first.append_column(name, pa.array([values], pa.list_(of)))
        return first

    return told


def _starts(failures: int, cooldown: int) -> Callable[[pa.Table], pa.Table]:
    def states(table: pa.Table) -> Iterator[tuple[bool, int, int]]:
        open_, c, f = False, 0, 0
        for row in zip(*(table.column(x) for x in ("kind", "count", "since", "upto")), strict=True):
            yield open_, c, f
            kinds, counts, times, upto = (x.values for x in row)
            i = failures + bisect_left(_Longs(upto), f + cooldown) if open_ else c
            kind, count, since = kinds[i].as_py(), counts[i].as_py(), times[i].as_py()
            if kind != SAME:
                open_, c, f = kind != CLOSED, count + (c if kind == MORE else 0), since

    def starts(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_bin", "ascending")])
        if table.column("_bin").null_count:  # what is not timed comes first
            table = pa.concat_tables([table.slice(len(table) - 1), table.slice(0, len(table) - 1)])
        found = list(states(table))
        out = table.select(["_key", "_bin"])
        for i, (name, of) in enumerate((("_open", pa.bool_()), ("_count", pa.int64()), ("_since", pa.int64()))):
            out = out.append_column(name, pa.array([x[i] for x in found], of))
        return out

    return starts


class _Longs:
    """An Arrow array that can be searched where it is."""

    def __init__(self, values: pa.Array):
        self.values = values

    def __len__(self) -> int:
        return len(self.values)

    def __getitem__(self, i: int) -> int:
        return self.values[i].as_py()


def _rows(failures: int, cooldown: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def rows(table: pa.Table, start: pa.Table) -> pa.Table:
        order, t, ok = _sorted(table)
        state = tuple(start.column(c)[0].as_py() for c in ("_open", "_count", "_since"))
        out = table.select(["_key", "n", "t", "ok"]).take(pa.array(order))
        for name, values in zip(("admitted", "count", "open", "since"), replay(t, ok, state, failures, cooldown), strict=True):
            out = out.append_column(name, pa.array(values))
        return out

    return rows
