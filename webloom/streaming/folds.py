"""State over time: circuit breaker, rate limiter, cache. The twins in ``processors`` do the same on streams.

The limiter has a closed form, a running maximum. The breaker and the cache are folds: a key's events, in the
order of time and number, are passed through with a state. They are cut into bins of time, of which each tells what it
does to any state (``jumps``), so no task has a key's whole past.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import rules
from webloom.operators import asof
from webloom.streaming import jumps

#: Microseconds: the usual length of a bin of events.
DAY = 86_400_000_000


def _bin(cooldown: int) -> int:
    """Bins of many cooldowns: of each, what happens in the first is kept for every state it may be entered with."""
    return max(32 * cooldown, 3_600_000_000)


def success(ok: Column, results: Column) -> Column:
    """What an outcome means for health: true, false, or null for an empty answer, which changes nothing."""
    return F.when(~ok, False).when(results > 0, True)



def breaker(events: DataFrame, key: str = "backend", failures: int = rules.BREAKER_FAILURES, cooldown: int = rules.BREAKER_COOLDOWN, width: int | None = None) -> DataFrame:
    """From events (key, t, n, ok: true, false or null): key, n, t, admitted, failures_after, open_after, ok.

    A call is skipped while the circuit is open and the last failure is less than ``cooldown`` ago; then calls
    are admitted again, until one fails, which opens it anew, or succeeds, which closes it. ``width`` is the length of a bin.
    """
    rows = jumps.passed(events, key, failures, cooldown, width or _bin(cooldown))
    return rows.select(key, "n", "t", "admitted", F.col("count").cast("int").alias("failures_after"), F.col("open").alias("open_after"), "ok")


def with_retries(events: DataFrame) -> DataFrame:
    """Outcomes (t, n, ok, transient, retry_ok) as health events: a transient failure and then its one retry; others once.
    sub tells the two apart."""
    retry = ~F.col("ok") & F.col("transient")
    pair = F.when(retry, F.array(F.struct(F.lit(0).alias("sub"), F.lit(False).alias("h")), F.struct(F.lit(1).alias("sub"), F.col("retry_ok").alias("h")))).otherwise(F.array(F.struct(F.lit(0).alias("sub"), F.col("ok").alias("h"))))
    others = [c for c in events.columns if c not in ("ok", "transient", "retry_ok")]
    return events.select(*others, F.explode(pair).alias("_p")).select(*others, "_p.sub", F.col("_p.h").alias("ok"))


def limiter(events: DataFrame, key: str, period: int, burst: int, width: int = DAY) -> DataFrame:
    """From events (key, t, n): key, n, t, admitted_at: calls wait, none is refused. ``burst`` calls may come at once, one each ``period`` after.

    Each call moves the time from which the key owes nothing to the later of it and the call, plus a period; so
    before the call of number i that time is i periods and the largest t - j periods of the calls j before it.
    """
    own = events.select(key, "n", "t", F.floor(F.col("t") / width).alias("_bin"))
    order = Window.partitionBy(key, "_bin").orderBy("t", "n")
    counts = own.groupBy(key, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    past = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(key, "_bin", F.coalesce(F.sum("_c").over(past), F.lit(0)).alias("_base"))
    placed = _joined(own, base, key).withColumn("_i", F.col("_base") + F.row_number().over(order) - 1).drop("_base")
    owed = F.col("t") - F.col("_i") * period
    most = placed.groupBy(key, "_bin").agg(F.max(owed).alias("_m"))
    carried = most.select(key, "_bin", F.max("_m").over(past).alias("_carry"))
    within = F.max(owed).over(order.rowsBetween(Window.unboundedPreceding, -1))
    before = F.greatest(within, F.col("_carry")) + F.col("_i") * period  # of what there is: greatest leaves nulls out
    at = F.greatest("t", F.coalesce(before - (burst - 1) * period, F.col("t")))
    return _joined(placed, carried, key).withColumn("admitted_at", at).select(key, F.col("n").cast("long").alias("n"), "t", "admitted_at")


def _joined(rows: DataFrame, bins: DataFrame, key: str) -> DataFrame:
    """Rows with what is known of their key's bin; null keys are keys too."""
    of = bins.withColumnRenamed(key, "_key").withColumnRenamed("_bin", "_of")
    return rows.join(of, rows[key].eqNullSafe(of["_key"]) & (rows["_bin"] == of["_of"])).drop("_key", "_of")


def search_key(query: Column, region: Column, safe: Column) -> Column:
    """The number of results and the time range are no part of it."""
    return F.concat(F.lit("search:"), F.lower(query), F.lit(":"), region, F.lit(":"), safe)


def page_key(url: Column, selector: Column) -> Column:
    return F.concat(F.lit("page:"), url, F.coalesce(F.concat(F.lit(":"), selector), F.lit("")))


def cache(events: DataFrame, key: str = "key", ttl: int = rules.CACHE_TTL, enabled: bool = True, width: int | None = None) -> DataFrame:
    """From requests (key, t, n): key, n, t, hit, stored_at. An entry lives for ``ttl`` from when it was stored, whatever reads it;
    a miss stores. Without ``enabled`` nothing is stored. It is a circuit that every admitted call opens: hits are those skipped."""
    if not enabled:
        return events.select(key, F.col("n").cast("long").alias("n"), "t", F.lit(False).alias("hit"), F.lit(None).cast("long").alias("stored_at"))
    rows = jumps.passed(events.withColumn("ok", F.lit(False)), key, 1, ttl, width or _bin(ttl))
    timed = F.col("t").isNotNull()  # requests without a time meet and leave nothing
    return rows.select(key, "n", "t", (~F.col("admitted") & timed).alias("hit"), F.when(timed, F.col("since")).alias("stored_at"))


def looked_up(requests: DataFrame, entries: DataFrame, key: str = "key", ttl: int = rules.CACHE_TTL) -> DataFrame:
    """Requests (key, t) against stored entries (key, stored_at): add stored_at, that of the newest entry not after the request,
    and hit, whether it is alive then. A key may have many entries; one stored after a request does not count for it."""
    return asof.alive(requests, entries, key, "t", "stored_at", ttl)


def split_by_cache(requests: DataFrame, entries: DataFrame, key: str = "key", ttl: int = rules.CACHE_TTL) -> tuple[DataFrame, DataFrame]:
    """Requests that an entry alive answers, with its columns as ``entry``, and those that have to be run."""
    found = asof.last_before(requests, entries, key, "t", "stored_at", ttl)
    alive = F.coalesce(F.col("t") - F.col("entry.stored_at") < ttl, F.lit(False))
    return found.filter(alive), found.filter(~alive).drop("entry")


def open_stretches(trace: DataFrame, key: str = "backend", cooldown: int = rules.BREAKER_COOLDOWN) -> DataFrame:
    """When circuits are open, from the breaker's rows (key, t, admitted, ok, open_after): key, open_from, open_until. A failure that
    leaves a circuit open skips all calls for ``cooldown``, so stretches of a key do not overlap."""
    failed = F.col("admitted") & ~F.col("ok") & F.col("open_after")
    return trace.filter(failed).select(key, F.col("t").alias("open_from"), (F.col("t") + cooldown).alias("open_until"))


def cache_stats(entries: DataFrame, as_of: int, ttl: int = rules.CACHE_TTL, capacity: int = rules.CACHE_ENTRIES, enabled: bool = True) -> DataFrame:
    """search_entries, page_entries, enabled, line: entries (key, stored_at) alive at a time, at most ``capacity`` of each kind."""
    alive = (F.lit(as_of) - F.col("stored_at") < ttl) & (F.col("stored_at") <= as_of)
    live = entries.filter(alive).select("key").distinct()
    n = lambda prefix: F.least(F.count_if(F.col("key").startswith(prefix)), F.lit(capacity)).cast("long")
    out = live.agg(n("search:").alias("search_entries"), n("page:").alias("page_entries")).withColumn("enabled", F.lit(enabled))
    line = F.format_string("Cache Stats: %d search entries, %d page entries (enabled: %s)", "search_entries", "page_entries", F.col("enabled").cast("string"))
    return out.withColumn("line", line)


def streaks(events: DataFrame, key: str = "backend", width: int = DAY) -> DataFrame:
    """Add streak: failures in a row up to each event (key, t, n, ok), without skips; an unknown outcome is a failure.

    Streaks are counted within bins of ``width``; one that goes on from earlier bins has their ends added, which come from a
    row for each key and bin.
    """
    binned = events.withColumn("_bin", F.floor(F.col("t") / width))
    good, bad = F.when(F.col("ok"), 1).otherwise(0), F.when(F.col("ok"), 0).otherwise(1)
    order = Window.partitionBy(key, "_bin").orderBy("t", "n")
    own = binned.withColumn("_i", F.sum(good).over(order)).withColumn("_own", F.sum(bad).over(Window.partitionBy(key, "_bin", "_i").orderBy("t", "n")))
    ends = own.groupBy(key, "_bin").agg(F.max_by("_own", F.struct("t", "n")).alias("_end"), F.max(good).alias("_broken"))
    bins = Window.partitionBy(key).orderBy("_bin")
    ends = ends.withColumn("_run", F.sum("_broken").over(bins)).withColumn("_sum", F.sum("_end").over(Window.partitionBy(key, "_run").orderBy("_bin")))
    carried = ends.select(key, "_bin", F.coalesce(F.lag("_sum").over(bins), F.lit(0)).alias("_carry"))
    streak = F.col("_own") + F.when(F.col("_i") == 0, F.col("_carry")).otherwise(0)
    return _joined(own, carried, key).withColumn("streak", streak.cast("long")).select(*events.columns, "streak")


def pruned(sources: DataFrame, health: DataFrame, as_of: int, cooldown: int = rules.BREAKER_COOLDOWN) -> DataFrame:
    """Sources (source, available) that may be asked: available, and their circuit (source, is_open, last_failure) not open within
    its cooldown; sources of unknown health may."""
    state = sources.join(health, "source", "left")
    closed = ~F.coalesce(F.col("is_open"), F.lit(False)) | (F.lit(as_of) - F.col("last_failure") >= cooldown)
    return state.filter(F.col("available") & F.coalesce(closed, F.lit(True))).select(*sources.columns)
