"""Joins by time: the last entry before a moment, and the stretches that a moment lies in.

Both are cut into bins of time, so that a key's whole past is never one task's: within a bin rows are put in order; what
came before a bin is carried along, a row for each key and bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_before(moments: DataFrame, entries: DataFrame, key: str, at: str, since: str, width: int, into: str = "entry") -> DataFrame:
    """Moments (key, at and others) with ``into``, a struct of the other columns of the entry of their key with the largest
    ``since`` not after ``at``; null if there is none. Times are whole numbers.

    Of entries with one time the largest by their columns counts. Moments without key or time meet none; entries without
    are ignored. ``width`` is the length of a bin: a key's rows in one bin are ordered in one task. One shuffle by key and
    bin brings the rows together; a second table has the last entry of each key and bin that has any, and is joined by
    key and bin.
    """
    kept = [c for c in entries.columns if c != key]
    entry = F.struct(F.col(since).alias("_since"), F.struct(*kept).alias("_e"))
    none = F.lit(None).cast(moments.select(F.struct("*")).schema[0].dataType)
    given = entries.filter(F.col(key).isNotNull() & F.col(since).isNotNull()).select(F.col(key).alias("_key"), F.col(since).cast("long").alias("_t"), F.lit(0).alias("_side"), entry.alias("_entry"), none.alias("_m"))
    asked = moments.select(F.col(key).alias("_key"), F.col(at).cast("long").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(given.schema["_entry"].dataType).alias("_entry"), F.struct("*").alias("_m"))
    rows = given.unionByName(asked).withColumn("_bin", F.floor(F.col("_t") / width))
    within = Window.partitionBy("_key", "_bin").orderBy("_t", "_side", F.col("_entry").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_entry", F.last("_entry", ignorenulls=True).over(within)).filter("_side = 1")
    # What earlier bins end with: every bin that has entries names the next one that asks, so only those are in the chain.
    ends = given.withColumn("_bin", F.floor(F.col("_t") / width)).groupBy("_key", "_bin").agg(F.max("_entry").alias("_end"))
    bins = ends.unionByName(asked.filter("_key IS NOT NULL AND _t IS NOT NULL").select("_key", F.floor(F.col("_t") / width).alias("_bin")).distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType)))
    bins = bins.groupBy("_key", "_bin").agg(F.max("_end").alias("_end"))
    before = Window.partitionBy("_key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).filter("_carry IS NOT NULL").select("_key", "_bin", "_carry")
    found = rows.join(carried, ["_key", "_bin"], "left").withColumn("_entry", F.coalesce("_entry", "_carry"))
    return found.select("_m.*", F.col("_entry")["_e"].alias(into))


def within(moments: DataFrame, stretches: DataFrame, at: str, start: str, end: str, width: int, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of moments and the stretches [start, end) that they lie in: columns of both, whose names must differ but for ``on``.

    Stretches stand in every bin of ``width`` they touch, so a width of about their usual length gives two bins each; moments
    in one. The join is by bin (and ``on``), and Spark splits bins that many moments share.
    """
    first, last = F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)
    spread = stretches.filter(F.col(start) < F.col(end)).withColumn("_bin", F.explode(F.sequence(first, last)))
    binned = moments.withColumn("_bin", F.floor(F.col(at) / width))
    return binned.join(spread, ["_bin", *on]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin")


def alive(moments: DataFrame, entries: DataFrame, key: str, at: str, since: str, ttl: int) -> DataFrame:
    """Moments with stored_at, the time of the newest entry of their key that is not after them, and hit: whether it is younger than ``ttl``."""
    found = last_before(moments, entries.select(key, F.col(since).alias("_stored")), key, at, "_stored", ttl, "_found")
    stored: Column = F.col("_found._stored")
    return found.withColumns({"stored_at": stored.cast("long"), "hit": F.coalesce(F.col(at) - stored < ttl, F.lit(False))}).drop("_found")
