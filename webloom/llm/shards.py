"""Sharding by sampled splitters, with DataFrame functions only.

Records have a 64-bit key whose high part tells the group (equal texts) and whose low part the record.
A sample in which a record's chance is its size gives quantiles of the key, weighed by size; they bound
many small ranges. A boundary inside a group moves to the group's start, unless the group is so large
that several quantiles fall into it: that overfull group is subdivided. Sizes of the ranges, a few
numbers each, give every range its place in the whole; windows inside a range do the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import durable, numbered, unit

#: Low bits of the key, which tell the records of a group apart.
LOW = 24


def group_key(text: Column | str, *record: Column | str) -> Column:
    """Equal texts are neighbours in the order of this key; the high bits are those of ``text``, its hash."""
    return F.shiftleft(F.shiftright(text, LOW), LOW) + F.shiftrightunsigned(F.xxhash64(F.lit("record"), *record), 64 - LOW)


def bucket_of(value: str, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the value, by bisection."""
    steps = max(1, len(bounds).bit_length())
    array = F.expr("array(" + ", ".join(f"{b}L" if b > -(1 << 63) else "(-9223372036854775807L - 1L)" for b in bounds) + ")")
    halves = F.expr("array(" + ", ".join(str(1 << i) for i in reversed(range(steps))) + ")")
    # The value goes along in the state: Catalyst overlooks columns that only a lambda's body names.
    def step(state: Column, half: Column) -> Column:
        further = (state["at"] + half <= len(bounds)) & (F.get(array, state["at"] + half - 1) <= state["v"])
        return F.struct(F.when(further, state["at"] + half).otherwise(state["at"]).alias("at"), state["v"].alias("v"))

    return F.aggregate(halves, F.struct(F.lit(0).alias("at"), F.col(value).alias("v")), step, lambda state: state["at"])


def splitters(quantiles: list[int]) -> list[int]:
    """Boundaries at the starts of groups; inside a group only where two quantiles fall into it."""
    found, last = set(), None
    for q in sorted(quantiles):
        group = q >> LOW
        found.add(q if group == last else group << LOW)
        last = group
    return sorted(found)


def assign_shards(rows: DataFrame, shards: int = 40, key: str = "key", size: str = "size", ties: tuple[str, ...] = ("doc_id",), ranges_per_shard: int = 64, sample_per_range: int = 24, seed: str = "splitters") -> DataFrame:
    """Add shard (0 to shards - 1) and slot (gapless from 0 in each shard), sizes near equal.

    rows needs the long columns ``key`` and ``size`` (over 0, not null); all its columns stay. Records are
    put in the order of key and ``ties``; equal in all of them are interchangeable. Null keys come first.
    An empty table gives an empty result. The driver holds the splitters only: shards x ranges_per_shard
    numbers.
    """
    rows = durable(rows)
    total = rows.agg(F.sum(size).cast("long"), F.count(F.lit(1))).first()
    if not total[1]:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    parts = shards * ranges_per_shard
    chance = F.col(size) * (parts * sample_per_range / total[0])
    sample = rows.filter(unit(F.lit(seed), key, *ties) < chance)
    cuts = sample.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    bounds = splitters(cuts or [0])
    ranged = rows.withColumn("_range", bucket_of(key, bounds)).withColumn("_group", F.shiftright(key, LOW))

    whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    places = ranged.groupBy("_range").agg(F.sum(size).cast("long").alias("_s"), F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_s").over(whole), F.lit(0)).alias("_bytes_before"), F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_rows_before")
    )
    order = Window.partitionBy("_range").orderBy(key, *ties)
    piece = Window.partitionBy("_range", "_group")
    at = (
        ranged.withColumn("_row", F.row_number().over(order).cast("long") - 1)
        .withColumn("_before", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size))
        .withColumns({"_start": F.min("_before").over(piece), "_piece": F.sum(size).over(piece)})
        .join(F.broadcast(places), "_range")  # a row for each range
    )
    middle = 2 * (F.col("_bytes_before") + F.col("_start")) + F.col("_piece")
    at = at.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * total[0]))).cast("int")).withColumn("_place", F.col("_rows_before") + F.col("_row"))
    first = at.groupBy("shard").agg(F.min("_place").alias("_first"))
    return at.join(F.broadcast(first), "shard").withColumn("slot", F.col("_place") - F.col("_first")).select(*rows.columns, "shard", "slot")


def placed_documents(docs: DataFrame, shards: int, doc_id: str, text: str, carry: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each document, and the columns of ``carry``, whose names must be other ones."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(whole) + 16).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(whole).alias("_hash"),
        *carry,
    )
    rows = numbered(rows, ["doc_id", "_hash"], "_copy").withColumn("key", group_key(F.col("_hash"), "doc_id", "_copy")).drop("_hash", "_copy")
    return assign_shards(rows, shards, ties=("doc_id", "text_crc32", "size"))


def shard_documents(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ``bytes``, shard, slot and grown_shard (null) of each document.

    A null text has size 16 and the checksum of no bytes. Equal texts share a shard unless their sizes
    together fill more than a range (a 64th of a shard's share). Repeated rows are records of their own, with a
    slot each; null ids come first among equal texts.
    """
    placed = placed_documents(docs, shards, doc_id, text)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the documents, all their columns and slot, as one folder for each shard, in the order of slots.

    Shards and slots are those of ``shard_documents``, for null texts and ids and for repeated rows too: rows alike in id
    and text share their slots among them in any order. Columns of docs named shard or slot are left out. An empty table
    gives a folder without shards.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot"))).alias("_all")
    placed = placed_documents(docs, shards, doc_id, text, (whole,)).select("_all.*", "shard", "slot")
    pieces = F.floor(F.col("slot") / 65536)
    placed.repartition("shard", pieces).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
