"""Mixing sources to target weights, with DataFrame functions only on the rows.

Each source's documents are dealt into blocks by a hash, which permutes them. Blocks are drawn in that
order, whole passes first, until the source's target is met; the last block gives as many documents as
fit. How many blocks of each source an output shard gets is decided by a splitting tree: a node's exact
quotas, one number a source, are divided between its halves by a multivariate hypergeometric draw. The
shards then take disjoint runs of each source's permuted blocks and shuffle them locally.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import WORD, durable, numbered, parts_for, text_bytes

#: A controlled vocabulary: the driver holds a row for each source, never more than this.
MAX_SOURCES = 100_000
#: Text that a piece of the shuffled mix holds, over all shards.
PIECE_BYTES = 64 << 20


def reshared(sizes: list[int], weights: list[int], share: Fraction, most: int) -> list[float]:
    """Targets by weight; what is above ``most`` times a source's size goes to the others, by weight."""
    whole, capped = share * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = whole - most * sum(sizes[i] for i in capped)
        weight = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] > most * sizes[i] * weight}
        if not over:
            break
        capped |= over
    return [float(most * sizes[i]) if i in capped else float(left * weights[i] / weight) for i in range(len(sizes))]


def split(quota: np.ndarray, leaves: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The quotas of ``leaves`` shards, whose sum is ``quota``: each node draws its left half's blocks without replacement."""
    if leaves == 1:
        return [quota]
    left = leaves // 2
    size = int(quota.sum()) * left // leaves
    drawn, rest, need = np.zeros_like(quota), int(quota.sum()), size
    for i, n in enumerate(quota):  # marginals, one after another: exact for counts of any size
        rest -= int(n)
        drawn[i] = hypergeometric(rng, int(n), rest, need)
        need -= int(drawn[i])
    return split(drawn, left, rng) + split(quota - drawn, leaves - left, rng)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """numpy's draw. Counts beyond its range of 10^9 are drawn from the same law by inversion, around the mode."""
    if not good or not sample:
        return 0
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, sample))
    return inverted(rng, good, bad, sample)


def inverted(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """A hypergeometric draw: the law's values follow from the mode's by the ratios of neighbours. Those over 40 deviations
    from the mean are below what a double holds beside the mode's."""
    n = good + bad
    sd = (sample * (good / n) * (bad / n) * ((n - sample) / (n - 1))) ** 0.5
    mode = (sample + 1) * (good + 1) // (n + 2)
    low, high = max(0, sample - bad, mode - int(40 * sd) - 2), min(good, sample, mode + int(40 * sd) + 2)
    k = np.arange(low, high)
    steps = np.log((good - k) / (k + 1.0)) + np.log((sample - k) / (bad - sample + k + 1.0))
    logs = np.r_[0.0, np.cumsum(steps)]
    sums = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def running(rows: DataFrame, group: list[str], at: str, value: str, into: str, fan: int = 4096) -> DataFrame:
    """Add the sum of ``value`` over the rows of the group before this one, for a dense whole-numbered ``at``.

    In two levels, so that a group of any length is not one task: sums of runs of ``fan`` rows come first.
    """
    rows = rows.withColumn("_run", F.floor(F.col(at) / fan))
    before = Window.partitionBy(*group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy(*group, "_run").agg(F.sum(value).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*group, "_run").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(runs, [*group, "_run"]).withColumn(into, F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_run", "_base")


def mix(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2), most: int = 2, shards: int = 16, block_rows: int = 256, seed: int = 8, source: str = "source", size: str = "size", ties: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add source_size, target (the source's), copies (0 to ``most``) and mix_shards (a shard for each copy).

    Sources are ordered by code point, null last, and weigh ``weights`` in turn. rows needs a long column
    ``size`` (null counts as 0); all its columns stay. A source whose sizes are all 0 has target 0 and its
    documents are not taken. Repeated rows are drawn each on its own. An empty table gives an empty result.
    """
    keyed = durable(rows.withColumns({"_size": F.coalesce(F.col(size), F.lit(0)).cast("long"), "_h": F.xxhash64(F.lit(seed), source, *ties)}))
    found = keyed.groupBy(source).agg(F.sum("_size").alias("n"), F.count(F.lit(1)).alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    if not found:
        return rows.withColumns({"source_size": F.lit(0).cast("long"), "target": F.lit(0.0), "copies": F.lit(0), "mix_shards": F.array().cast("array<int>")})
    found = sorted(found, key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8", "surrogatepass")))
    sizes = [r["n"] for r in found]
    targets = reshared(sizes, [weights[i % len(weights)] for i in range(len(found))], share, most)
    passes = [int(t // n) if n else 0 for t, n in zip(targets, sizes, strict=True)]
    blocks = [max(1, -(-r["rows"] // block_rows)) for r in found]
    extra = [t - p * n for t, p, n in zip(targets, passes, sizes, strict=True)]
    kind = rows.schema[source].dataType.simpleString()
    plan = rows.sparkSession.createDataFrame(
        [(i, r[0], n, t, p, b, x) for i, (r, n, t, p, b, x) in enumerate(zip(found, sizes, targets, passes, blocks, extra, strict=True))],
        f"_ix int, _mix_source {kind}, source_size long, target double, _passes int, _blocks long, _extra double",
    )
    dealt = keyed.join(F.broadcast(plan), keyed[source].eqNullSafe(plan["_mix_source"])).drop("_mix_source")  # at most MAX_SOURCES rows
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64(F.lit("block"), "_h"), F.col("_blocks")))

    # The last pass ends where the extra words are reached: blocks in their order, then the documents of one block.
    sums = dealt.groupBy("_ix", "_block").agg(F.sum("_size").alias("_words"))
    placed = running(sums, ["_ix"], "_block", "_words", "_block_before").drop("_words")
    inner = Window.partitionBy("_ix", "_block").orderBy("_h", *ties, "_size").rowsBetween(Window.unboundedPreceding, 0)
    at = dealt.join(placed, ["_ix", "_block"]).withColumn("_before", F.col("_block_before") + F.sum("_size").over(inner) - F.col("_size"))
    more = (F.col("_size") > 0) & (F.col("_before") + F.col("_size") / 2 <= F.col("_extra"))
    at = at.withColumn("copies", F.least(F.lit(most), F.col("_passes") + more.cast("int")))

    drawn = placed.join(F.broadcast(plan), "_ix").filter(F.col("_block_before") < F.col("_extra")).groupBy("_ix").agg(F.max("_block").alias("last"))
    last = {r[0]: r[1] + 1 for r in drawn.collect()}  # a row for each source
    quota = np.array([passes[i] * blocks[i] + last.get(i, 0) for i in range(len(found))], np.int64)
    leaves = split(quota, shards, np.random.default_rng(seed))
    ends = np.cumsum(np.array(leaves), axis=0)  # by shard and source: its run of the source's drawn blocks ends here
    bounds = rows.sparkSession.createDataFrame([(i, [int(x) for x in ends[:, i]]) for i in range(len(found))], "_ix int, _ends array<long>")
    turn = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: k * F.col("_blocks") + F.col("_block"))
    shard = F.transform(turn, lambda t: F.least(F.lit(shards - 1), F.size(F.filter(F.col("_ends"), lambda e: e <= t))))
    return (
        at.join(F.broadcast(bounds), "_ix")
        .withColumn("mix_shards", F.when(F.col("copies") > 0, shard).otherwise(F.array().cast("array<int>")))
        .select(*rows.columns, "source_size", "target", "copies", "mix_shards")
    )


def words(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, mix_shards of each document; size counts its words, 0 for a null text.

    Repeated rows are drawn each on its own; documents that share an id, or have none, are as well. Null sources
    are one source, the last. A source without words has target 0. An empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"), F.xxhash64(text).alias("_text"))
    rows = numbered(rows, ["doc_id", "source", "_text"], "_copy")
    return mix(rows, ties=("doc_id", "_text", "_copy"), **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "mix_shards")


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 8, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, dealt to its shards and shuffled inside them.

    Returns docs' columns and mix_shard (which takes the place of one of that name). Rows alike in id, source and text are
    drawn together: each as often as the others. A null text has no words and is not taken, nor is any of a source without
    words. An empty table gives an empty result.
    """
    pieces = parts_for(text_bytes(docs, text), PIECE_BYTES)
    keyed = docs.select(F.struct(*docs.columns).alias("_all"), F.xxhash64(doc_id, source, text).alias("_row"), F.col(source).alias("_source"), words(text).alias("_words"))
    slim = keyed.groupBy("_row", "_source").agg(F.sum("_words").alias("_words"))
    taken = mix(slim, source="_source", size="_words", ties=("_row",), seed=seed, **options).filter("copies > 0").select("_row", "mix_shards")
    each = keyed.select("_all", "_row").join(taken, "_row").select("_all", "_row", F.posexplode("mix_shards").alias("_copy", "_shard"))
    shuffled = each.withColumn("_key", F.xxhash64(F.lit(seed), F.lit("shuffle"), "_row", "_copy"))
    dealt = shuffled.repartition("_shard", F.pmod(F.col("_key"), F.lit(pieces))).sortWithinPartitions("_shard", "_key")
    return dealt.select(*(F.col("_all")[c].alias(c) for c in docs.columns if c != "mix_shard"), F.col("_shard").alias("mix_shard"))
