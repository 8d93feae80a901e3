"""Prefix trie of conversations, by prefix doubling: no conversation and no node is ever gathered in one place.

Turns get dense names by their digests. Blocks of 2, 4, 8, ... turns, at places that are multiples of their length, are
named from the names of their halves, a join a round. A prefix of d turns is then the binary decomposition of d: the blocks
of its ones, longest first, so prefixes are named from a shorter prefix and one block, again a join a round. Equal prefixes
of one depth have equal names, so nodes are groups of names. Sums over subtrees double their reach in the same way; only
nodes of two members or more need them, as the rest of the trie is chains.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from webloom.llm.common import durable, tidy

#: Conversations, by their rank, whose ids are put into one text before a node's ends are digested.
CHUNK = 256
NOTHING = hashlib.sha256(b"").hexdigest()


def _offset(placed: DataFrame, starts: list[tuple[int, int]], local: str, into: str) -> DataFrame:
    """``into`` is ``local``, a number in its partition, and what the partition starts with."""
    offsets = placed.sparkSession.createDataFrame(starts, "_part int, _base long")  # a row a partition
    return placed.join(F.broadcast(offsets), "_part").withColumn(into, F.col("_base") + F.col(local)).drop("_part", "_base", local)


def ranked(rows: DataFrame, by: list[Column | str], into: str) -> DataFrame:
    """The rows with their rank from 0 in an order. They are dealt out by ranges of it, so that no group is one task's."""
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = durable(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    starts, base = [], 0
    for r in sorted(placed.groupBy("_part").agg((F.max("_at") + 1).alias("n")).collect()):
        starts.append((r["_part"], base))
        base += r.n
    return _offset(placed, starts, "_at", into)


def _counted(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Add _part and _at, which counts the distinct keys of a sorted partition from 0."""
    part, at, last = TaskContext.get().partitionId(), -1, None
    for b in batches:
        if not b.num_rows:
            continue
        own = [b.column(k) for k in keys]
        new = np.zeros(b.num_rows, bool)
        new[0] = tuple(c[0].as_py() for c in own) != last
        for c in own:
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        place = at + np.cumsum(new)
        at, last = int(place[-1]), tuple(c[-1].as_py() for c in own)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(place, pa.int64())], names=[*b.schema.names, "_part", "_at"])


def dense_names(rows: DataFrame, keys: list[str], unique: list[str], into: str = "name") -> DataFrame:
    """The rows with a name for their keys: the dense rank of the keys, from 0. ``unique`` tells rows of equal keys apart.

    Rows are sorted by ranges of keys and of what tells them apart, so that keys that a third of all rows share fill many
    partitions. A partition counts its own keys; the driver holds a row a partition, to see whether one goes on in the next.
    """
    dealt = rows.repartitionByRange(*keys, *unique).sortWithinPartitions(*keys, *unique)
    placed = durable(dealt.mapInArrow(partial(_counted, keys=keys), StructType([*rows.schema.fields, StructField("_part", IntegerType()), StructField("_at", LongType())])))
    key = F.struct(*keys)
    starts, base, last = [], 0, None
    for r in sorted(placed.groupBy("_part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max("_at").alias("n")).collect(), key=lambda r: r["_part"]):
        base -= r.first == last
        starts.append((r["_part"], base))
        base, last = base + r.n + 1, r.last
    return _offset(placed, starts, "_at", into).drop(*keys)


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 0), digest of role and text, bytes of the text: turns in the order of turn, null first, then of role and text.

    Rows without conv_id belong to no conversation and are left out. A null role or text is an empty one.
    """
    role, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), said.alias("said"))
    slim = own.select(
        "conv", "turn", "role",
        F.sha2(F.col("said").cast("binary"), 256).alias("text"),
        F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", F.col("said")).cast("binary"), 256).alias("digest"),
        F.octet_length("said").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"),
    )
    # The row comes last, to deal out rows that repeat without end; their order among themselves means nothing.
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text", "row"]
    at = ranked(slim, order, "rank").select("conv", "rank", "digest", "bytes")
    first = at.groupBy("conv").agg(F.min("rank").alias("first"))
    return at.join(first, "conv").select("conv", (F.col("rank") - F.col("first")).alias("pos"), "digest", "bytes")


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, n) and their turns, rebuilt: the first h turns of the family's first conversation, then their own after h.

    h is the unsigned CRC-32 of the decimal id, modulo ``most``. A conversation whose family's first is absent begins with its own.
    """
    lengths = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h")
    convs = lengths.select("conv", "n", h, (F.col("conv") - F.col("conv") % family).alias("donor"))
    shared = lengths.select(F.col("conv").alias("donor"), F.col("n").alias("has"))
    convs = durable(convs.join(shared, "donor", "left").withColumn("taken", F.least("h", F.coalesce("has", F.lit(0)))))
    lent = turns.filter(F.col("pos") < most - 1).withColumnRenamed("conv", "donor")
    begun = convs.filter("taken > 0").select("conv", "donor", "h").join(lent, "donor").filter("pos < h").select("conv", "pos", "digest", "bytes")
    rest = turns.join(convs.select("conv", "h", "taken"), "conv").filter("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "bytes")
    total = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return convs.select("conv", total.cast("long").alias("n")), begun.unionByName(rest)


def paired(first: DataFrame, second: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """The inner join of two tables that each hold a key once at most: by, a of the first, b and bytes of the second.

    Both are dealt out once, as one table. (Plans of joins over joins square their estimated sizes with each round.)
    """
    none = F.lit(None).cast("long")
    both = first.select(*by, F.col(a).alias("a"), none.alias("b"), none.alias("bytes")).unionByName(second.select(*by, none.alias("a"), F.col(b).alias("b"), "bytes"))
    return both.groupBy(*by).agg(F.max("a").alias("a"), F.max("b").alias("b"), F.max("bytes").alias("bytes")).filter("a IS NOT NULL AND b IS NOT NULL")


def named_prefixes(turns: DataFrame, longest: int) -> DataFrame:
    """conv, depth, name, bytes (of the last turn) of every prefix: names are equal where depth and turns are."""
    level = dense_names(turns.withColumnRenamed("pos", "i"), ["digest"], ["conv", "i"])
    levels = [level]
    while longest >> len(levels):
        half = level.withColumns({"i": F.expr("i div 2"), "odd": F.expr("i % 2 = 1")})
        level = dense_names(paired(half.filter("NOT odd"), half.filter("odd"), ["conv", "i"], "name", "name"), ["a", "b"], ["conv", "i"])
        levels.append(level)
    done = None
    for j in reversed(range(len(levels))):
        # A prefix whose last one is bit j ends in a block of that length at an even place; with no other one, it is that block.
        ends = levels[j].filter("i % 2 = 0").select("conv", (F.col("i") * (1 << j)).alias("before"), "name", "bytes")
        found = ends.filter("before = 0").select("conv", F.lit(1 << j).cast("long").alias("depth"), "name", "bytes")
        if done is not None:
            pairs = paired(done.withColumnRenamed("depth", "before"), ends.filter("before > 0"), ["conv", "before"], "name", "name")
            more = dense_names(pairs.withColumn("at", F.col("before")), ["before", "a", "b"], ["conv"])
            found = found.unionByName(more.select("conv", (F.col("at") + (1 << j)).alias("depth"), "name", "bytes"))
        done = found if done is None else done.unionByName(found)
    return done


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's ids, whose chunks come in order: a running state and one chunk are all that is held."""
    key, state = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], names=["depth", "node", "long_ends"])
    for b in batches:
        for depth, node, ids in zip(*(b.column(c) for c in ("depth", "node", "ids")), strict=True):
            if (depth.as_py(), node.as_py()) != key:
                if key is not None:
                    yield out()
                key, state = (depth.as_py(), node.as_py()), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_py().encode())
    if key is not None:
        yield out()
    tidy()


def digested_ends(ends: DataFrame) -> DataFrame:
    """depth, node, ends_sha256 from the members that end at a node (depth, node, conv, rank).

    Ids are put together by ranges of rank, then digested range by range: by Spark where a node has one, else in order of the
    ranges, which stream through. A digest is a chain by its nature, so one node's ranges are one task's, an id at a time.
    """
    by = ["depth", "node"]
    chunks = ends.groupBy(*by, F.expr(f"rank div {CHUNK}").alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"))
    chunks = durable(chunks)
    counts = chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("ids").alias("ids"))
    long_ = chunks.join(counts.filter("n > 1").select(*by), by, "left_semi")
    streamed = long_.repartition(*by).sortWithinPartitions(*by, "chunk").select(*by, "ids").mapInArrow(_digests, "depth long, node long, long_ends string")
    return counts.filter("n = 1").select(*by, F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256")).unionByName(streamed.withColumnRenamed("long_ends", "ends_sha256"))


def prefix_trie(convs: DataFrame, turns: DataFrame, with_members: bool = False) -> DataFrame:
    """Nodes of the trie of conversations (conv, n) and their turns (conv, pos, digest, bytes); n may be 0.

    conv_id is a node's smallest member; with depth it tells a node from all others. ``with_members``: instead, conv, depth
    and conv_id of the node, for every prefix of every conversation but the empty one.
    """
    top = convs.agg(F.max("n"), F.min("conv"), F.count(F.lit(1))).first()
    longest, first, many = top[0] or 0, top[1], top[2]
    prefixes = durable(named_prefixes(turns, longest))
    nodes = prefixes.groupBy("depth", "name").agg(F.min("conv").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"))
    nodes = durable(nodes)
    at = durable(prefixes.join(nodes.select("depth", "name", "node"), ["depth", "name"]).select("conv", "depth", "node"))
    if with_members:
        return at.select("conv", "depth", F.col("node").alias("conv_id"))
    # Parents, by the smallest member's prefix that is one turn shorter.
    up = at.select(F.col("conv").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    found = nodes.drop("name").join(up, ["node", "depth"], "left").withColumn("parent", F.coalesce("parent", F.lit(first)))
    root = convs.sparkSession.createDataFrame([(0, first, many, 0, None)] if many else [], "depth long, node long, n_convs long, bytes long, parent long")
    found = durable(found.select(*root.columns).unionByName(root))
    kids = found.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("singles"))
    found = found.join(kids, ["depth", "node"], "left").na.fill(0, ["n_children", "singles"])
    # A node of one member begins a chain: one leaf, nothing saved. Sums are needed over the others alone.
    own = found.filter("n_convs > 1").select("depth", "node", (F.col("singles") + (F.col("n_children") == 0).cast("long")).alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    sums, reach = durable(own), 1
    deepest = sums.agg(F.max("depth")).first()[0] or 0
    while reach <= deepest:
        # Each node gives what it has summed up so far to the one ``reach`` above it.
        above = at.select(F.col("conv").alias("node"), (F.col("depth") + reach).alias("depth"), F.col("node").alias("to"))
        given = sums.filter(F.col("depth") >= reach).join(above, ["node", "depth"], "left").select((F.col("depth") - reach).alias("depth"), F.coalesce("to", F.lit(first)).alias("node"), "leaves", "saved")
        sums = durable(sums.unionByName(given).groupBy("depth", "node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        reach *= 2
    ordered = ranked(convs.select("conv", "n"), ["conv"], "rank")
    last = ordered.join(at.withColumnRenamed("depth", "n"), ["conv", "n"], "left").select(F.col("n").alias("depth"), F.coalesce("node", F.lit(first)).alias("node"), "conv", "rank")
    out = found.join(sums, ["depth", "node"], "left").join(digested_ends(last), ["depth", "node"], "left")
    return out.select(
        F.col("node").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"), "n_convs", "n_children",
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )


def trie_of_rebuilt(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations (conv_id, turn, role, text); see ``placed_turns`` and ``rebuilt``.

    Rows without conv_id are left out; null turns come first, ties are broken by role, then by the digest of the text, and
    rows that repeat are turns of their own. Without conversations there are no nodes, not even the root. No other column
    is read.
    """
    turns = durable(placed_turns(conversations))
    convs, made = rebuilt(turns)
    return prefix_trie(convs, made)


ORACLE = """WITH own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations WHERE conv_id IS NOT NULL),
  convs AS (SELECT c, n, xor(4294967295, list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda s, b: list_reduce(range(8), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)), xor(s, b)), 4294967295)) % 9 AS h, c - c % 5 AS donor FROM (SELECT c, count(*) AS n FROM own GROUP BY c)),
  whole AS (SELECT k.c, k.h, least(k.h, coalesce(d.n, 0)) AS taken FROM convs k LEFT JOIN convs d ON d.c = k.donor),
  made AS (SELECT k.c, o.pos, o.role, o.said FROM convs k JOIN own o ON o.c = k.donor AND o.pos < k.h UNION ALL SELECT o.c, o.pos - w.h + w.taken, o.role, o.said FROM own o JOIN whole w USING (c) WHERE o.pos >= w.h),
  seqs AS (SELECT k.c, coalesce(list({'r': m.role, 't': m.said} ORDER BY m.pos) FILTER (WHERE m.pos IS NOT NULL), []) AS s FROM convs k LEFT JOIN made m USING (c) GROUP BY k.c),
  prefixes AS (SELECT c, d, s[1:d] AS p, len(s) = d AS ends FROM seqs, range(0, (SELECT max(len(s)) + 1 FROM seqs)) AS t(d) WHERE d <= len(s)),
  nodes AS (SELECT p, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '') AS ends FROM prefixes GROUP BY p),
  linked AS (SELECT n.*, q.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.p[1:n.depth] = n.p) AS n_children FROM nodes n LEFT JOIN nodes q ON q.depth = n.depth - 1 AND q.p = n.p[1:n.depth - 1])
  SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, (count(*) FILTER (WHERE k.n_children = 0))::BIGINT AS n_leaves, (sum((k.n_convs - 1) * coalesce(strlen(k.p[k.depth].t), 0)))::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
  FROM linked n JOIN linked k ON k.depth >= n.depth AND k.p[1:n.depth] = n.p GROUP BY n.p, n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, n.ends"""
