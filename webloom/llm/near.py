"""Near duplicates by MinHash: SuperMinHash signatures, banding, verification on full sets, union-find.

A document is the set of its word shingles; documents of equal sets are one node from the start. In
SuperMinHash every element has one random permutation of the places, and its value at a place is the
permutation's rank there plus a fraction: ranks of one element differ from place to place, which lowers the
variance, and once every place holds a value below the next rank, no element can improve one (early stop).
Places are cut into bands; nodes that agree in a band share a bucket. In a bucket, nodes are tied to leaders
by the likeness of one-byte sketches: whoever resembles no leader by NEAR becomes one, and all are tied to
every leader they resemble by ``Settings.far``. What sketches lack in likeness is a distance, so two nodes
whose sketches show their link are tied to a common leader. The ties' components, each in one task or, if large,
in tiles of bounded pieces, are compared on full sets; the links found are united by union-find.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import LOWER_BYTES, durable, parts_for, tidy, utf8
from webloom.llm.graphs import components, unite

#: A leader covers nodes that resemble it this much.
NEAR = 0.8
#: Nodes with the places they are compared in that are broadcast at most; more are joined by shuffling.
BROADCAST_ROWS = 250_000


@dataclass(frozen=True)
class Settings:
    """Link: 100 * intersection >= percent * union. With 24 bands of 4 places, a pair at 0.80 fails to meet once in 300,000."""

    words: int = 3
    percent: int = 85
    bands: int = 24
    places: int = 4
    bucket_rows: int = 4096
    tile_shingles: int = 400_000

    @property
    def length(self) -> int:
        return self.bands * self.places

    @property
    def far(self) -> float:
        """How much nodes resemble the leaders they are tied to. If a leader covers one of two linked nodes and their sketches
        are as like as the link asks for, the other resembles it by NEAR + link - 1; four usual errors of a sketch are granted."""
        link = self.percent / 100
        return NEAR + link - 1 - 4 * (link * (1 - link) / self.length) ** 0.5


def stirred(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mix (splitmix) of each 64-bit number, other for each salt."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * (2 * salt + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(data: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text, A to Z lower-cased; of fewer words, of them all as one."""
    # bytes.split() parts at space and 09 to 0D, nothing else
    h = np.array(list(map(xxhash.xxh3_64_intdigest, data.translate(LOWER_BYTES).split())), np.uint64)
    n = len(h)
    if n < words:
        return stirred(np.array([int(stirred(np.bitwise_xor.reduce([stirred(h[i : i + 1], i) for i in range(n)]), n)[0])], np.uint64), 77) if n else h
    out = h[: n - words + 1].copy()
    for k in range(1, words):
        out = stirred(out, k) + h[k : n - words + 1 + k]
    return np.unique(stirred(out, words))


def node_of(own: np.ndarray) -> int:
    """The number that stands for a set."""
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(elements: np.ndarray, doc: np.ndarray, docs: int, m: int) -> np.ndarray:
    """SuperMinHash: for each document, m values of 64 bits, rank in the upper byte and fraction below. doc: each element's document."""
    sig = np.full(docs * m, np.iinfo(np.uint64).max, np.uint64)
    perm = None
    for rank in range(m):
        draw = stirred(elements, 1000 + rank)
        pick = (rank + (draw >> np.uint64(33)) % np.uint64(m - rank)).astype(np.int64)
        value = (np.uint64(rank) << np.uint64(56)) | (stirred(draw, 5) >> np.uint64(8))
        if perm is None:
            place = pick
        else:
            row = np.arange(len(elements))
            place = perm[row, pick].astype(np.int64)
            perm[row, pick] = perm[row, rank]
            perm[row, rank] = place
        np.minimum.at(sig, doc * m + place, value)
        # Early stop: a later rank is larger than every value that such a document has.
        open_ = (sig.reshape(docs, m) >= np.uint64(rank + 1 << 56)).any(1) if rank + 1 < m else np.zeros(docs, bool)
        go = open_[doc]
        if not go.any():
            break
        if perm is None:
            elements, doc, pick = elements[go], doc[go], pick[go]
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(elements), 1))
            perm[np.arange(len(elements)), pick] = 0
            perm[:, 0] = pick
        elif not go.all():
            elements, doc, perm = elements[go], doc[go], perm[go]
    return sig.reshape(docs, m)


def signer(s: Settings, together: int = 50_000):
    def flush(waiting: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = [len(x) for x in waiting]
        sig = signatures(np.concatenate(waiting), np.repeat(np.arange(len(sizes)), sizes), len(sizes), s.length)
        bands = np.zeros((len(sizes), s.bands), np.uint64)
        for b in range(s.bands):
            key = np.full(len(sizes), b, np.uint64)
            for p in range(s.places):
                key = stirred(key ^ sig[:, b * s.places + p], 2000 + p)
            bands[:, b] = key
        return bands, (stirred(sig, 9) >> np.uint64(56)).astype(np.uint8)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            sizes, nodes, bands, sketches, waiting, where, held = [], [], [None] * batch.num_rows, [None] * batch.num_rows, [], [], 0

            def empty_out():
                if waiting:
                    b, k = flush(waiting)
                    for j, i in enumerate(where):
                        bands[i], sketches[i] = b[j].view(np.int64).tolist(), k[j].tobytes()
                waiting.clear()
                where.clear()

            for i, data in enumerate(utf8(batch.column("text"))):
                own = shingles(data, s.words)
                sizes.append(len(own))
                nodes.append(node_of(own))
                if len(own):
                    waiting.append(own)
                    where.append(i)
                    held += len(own)
                    if held >= together:
                        empty_out()
                        held = 0
            empty_out()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=["doc_id", "row", "n", "node", "bands", "sketch"],
            )
        tidy()

    return sign


def tied(keys: np.ndarray, nodes: np.ndarray, sketches: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(node, leader) for rows sorted by bucket, a leader that has others with it included. All buckets take their first,
    second, ... leader in step."""
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(keys)]))
    uncovered, rows, out = np.ones(len(keys), bool), np.arange(len(keys)), []
    while uncovered.any():
        left = np.flatnonzero(uncovered)
        first = left[np.r_[True, group[left][1:] != group[left][:-1]]]
        leader = np.full(len(start), -1)
        leader[group[first]] = first
        mine = leader[group]
        asked = rows[mine >= 0]
        like = (np.mean(sketches[asked] == sketches[mine[asked]], axis=1) - 1 / 256) / (1 - 1 / 256)
        tie = asked[(like >= least) & (asked != mine[asked])]
        own = np.unique(mine[tie])
        out.append((nodes[np.r_[tie, own]], nodes[np.r_[mine[tie], own]]))
        uncovered[asked[like >= NEAR]] = False
        uncovered[first] = False
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def tier(least: float):
    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ties of rows sorted by bucket and tile; a bucket that goes on in the next batch waits for it."""
        rest = None
        for batch in batches:
            whole = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            k, t = whole["key"].to_numpy(), whole["tile"].to_numpy()
            if not len(k):
                continue
            cut = int(np.flatnonzero((k != k[-1]) | (t != t[-1]))[-1]) + 1 if ((k != k[-1]) | (t != t[-1])).any() else 0
            rest = whole.slice(cut)
            if cut:
                yield _ties(whole.slice(0, cut), least)
        if rest is not None and rest.num_rows:
            yield _ties(rest, least)
        tidy()

    return tie


def _ties(rows: pa.Table, least: float) -> pa.RecordBatch:
    k, t = rows["key"].to_numpy(), rows["tile"].to_numpy()
    keys = np.cumsum(np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])])
    sketches = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(len(k), -1)
    a, b = tied(keys, rows["node"].to_numpy(), sketches, least)
    a, b = unite(a, b) if len(a) else (a, b)  # a tie for each node at most
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def setter(s: Settings):
    """The full sets of the nodes asked for, from the texts of documents that stand for them."""

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            own = [shingles(x, s.words) for x in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("places"), pa.array([x.tobytes() for x in own], pa.binary())], names=["node", "places", "set"])
        tidy()

    return give


def linker(percent: int):
    """Links of a tile: each node of the first piece with each other node (its own piece's or, if there are two, the second's)."""

    def link(rows: pa.Table) -> pa.Table:
        nodes, at = np.unique(rows["node"].to_numpy(), return_index=True)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows["set"].combine_chunks().take(pa.array(at))]
        sizes = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        element, ids = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(ids, kind="stable")
        posted, ends = owner[order], np.cumsum(np.bincount(ids, minlength=len(element)))
        starts = np.r_[0, ends[:-1]]
        begin = np.r_[0, np.cumsum(sizes)]
        label = np.arange(len(sets))
        edges_a, edges_b = [], []
        for i in range(len(sets)):
            if (label == label[i]).all():
                break
            # Nodes before i have met it already; of those behind, only ones not yet united with it count.
            own = ids[begin[i] : begin[i + 1]]
            own = own[ends[own] - starts[own] > 1]
            if not len(own):
                continue
            met = np.bincount(np.concatenate([posted[starts[t] : ends[t]] for t in own]), minlength=len(sets))
            hit = np.flatnonzero((100 * met >= percent * (sizes + sizes[i] - met)) & (label != label[i]))
            for j in hit:
                if label[j] != label[i]:
                    edges_a.append(nodes[i])
                    edges_b.append(nodes[j])
                    low, high = min(label[i], label[j]), max(label[i], label[j])
                    label[label == high] = low
        del sets, owner, element, ids, order, posted
        tidy()
        return pa.table([pa.array(edges_a, pa.int64()), pa.array(edges_b, pa.int64())], names=["a", "b"])

    return link


def pieces(count: str, most: int) -> F.Column:
    return F.ceil(F.col(count) / most).cast("int")


def tiles(piece: str, of: str) -> F.Column:
    """The tiles of a piece: its pairs with each piece, the larger number first."""
    other = F.sequence(F.lit(0), F.col(of) - 1)
    return F.transform(other, lambda o: F.greatest(F.col(piece), o) * F.col(of) + F.least(F.col(piece), o))


def row_of(text: Column | str) -> Column:
    """What tells rows that share an id apart: their texts."""
    return F.md5(F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit("")).cast("binary"))


def group_near(docs: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", with_rows: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; with_rows also row (``row_of`` its text) and kept_row,
    which of each component holds for the rows of one id and text only: the smallest, null ids last.

    A null text is empty. Texts without words are linked with nothing, each its own component; so are rows
    with a null id and no id to be reached. Repeated rows are one node: each copy is returned, and all with
    the component's id are kept. An empty table gives an empty result.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("row", row_of("text"))
    signed = durable(texts.mapInArrow(signer(s), "doc_id long, row string, n long, node long, bands array<long>, sketch binary"))
    full = signed.filter("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    lows = durable(full.groupBy("node").agg(first.alias("low"), F.max("n").alias("n")))

    # Buckets of two nodes and more, cut into pieces of bounded size; pieces meet in tiles.
    banded = durable(full.dropDuplicates(["node"]).select("node", F.explode("bands").alias("key")))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("of")).filter("of > 1").select("key", pieces("of", s.bucket_rows).alias("of"))
    members = banded.join(buckets, "key").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    members = members.select("key", "node", F.explode(tiles("piece", "of")).alias("tile"))
    sketches = full.groupBy("node").agg(F.first("sketch").alias("sketch"))
    sorted_ = members.join(sketches, "node").repartition("key", "tile").sortWithinPartitions("key", "tile", "node")
    groups = durable(components(durable(sorted_.mapInArrow(tier(s.far), "a long, b long"))))

    # Full sets of the tied nodes, each from one document; groups too large for a task meet in tiles as well.
    sized = groups.join(lows, "node")
    many = sized.groupBy("component").agg(F.sum("n").alias("of")).select("component", pieces("of", s.tile_shingles).alias("of"))
    placed = sized.join(many, "component").withColumn("piece", F.pmod(F.xxhash64("node", F.lit(1)), F.col("of")).cast("int"))
    place = F.transform(tiles("piece", "of"), lambda t: F.struct(F.col("component").alias("group"), t.alias("tile")))
    asked = durable(placed.select("node", place.alias("places"), F.col("low.doc_id").alias("_id"), F.col("low.row").alias("_row")))
    small = asked.count() <= BROADCAST_ROWS
    stand_in = texts.join(F.broadcast(asked) if small else asked, texts["doc_id"].eqNullSafe(asked["_id"]) & (texts["row"] == asked["_row"]))
    stand_in = stand_in.select("node", "places", "text").dropDuplicates(["node"])  # rows may repeat
    sets = stand_in.mapInArrow(setter(s), "node long, places array<struct<group: long, tile: int>>, set binary").select(F.explode("places").alias("at"), "node", "set")
    # Written down before they are united, so that a task has one Python worker and not two.
    links = durable(sets.groupBy("at.group", "at.tile").applyInArrow(linker(s.percent), "a long, b long"))
    linked = components(links)

    least = linked.join(lows, "node").groupBy("component").agg(F.min("low").alias("least"))
    reached = linked.join(least, "component").select("node", "least")
    single = lows.join(reached, "node", "left").select("node", F.coalesce("least", "low").alias("least"))
    out = full.select("doc_id", "row", "n", "node").join(single, "node").select("doc_id", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), "row", F.col("least.row").alias("_first"))
    empty = signed.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "row", F.col("row").alias("_first"))
    same = F.col("doc_id").eqNullSafe(F.col("component_id"))
    whole = out.unionByName(empty).withColumn("kept", same)
    return whole.withColumn("kept_row", same & (F.col("row") == F.col("_first"))).drop("_first") if with_rows else whole.drop("row", "_first")


#: The same rows in DuckDB's SQL: all pairs that share a shingle are counted.
ORACLE = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.y),
low AS (SELECT reach.x AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.y GROUP BY reach.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN low USING (r) LEFT JOIN n USING (r)
"""
