"""Line dedup by sharded minimal perfect hashes.

A block of documents sends, for each shard of the hash space, its distinct line hashes with the number
of documents and the largest id that hold them. A shard builds a minimal perfect hash over its distinct
hashes, gathers counts and largest ids in arrays by its index, and keeps a fingerprint beside them.
Blocks probe the arrays with their own hashes, and learn which of their lines are too common. Only
hashes travel; a line that a third of all documents hold comes once from each block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import LOWER_BYTES, SPACE, packed, parts_for, strings, text_bytes, tidy

#: What a block tells of a line, and what it hears. first and second: halves of the line's 128-bit hash.
SENT = np.dtype([("first", "<u8"), ("second", "<u8"), ("docs", "<u4"), ("last", "<i8")])
HEARD = np.dtype([("first", "<u8"), ("second", "<u8"), ("last", "<i8")])
#: Stands for a null id: such a row is never the last holder if another is.
NO_ID = np.iinfo(np.int64).min


def line_key(line: str) -> str:
    """The line without white space at both ends, before A to Z are lower-cased."""
    return line.strip(SPACE)


def key_hash(key: str) -> tuple[int, int]:
    both = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass").translate(LOWER_BYTES))
    return both >> 64, both & 0xFFFFFFFFFFFFFFFF


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Another 64-bit hash of each 64-bit hash."""
    x = x + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys.

    Levels of bits: a key owns the place it hashes to if no other key left does; the rest go to the next
    level. Its index is the number of owned places before its own.
    """

    def __init__(self, keys: np.ndarray, spare: float = 1.6):
        self.levels, self.size, left = [], len(keys), keys
        before = 0
        while len(left):
            width = max(64, int(spare * len(left)))
            at = (mixed(left, len(self.levels)) % np.uint64(width)).astype(np.int64)
            owned = np.bincount(at, minlength=width) == 1
            self.levels.append((owned, before + np.cumsum(owned) - owned))
            before += int(owned.sum())
            left = left[~owned[at]]

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Of keys it was built over, their places; of others, -1 or any place."""
        found, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (owned, rank) in enumerate(self.levels):
            at = (mixed(keys[open_], level) % np.uint64(len(owned))).astype(np.int64)
            hit = owned[at]
            found[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return found


def block_lines(ids: list, texts: list[str], least: int) -> np.ndarray:
    """The distinct keys of a block with the number of documents and the largest id that hold each."""
    held: dict[tuple[int, int], list] = {}
    for doc, text in zip(ids, texts, strict=True):
        doc = NO_ID if doc is None else doc
        for key in {key_hash(k) for line in text.split("\n") if len(k := line_key(line)) >= least}:
            got = held.setdefault(key, [0, NO_ID])
            got[0], got[1] = got[0] + 1, max(got[1], doc)
    return np.array([(*k, v[0], v[1]) for k, v in held.items()], SENT)


def sender(least: int, shards: int):
    def send(key: tuple, rows: pa.Table) -> pa.Table:
        found = block_lines(rows["id"].to_pylist(), strings(rows["text"]), least)
        shard = (found["first"] >> np.uint64(32)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        found, shard = found[order], shard[order]
        tidy()
        cuts = np.flatnonzero(np.diff(shard, prepend=-1 if not len(shard) else shard[0] + np.uint64(1)))
        return pa.table({
            "shard": pa.array(shard[cuts].astype(np.int32)),
            "block": pa.array([key[0].as_py()] * len(cuts), pa.int32()),
            "payload": pa.array([x.tobytes() for x in np.split(found, cuts[1:])][: len(cuts)], pa.binary()),
        })

    return send


def server(least_docs: int):
    def serve(rows: pa.Table) -> pa.Table:
        blocks = packed(rows["payload"], SENT)
        sent = np.concatenate(blocks)
        # The perfect hash goes by the first half; the few keys that share it with another keep a table of their own.
        first, at = np.unique(sent["first"], return_index=True)
        index = PerfectHash(first)
        fingerprint = np.zeros(len(first), np.uint64)
        fingerprint[index.index(first)] = sent["second"][at]
        place = index.index(sent["first"])
        own = fingerprint[place] == sent["second"]
        docs, last = np.zeros(len(first), np.int64), np.full(len(first), NO_ID)
        np.add.at(docs, place[own], sent["docs"][own].astype(np.int64))
        np.maximum.at(last, place[own], sent["last"][own])
        rest: dict[tuple[int, int], list[int]] = {}
        for x in sent[~own]:
            got = rest.setdefault((int(x["first"]), int(x["second"])), [0, NO_ID])
            got[0], got[1] = got[0] + int(x["docs"]), max(got[1], int(x["last"]))
        out = []
        for probe in blocks:
            place = index.index(probe["first"])
            own = fingerprint[place] == probe["second"]
            hit = own & (docs[place] >= least_docs)
            heard = np.empty(int(hit.sum()), HEARD)
            heard["first"], heard["second"], heard["last"] = probe["first"][hit], probe["second"][hit], last[place[hit]]
            more = [(*k, rest[k][1]) for x in probe[~own] if rest[k := (int(x["first"]), int(x["second"]))][0] >= least_docs]
            out.append((heard.tobytes() + np.array(more, HEARD).tobytes()) if more else heard.tobytes())
        tidy()
        return pa.table({"block": rows["block"].cast(pa.int32()), "payload": pa.array(out, pa.binary())})

    return serve


def cleaner(least: int, with_text: bool):
    def clean(docs: pa.Table, heard: pa.Table) -> pa.Table:
        common = {(int(a), int(b)): int(c) for x in packed(heard["payload"], HEARD) for a, b, c in x}
        ids, total, dropped, digests, kept = docs["id"].to_pylist(), [], [], [], []
        for doc, text in zip(ids, strings(docs["text"]), strict=True):
            lines = text.split("\n")
            doc = NO_ID if doc is None else doc
            stay = [x for x in lines if len(k := line_key(x)) < least or common.get(key_hash(k), doc) == doc] if common else lines
            total.append(len(lines))
            dropped.append(len(lines) - len(stay))
            out = text if len(stay) == len(lines) else "\n".join(stay)
            digests.append(hashlib.sha256(out.encode("utf-8", "surrogatepass")).hexdigest())
            kept.append(out)
        out = {"doc_id": docs["id"], "n_lines": pa.array(total, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        if with_text:
            out |= {"kept_text": pa.array(kept, pa.string())} | {c: docs[c] for c in docs.column_names if c not in ("id", "text", "block")}
        tidy()
        return pa.table(out)

    return clean


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, block_bytes: int = 12 << 20) -> DataFrame:
    """Drop lines that at least ``least_docs`` documents hold, except in the holder with the largest id.

    Returns doc_id, n_lines, n_dropped, kept_sha256; with ``carry`` (other columns to keep; may be empty)
    also kept_text and those columns, under names that begin with carried_. A null text is one empty line.
    Each row counts as a document, repeated rows too; rows that share the largest id all keep the line. A
    null id is smaller than any other. An empty table gives an empty result.
    """
    with_text = carry is not None
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(f"carried_{c}") for c in carry or ()))
    blocks = parts_for(text_bytes(own), block_bytes)
    dealt = own.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    shards = max(blocks, 32)
    sent = dealt.select("id", "text", "block").groupBy("block").applyInArrow(sender(least_chars, shards), "shard int, block int, payload binary")
    heard = sent.groupBy("shard").applyInArrow(server(least_docs), "block int, payload binary")
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    if with_text:
        kinds = {f.name: f.dataType.simpleString() for f in own.schema}
        schema += ", kept_text string" + "".join(f", `carried_{c}` {kinds[f'carried_{c}']}" for c in carry)
    return dealt.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(cleaner(least_chars, with_text), schema)


#: The same rows in DuckDB's SQL.
ORACLE = """
WITH lines AS (
  SELECT doc_id, rowid_ AS r, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS last_id FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT r) >= 3),
marked AS (
  SELECT k.*, (c.key IS NOT NULL AND k.doc_id <> c.last_id) AS gone FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, r
"""
