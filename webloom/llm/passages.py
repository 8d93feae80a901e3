"""Passages that repeat across documents: a suffix sort that goes no deeper than the threshold.

Every suffix is ordered by its first ``length`` bytes only, in passes from the most significant digit on,
and leaves the sort as soon as its group holds it alone: equal groups at the end are exactly the repeated
windows. The first digit is the window's minimizer, the least hash of its grams, since windows side by side
mostly share it: a run of windows with one minimizer travels as one string (a super-window), and a digit that
only one document has ends the sort for all its windows at once. The other digits are eight bytes each.

Documents are dealt into blocks. A block first sends its minimizers to the shards that own them, and hears
which repeat; then it sends the super-windows of those, and hears for each of their windows the smallest
document that holds it. A minimizer found in very many blocks is dealt by whole windows instead, so that a
passage that a third of all documents share, with other surroundings in each, is spread over all shards.
Equal texts are settled beforehand: only the one with the smallest id is sorted.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import durable, packed, parts_for, strings, text_bytes
from webloom.llm.near import stirred

#: Null ids are larger than any other.
NO_ID = np.iinfo(np.int64).max
#: What a block sends of a super-window, and hears of some of its windows. ref: where its
#: string first stands in the block. low, high: the ids that hold it in the block. hot: a window of a hot minimizer.
RECORD = np.dtype([("key", "<u8"), ("ref", "<u4"), ("windows", "<u2"), ("hot", "u1"), ("low", "<i8"), ("high", "<i8")])
RUN = np.dtype([("ref", "<u4"), ("first", "<u2"), ("last", "<u2"), ("hot", "u1"), ("low", "<i8")])
COPIES, REPEATED, RUNS = range(3)
#: Bits of a minimizer that tell it from others, and the flag beside them.
KEY_BITS, HOT = 48, np.uint64(1 << 63)


@dataclass(frozen=True)
class Settings:
    """length: bytes of a window. gram: bytes of a minimizer. longest: windows of a super-window. hot_blocks: a minimizer in
    more blocks than this is dealt by windows. slice_bytes: text that is hashed at a time."""

    length: int = 50
    gram: int = 20
    longest: int = 32
    hot_blocks: int = 64
    block_bytes: int = 4 << 20
    slice_bytes: int = 256 << 10

    @property
    def digits(self) -> int:
        return -(-(self.length + self.longest) // 8)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each position on, by doubling."""
    power = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
    out, done, width, bit = None, 0, 1, gram
    while bit:
        if bit & 1:
            n = len(data) - gram + 1
            part = power[done : done + n]
            out = part.copy() if out is None else (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + part
            done += width
        bit >>= 1
        if bit:
            power = (power[:-width] ^ (power[:-width] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + power[width:]
            width *= 2
    return stirred(out, 3)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, done = x, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


@dataclass
class Windows:
    """The super-windows of some texts: each one's minimizer, text, first byte in ``data`` and number of windows."""

    data: np.ndarray
    starts: np.ndarray  # of the texts in data
    key: np.ndarray
    text: np.ndarray
    at: np.ndarray
    count: np.ndarray


def super_windows(texts: list[bytes], s: Settings) -> Windows:
    """Of texts that are long enough for one window at least."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts) + bytes(8 * s.digits + 8), np.uint8)
    starts, parts = np.r_[0, np.cumsum(sizes)], []
    i = 0
    while i < len(texts):  # hashed in slices of whole texts
        j = i + 1
        while j < len(texts) and starts[j + 1] - starts[i] <= s.slice_bytes:
            j += 1
        own = data[starts[i] : starts[j]]
        least = sliding_min(gram_hashes(own, s.gram), s.length - s.gram + 1) >> np.uint64(64 - KEY_BITS)
        text = np.repeat(np.arange(i, j), sizes[i:j])[: len(least)]
        at = np.arange(len(least))
        good = at + starts[i] + s.length <= starts[text + 1]
        least, text, at = least[good], text[good], at[good]
        new = np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])]
        begin = np.flatnonzero(new)
        within = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
        begin = np.flatnonzero(within % s.longest == 0)
        parts.append((least[begin], text[begin], at[begin] + starts[i], np.diff(np.r_[begin, len(at)])))
        i = j
    key, text, at, count = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, t) for t in (np.uint64, int, int, int))
    return Windows(data, starts, key, text, at, count)


def squeezed(records: np.ndarray) -> bytes:
    """Records field by field, deflated: what a shuffle writes is mostly super-windows."""
    return zlib.compress(b"".join(records[f].tobytes() for f in records.dtype.names), 1)


def unsqueezed(data: bytes, dtype: np.dtype) -> np.ndarray:
    data, at = zlib.decompress(data), 0
    out = np.empty(len(data) // dtype.itemsize, dtype)
    for f in dtype.names:
        own = np.frombuffer(data, dtype[f], len(out), at)
        out[f] = own
        at += own.nbytes
    return out


def eight_bytes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number whose order is theirs."""
    return np.lib.stride_tricks.sliding_window_view(data, 8)[at].view(">u8")[:, 0].astype(np.uint64)


def first_bytes(n: np.ndarray) -> np.ndarray:
    """A mask of the first n of eight bytes."""
    n = np.clip(n, 0, 8)
    return np.where(n > 0, ~np.uint64(0) << (np.uint64(8) * (np.uint64(8) - np.maximum(n, 1).astype(np.uint64))), np.uint64(0))


def radix_groups(first: np.ndarray, digit: Callable[[np.ndarray, int], np.ndarray], depth: int) -> np.ndarray:
    """Groups of equal strings, by passes from the most significant digit on; a row that is alone leaves the sort."""
    _, group = np.unique(first, return_inverse=True)
    active, used = np.arange(len(first)), int(group.max(initial=-1)) + 1
    for d in range(depth):
        active = active[np.bincount(group[active], minlength=used)[group[active]] > 1]
        if not len(active):
            break
        own, g = digit(active, d), group[active]
        order = np.lexsort((own, g))
        own, g = own[order], g[order]
        new_g = np.r_[True, g[1:] != g[:-1]]
        split = np.r_[False, own[1:] != own[:-1]] & ~new_g
        # The first part of a group keeps its number; each further part gets a new one.
        number = np.where(new_g, g, -1)
        number[split] = used + np.arange(split.sum())
        last = np.maximum.accumulate(np.where(new_g | split, np.arange(len(g)), 0))
        group[active[order]] = number[last]
        used += int(split.sum())
    return np.unique(group, return_inverse=True)[1]


def string_groups(data: np.ndarray, key: np.ndarray, at: np.ndarray, count: np.ndarray, s: Settings) -> np.ndarray:
    """Groups of super-windows of one minimizer, number of windows and string."""
    size = count + s.length - 1
    digit = lambda rows, d: eight_bytes(data, at[rows] + 8 * d) & first_bytes(size[rows] - 8 * d)
    return radix_groups(key * np.uint64(s.longest + 1) + count.astype(np.uint64), digit, s.digits)


def window_groups(data: np.ndarray, key: np.ndarray, at: np.ndarray, s: Settings) -> np.ndarray:
    """Groups of windows of one minimizer and string."""
    rest = lambda rows, d: eight_bytes(data, at[rows] + 8 * d) & first_bytes(np.full(len(rows), s.length - 8 * d))
    return radix_groups(key, rest, -(-s.length // 8))


def expanded(at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of each super-window: its super-window, its number in it, its first byte."""
    owner = np.repeat(np.arange(len(at)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return owner, number, at[owner] + number


@dataclass
class Block:
    """The texts of a block that are sorted: distinct, long enough, not copies of a smaller id's; in an order that is always the same."""

    ids: np.ndarray
    windows: Windows
    place: dict[tuple[int, bytes], int]  # of an id and text, among the sorted texts
    copied: set[tuple[int, int]]  # id and hash of texts that a smaller id has
    rows: list[tuple[int | None, bytes]]

    @classmethod
    def of(cls, docs: pa.Table, messages: pa.Table, s: Settings) -> Block:
        copies = messages.filter(pa.compute.equal(messages["kind"], COPIES))
        copied = set(zip(copies["id"].to_pylist(), copies["hash"].to_pylist(), strict=True))
        rows = [(i, t.encode("utf-8", "surrogatepass")) for i, t in zip(docs["id"].to_pylist(), strings(docs["text"]), strict=True)]
        numbered = {(NO_ID if i is None else i, t) for i, t in rows if len(t) >= s.length}
        sorted_ = sorted(x for x in numbered if (x[0], text_hash(x[1])) not in copied)
        return cls(np.array([i for i, _ in sorted_], np.int64), super_windows([t for _, t in sorted_], s), {x: k for k, x in enumerate(sorted_)}, copied, rows)

    def candidates(self, cold: np.ndarray, hot: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
        """Of the minimizers asked for, super-windows (of hot ones: windows): key, text, first byte, number of windows, group of equal ones; and how many, at the end, are of hot ones."""
        w = self.windows
        own, wide = np.isin(w.key, cold), np.flatnonzero(np.isin(w.key, hot))
        owner, _, at = expanded(w.at[wide], w.count[wide])
        mixed = np.zeros(len(at), np.uint64)
        for d in range(-(-s.length // 8)):
            mixed = stirred(mixed ^ (eight_bytes(w.data, at + 8 * d) & first_bytes(np.full(len(at), s.length - 8 * d))), d)
        key = np.r_[w.key[own], mixed >> np.uint64(64 - KEY_BITS)]
        text = np.r_[w.text[own], w.text[wide][owner]]
        at, count = np.r_[w.at[own], at], np.r_[w.count[own], np.ones(len(owner), int)]
        return key, text, at, count, string_groups(w.data, key, at, count, s), len(owner)


def text_hash(text: bytes) -> int:
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(text, 42)
    return h - (1 << 64) if h >> 63 else h


def cut_by(shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted shard numbers: where each begins, and where it ends."""
    begin = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, int)
    return begin, np.r_[begin[1:], len(shard)].astype(int)[: len(begin)]


def sender(shards: int, s: Settings):
    """A block's minimizers: once if one of its documents has it, twice if more do."""

    def send(key: tuple, docs: pa.Table, messages: pa.Table) -> pa.Table:
        w = Block.of(docs, messages, s).windows
        order = np.lexsort((w.text, w.key))
        k, t = w.key[order], w.text[order]
        new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
        other = ~new & np.r_[False, t[1:] != t[:-1]] if len(k) else new
        found = np.r_[k[new], np.unique(k[other])]
        shard = found % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        found, shard = found[order], shard[order]
        begin, end = cut_by(shard)
        six = found.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]
        return pa.table({
            "shard": pa.array(shard[begin].astype(np.int32)),
            "block": pa.array([block_of(docs, messages)] * len(begin), pa.int32()),
            "payload": pa.array([six[a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary()),
        })

    return send


def block_of(docs: pa.Table, messages: pa.Table) -> int:
    return (docs if len(docs) else messages)["block"][0].as_py()


def counter(s: Settings):
    """Which of each block's minimizers repeat; the flag is set for those of very many blocks."""

    def count(rows: pa.Table) -> pa.Table:
        sent = []
        for x in rows["payload"]:
            six = np.frombuffer(x.as_py(), np.uint8).reshape(-1, KEY_BITS // 8)
            sent.append(np.pad(six, ((0, 0), (0, 8 - KEY_BITS // 8))).view("<u8")[:, 0])
        _, at, n = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        n, out, done = n[at], [], 0
        for own in sent:
            times = n[done : done + len(own)]
            done += len(own)
            out.append(np.unique(own[times > 1] | np.where(times[times > 1] > s.hot_blocks, HOT, np.uint64(0))).tobytes())
        return messages_of(rows["block"], REPEATED, out)

    return count


def messages_of(blocks: pa.ChunkedArray, kind: int, payloads: list[bytes]) -> pa.Table:
    n = len(payloads)
    return pa.table({"block": blocks.cast(pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "payload": pa.array(payloads, pa.binary()), "id": pa.nulls(n, pa.int64()), "hash": pa.nulls(n, pa.int64())})


MESSAGE = "block int, kind int, payload binary, id long, hash long"


def heard(messages: pa.Table, kind: int, dtype) -> np.ndarray:
    own = packed(messages.filter(pa.compute.equal(messages["kind"], kind))["payload"], dtype)
    return np.concatenate(own) if own else np.zeros(0, dtype)


def stringer(shards: int, s: Settings):
    """A block's distinct super-windows of repeated minimizers."""

    def send(key: tuple, docs: pa.Table, messages: pa.Table) -> pa.Table:
        block = Block.of(docs, messages, s)
        known = heard(messages, REPEATED, np.dtype("<u8"))
        hot = (known & HOT) > 0
        k, text, at, count, group, wide = block.candidates(known[~hot], known[hot] ^ HOT, s)
        n = int(group.max(initial=-1)) + 1
        low, high, first = np.full(n, NO_ID), np.full(n, np.iinfo(np.int64).min), np.full(n, len(block.windows.data))
        np.minimum.at(low, group, block.ids[text])
        np.maximum.at(high, group, block.ids[text])
        np.minimum.at(first, group, at)
        one = np.flatnonzero(at == first[group])
        one = one[np.unique(group[one], return_index=True)[1]]
        record = np.zeros(n, RECORD)
        record["key"], record["ref"], record["windows"], record["low"], record["high"] = k[one], first, count[one], low, high
        record["hot"] = one >= len(k) - wide
        order = np.argsort(record["key"] % np.uint64(shards), kind="stable")
        record = record[order]
        size = record["windows"].astype(int) + s.length - 1
        ends = np.cumsum(size)
        flat = np.arange(ends[-1] if n else 0) - np.repeat(ends - size, size) + np.repeat(record["ref"].astype(int), size)
        blob = block.windows.data[flat]
        begin, end = cut_by(record["key"] % np.uint64(shards))
        return pa.table({
            "shard": pa.array((record["key"][begin] % np.uint64(shards)).astype(np.int32)),
            "block": pa.array([block_of(docs, messages)] * len(begin), pa.int32()),
            "payload": pa.array([squeezed(record[a:b]) for a, b in zip(begin, end, strict=True)], pa.binary()),
            "strings": pa.array([zlib.compress(blob[(ends - size)[a] : ends[b - 1]].tobytes(), 1) for a, b in zip(begin, end, strict=True)], pa.binary()),
        })

    return send


def sorter(s: Settings):
    """For each block's super-windows, the windows that a smaller document than its largest holds, in runs."""

    def sort(rows: pa.Table) -> pa.Table:
        sent = [unsqueezed(x.as_py(), RECORD) for x in rows["payload"]]
        record = np.concatenate(sent)
        data = np.frombuffer(b"".join(zlib.decompress(x.as_py()) for x in rows["strings"]) + bytes(8 * s.digits + 8), np.uint8)
        count = record["windows"].astype(int)
        size = count + s.length - 1
        at = np.cumsum(size) - size
        group = string_groups(data, record["key"], at, count, s)
        n = int(group.max()) + 1
        low = np.full(n, NO_ID)
        np.minimum.at(low, group, record["low"])
        _, one = np.unique(group, return_index=True)
        # Minimizers of several strings: their windows are sorted. The others' windows all have the string's smallest document.
        _, of, strings_ = np.unique(record["key"][one], return_inverse=True, return_counts=True)
        several = strings_[of] > 1
        wide = np.flatnonzero(several)
        owner, _, where = expanded(at[one][wide], count[one][wide])
        same = window_groups(data, of[wide][owner], where, s)
        least = np.full(int(same.max(initial=-1)) + 1, NO_ID)
        np.minimum.at(least, same, low[wide][owner])
        begin = np.zeros(n, int)
        begin[wide] = np.cumsum(count[one][wide]) - count[one][wide]
        by_window = least[same]

        out, done = [], 0
        for own in sent:
            g, c = group[done : done + len(own)], count[done : done + len(own)]
            done += len(own)
            narrow = ~several[g] & (low[g] < own["high"])
            runs = np.zeros(int(narrow.sum()), RUN)
            runs["ref"], runs["last"], runs["hot"], runs["low"] = own["ref"][narrow], c[narrow], own["hot"][narrow], low[g[narrow]]
            many = np.flatnonzero(several[g])
            owner, number, place = expanded(begin[g[many]], c[many])
            value = by_window[place]
            new = np.r_[True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])] if len(owner) else np.zeros(0, bool)
            a = np.flatnonzero(new)
            b = np.r_[a[1:], len(owner)][: len(a)] - 1
            more = np.zeros(len(a), RUN)
            more["ref"], more["first"], more["last"], more["hot"], more["low"] = own["ref"][many][owner[a]], number[a], number[b] + 1, own["hot"][many][owner[a]], value[a]
            out.append(runs.tobytes() + more[value[a] < own["high"][many][owner[a]]].tobytes())
        return messages_of(rows["block"], RUNS, out)

    return sort


def remover(s: Settings, with_spans: bool):
    def remove(key: tuple, docs: pa.Table, messages: pa.Table) -> pa.Table:
        block = Block.of(docs, messages, s)
        w, runs = block.windows, heard(messages, RUNS, RUN)
        edge = np.zeros(len(w.data) + 1, np.int64)
        for hot in (0, 1):
            mine = runs[runs["hot"] == hot]
            if not len(mine):
                continue
            # The candidates again, of the minimizers that these runs speak of. A hot window's is that of the super-window over it.
            keys = np.unique(w.key[np.searchsorted(w.at, mine["ref"], side="right") - 1])
            _, text, at, _, group, _ = block.candidates(*((keys[:0], keys) if hot else (keys, keys[:0])), s)
            order = np.lexsort((at, group))
            begin, end = cut_by(group[order])
            firsts = at[order][begin]
            sort = np.argsort(firsts)
            g = sort[np.searchsorted(firsts[sort], mine["ref"])]
            owner, number, _ = expanded(np.zeros(len(g), int), (end - begin)[g])
            who = order[begin[g][owner] + number]
            hit = block.ids[text[who]] > mine["low"][owner]
            who, owner = who[hit], owner[hit]
            np.add.at(edge, at[who] + mine["first"][owner], 1)
            np.add.at(edge, at[who] + mine["last"][owner].astype(int) + s.length - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        for i, t in block.rows:
            place = block.place.get((NO_ID if i is None else i, t))
            if place is not None:
                own = gone[w.starts[place] : w.starts[place + 1]]
                turn = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
                spans = list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))
                kept = np.frombuffer(t, np.uint8)[~own].tobytes() if spans else t
            else:
                spans = [(0, len(t))] if len(t) >= s.length else []  # a copy of a smaller id's text
                kept = b"" if spans else t
            for name, x in zip(out, (len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans]), strict=True):
                out[name].append(x)
        table = {"doc_id": docs["id"], **{k: pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")}, "kept_sha256": pa.array(out["kept_sha256"], pa.string())}
        if with_spans:
            table["spans"] = pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.table(table)

    return remove


def remove_passages(docs: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", with_spans: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, with_spans also spans (start, end in bytes).

    A byte is removed if a ``length``-byte string over it also starts in a document with a smaller id. A null
    text is empty; texts shorter than that lose nothing. A null id is larger than any other, and rows that
    share an id, repeated rows too, do not count against each other. An empty table gives an empty result.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    blocks = parts_for(text_bytes(texts), s.block_bytes)
    shards = max(blocks, 32)
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))

    long_ = dealt.filter(F.octet_length("text") >= s.length).select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "block", F.xxhash64("text").alias("hash"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    same = durable(long_)
    low = same.groupBy("sha").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = durable(same.join(low, "sha").filter("id > low").select("block", F.lit(COPIES).alias("kind"), F.lit(None).cast("binary").alias("payload"), "id", "hash"))

    by = dealt.groupBy("block")
    sent = by.cogroup(copies.groupBy("block")).applyInArrow(sender(shards, s), "shard int, block int, payload binary")
    repeated = sent.groupBy("shard").applyInArrow(counter(s), MESSAGE)
    supers = by.cogroup(copies.unionByName(repeated).groupBy("block")).applyInArrow(stringer(shards, s), "shard int, block int, payload binary, strings binary")
    runs = supers.groupBy("shard").applyInArrow(sorter(s), MESSAGE)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<start:long,end:long>>" * with_spans
    return by.cogroup(copies.unionByName(runs).groupBy("block")).applyInArrow(remover(s, with_spans), schema)


#: The same rows in DuckDB's SQL, on texts as hexadecimal digits.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
w AS (SELECT r, doc_id, p, substr(hx, 2 * p + 1, 100) AS k
      FROM (SELECT r, doc_id, hx, unnest(range(length(hx) // 2 - 49)) AS p FROM d WHERE length(hx) >= 100)),
low AS (SELECT k, min(doc_id) AS first_id FROM w GROUP BY k),
gone AS (SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) AS far FROM w JOIN low USING (k) WHERE first_id < doc_id),
numbered AS (SELECT r, p, sum(CASE WHEN far <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS span FROM gone),
spans AS (SELECT r, span, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY r, span),
sums AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY r),
edges AS (SELECT r, a AS upto, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM spans
          UNION ALL SELECT d.r, length(hx) // 2, coalesce(max(b), 0) FROM d LEFT JOIN spans USING (r) GROUP BY d.r, hx),
kept AS (SELECT r, string_agg(substr(hx, 2 * since + 1, 2 * (upto - since)), '' ORDER BY since) AS hx FROM edges JOIN d USING (r) GROUP BY r)
SELECT d.doc_id, (length(d.hx) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.hx)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN sums USING (r)
"""
