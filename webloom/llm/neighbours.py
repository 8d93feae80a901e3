"""Approximate nearest neighbours by largest inner product: inverted lists with an adaptive dimension scan.

Vectors get one more component so that the nearest by distance is the largest by inner product: every vector
then has the length of the longest, and a query, whose own length changes no order, has length 1. A random
rotation spreads what a vector holds evenly over its components. Lists are the cells of centroids found on a
bounded sample; every row is indexed. A query probes the lists of its nearest centroids, as many as are needed
for the wanted recall by measurement on rows of the sample that the centroids were not fitted on. In a list,
the rotated components are read in blocks of columns; after each block, a candidate whose partial distance,
scaled up to all components, exceeds the k-th best distance by more than its sampling error allows is
abandoned. Lists are put on shelves of bounded size, neighbours side by side; a cell that holds a third of all
rows fills many. A query first searches its home, the shelf of its nearest list, and goes with the k-th distance
found there, once, to each other shelf that holds a list it probes, so that shelves give only what may be among
its k nearest. The queries that meet a shelf are counted
first and come in parts of bounded size, and only a shelf that many meet is sent to more than one. Scores are taken on the original vectors. Queries
that found fewer than k then read every list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import durable, parts_for


@dataclass(frozen=True)
class Settings:
    """sample: rows that centroids and probes are fitted on at most (one list for each 8 of them at most). recall: of the true
    neighbours, those whose lists are to be probed. shelf_rows, query_rows: rows and queries searched at a time. epsilon: how
    many times its usual error a partial distance may be off."""

    sample: int = 20_000
    rows_per_list: int = 32
    recall: float = 0.965
    least_probed: int = 8
    rounds: int = 6
    block: int = 16
    epsilon: float = 2.1
    shelf_rows: int = 2048
    query_rows: int = 16_384
    seed: int = 4


@dataclass(frozen=True)
class Index:
    """unit, longest: rows are divided by both, the largest component and the length left of the longest row."""

    unit: float
    longest: float
    rotation: np.ndarray
    centroids: np.ndarray  # rotated
    probed: int
    shelves: dict[int, list[int]]  # of each list

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Scaled, with what the squared length lacks of 1 as one more component, and rotated."""
        x = x / self.unit / self.longest
        return np.hstack([x, np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", x, x), 0))[:, None]]) @ self.rotation

    def queries(self, x: np.ndarray) -> np.ndarray:
        """Of length 1, with 0 as one more component, and rotated."""
        x = x / np.abs(x).max(1, initial=1e-308, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.hstack([x, np.zeros((len(x), 1))]) @ self.rotation

    def held(self) -> dict[int, np.ndarray]:
        """The lists of each shelf, ascending."""
        out: dict[int, list[int]] = {}
        for k, own in sorted(self.shelves.items()):
            for shelf in own:
                out.setdefault(shelf, []).append(k)
        return {shelf: np.array(lists) for shelf, lists in out.items()}


def usable(rows: DataFrame, id_: str, vector: str) -> DataFrame:
    """Rows with an id and a vector that is not null, empty or zero and holds finite components only; as _id and _v, an array of doubles."""
    v = F.col(vector).cast("array<double>")
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    return rows.filter(F.col(id_).isNotNull() & good).select(F.col(id_).cast("long").alias("_id"), v.alias("_v"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, a)[:, None] - 2 * a @ b.T + np.einsum("ij,ij->i", b, b)[None]


def nearest_centroids(x: np.ndarray, c: np.ndarray, together: int = 2048) -> np.ndarray:
    return np.concatenate([squared(x[i : i + together], c).argmin(1) for i in range(0, len(x), together)] or [np.zeros(0, np.int64)])


def centroids_of(x: np.ndarray, lists: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = np.unique(x, axis=0)
    c = c[rng.permutation(len(c))[:lists]]
    for _ in range(rounds):
        own = nearest_centroids(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.stack([np.bincount(own, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def side_by_side(c: np.ndarray) -> np.ndarray:
    """An order of points in which neighbours are near each other: halves along the longest axis, and halves of these."""
    if len(c) < 3:
        return np.arange(len(c))
    x = c - c.mean(0)
    along = np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")
    half = len(c) // 2
    return np.concatenate([part[side_by_side(c[part])] for part in (along[:half], along[half:])])


def probes_for(asked: np.ndarray, rows: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    """How many lists a query has to probe so that ``recall`` of its k nearest rows are in them. asked[i] is the query of rows[i]."""
    if len(rows) <= k:
        return len(centroids)
    own, needed = nearest_centroids(rows, centroids), []
    for at in range(0, len(asked), 256):
        q = asked[at : at + 256]
        far = squared(q, rows)
        far[np.arange(len(q)), at + np.arange(len(q))] = np.inf  # not the query's own row
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        order = squared(q, centroids).argsort(1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(len(centroids))[None], 1)
        needed.append(np.take_along_axis(rank, own[near], 1).ravel())
    return int(np.quantile(np.concatenate(needed), recall, method="higher")) + 1


def fit(rows: DataFrame, s: Settings, n: int, k: int) -> Index:
    """From usable rows of one length: the longest of all, centroids and probes of a sample of bounded size.

    Of the sample, three rows of four are fitted on; the others stand for the table when probes are counted: as
    they are fewer than its rows, as many fewer neighbours are looked at, so that these are as near as the k nearest.
    """
    scale = float(rows.agg(F.max(F.array_max(F.transform("_v", F.abs)))).first()[0])
    parts = F.transform("_v", lambda x: x / F.lit(scale))
    longest = float(rows.agg(F.max(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x * x))).first()[0]) ** 0.5 * (1 + 1e-9)
    chosen = rows.orderBy(F.xxhash64(F.lit(s.seed), "_id", "_v")).limit(s.sample).select("_v").toArrow()["_v"]
    v = matrix(chosen)
    rng = np.random.default_rng(s.seed)
    rotation = np.linalg.qr(rng.normal(size=(v.shape[1] + 1, v.shape[1] + 1)))[0]
    index = Index(scale, longest, rotation, np.zeros((1, v.shape[1] + 1)), 1, {})
    x, y = index.rows(v), index.queries(v)
    apart = np.arange(len(x)) % 4 == 3
    lists = max(1, min(parts_for(n, s.rows_per_list), len(x) // 8))
    centroids = centroids_of(x[~apart], lists, s.rounds, rng)
    centroids = centroids[side_by_side(centroids)]
    seen = max(1, round(k * int(apart.sum()) / n))
    probed = probes_for(y[apart][:1024], x[apart], centroids, seen, s.recall)
    return replace(index, centroids=centroids, probed=min(len(centroids), max(s.least_probed, probed)))


def lister(index: Index):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = nearest_centroids(index.rows(matrix(b.column("_v"))), index.centroids)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], names=[*b.schema.names, "_list"])

    return deal


def shelved(counts: dict[int, int], most: int) -> dict[int, list[int]]:
    """The shelves of each list: lists fill them in order; a list larger than a shelf has shelves of its own."""
    shelves, at, room = {}, 0, most
    for k, n in sorted(counts.items()):
        if n > most:
            own = parts_for(n, most)
            shelves[k] = list(range(at + 1, at + 1 + own))
            at, room = at + own + 1, most
            continue
        if n > room:
            at, room = at + 1, most
        shelves[k] = [at]
        room -= n
    return shelves


def shelver(index: Index, seed: int):
    """The shelf of each row; rows of a list that fills many are spread over them by chance."""
    top = max(index.shelves, default=-1) + 1
    first, many = np.zeros(top, np.int32), np.ones(top, np.int64)
    for k, own in index.shelves.items():
        first[k], many[k] = own[0], len(own)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, ids = b.column("_list").to_numpy(), b.column("_id").to_numpy()
            # Rows that repeat an id are spread as well, by their place.
            turn = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) + np.arange(len(ids), dtype=np.uint64) + np.uint64(seed)
            shelf = first[lists] + (turn % many[lists].astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shelf.astype(np.int32))], names=[*b.schema.names, "_shelf"])

    return deal


HOME, REST, ALL = range(3)
#: Shelves whose numbers of parts are broadcast at most; those of more are joined by shuffling.
BROADCAST_ROWS = 500_000


def meetings(index: Index, probed: int, kind: int):
    """Of a batch of queries: each shelf that they meet (of HOME: a query's own shelf, whole; of REST: the others that hold a
    list it probes), which of them do, and the lists they ask there."""
    held = index.held()
    home_of = np.full(len(index.centroids), -1)
    for k, own in index.shelves.items():
        home_of[k] = own[0]

    def meet(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        far = squared(index.queries(matrix(b.column("_v"))), index.centroids)
        far[:, home_of < 0] = np.inf  # lists without rows
        near = np.argpartition(far, probed - 1, axis=1)[:, :probed]
        home = home_of[far.argmin(1)]
        asked = np.zeros(far.shape, bool)
        np.put_along_axis(asked, near, True, 1)
        shelves = set(home.tolist()) if kind == HOME else {x for k in np.flatnonzero(asked.any(0)).tolist() for x in index.shelves.get(k, ())}
        for shelf in sorted(shelves):
            lists = held[shelf]
            if kind == HOME:
                take = np.flatnonzero(home == shelf)
                asked[np.ix_(take, lists)] = True
            else:
                take = np.flatnonzero(asked[:, lists].any(1) & ((home != shelf) | (kind == ALL)))
            if len(take):
                yield shelf, take, asked[np.ix_(take, lists)]

    return meet


def cut(batches: Iterator[pa.RecordBatch], most: int = 1024) -> Iterator[pa.RecordBatch]:
    return (whole.slice(at, most) for whole in batches for at in range(0, whole.num_rows, most))


def prober(index: Index, probed: int, kind: int):
    """A row for each query and shelf that it meets; _lists tells which lists it asks, a bit for each list of the shelf."""
    meet = meetings(index, probed, kind)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches):
            for shelf, take, lists in meet(b):
                sent, bits = b.take(pa.array(take)), np.packbits(lists, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*sent.columns, pa.array(np.full(len(take), shelf, np.int32)), pa.array([x.tobytes() for x in bits], pa.binary())], names=[*b.schema.names, "_shelf", "_lists"]
                )

    return deal


def tallier(index: Index, probed: int, kind: int):
    """How many queries of a partition meet each shelf."""
    meet = meetings(index, probed, kind)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, int] = {}
        for b in cut(batches):
            for shelf, take, _ in meet(b):
                met[shelf] = met.get(shelf, 0) + len(take)
        yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.int32()), pa.array(list(met.values()), pa.int64())], names=["_shelf", "n"])

    return tally


def scan(q: np.ndarray, x: np.ndarray, barred: np.ndarray, best: np.ndarray, block: int, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows x of a list that may be among the k nearest of the queries q: (query, row, squared distance), and the new
    ``best``, the k least distances that each query has seen (a heap in no order, infinite where there are fewer).

    barred tells pairs that do not count. A query that has not seen k rows yet reads all of its first list that has k.
    """
    dims, k, e = x.shape[1], best.shape[1], min(block, x.shape[1])
    bound = best.max(1)
    open_ = np.flatnonzero(np.isinf(bound))
    if len(open_) and len(x) >= k:
        whole = np.where(barred[open_], np.inf, np.maximum(squared(q[open_], x), 0))
        bound[open_] = np.partition(whole, k - 1, axis=1)[:, k - 1]
    part = np.maximum(squared(q[:, :e], x[:, :e]), 0)
    # Hypothesis: the whole distance is within the bound. Rejected if the scaled part is too far beyond it.
    far = lambda e: (bound * (1 + epsilon / np.sqrt(e)) ** 2 * e / dims) if e < dims else bound * (1 + 1e-9) + 1e-12
    i, j = np.nonzero((part <= far(e)[:, None]) & ~barred)
    part = part[i, j]
    while e < dims:
        d, e = e, min(e + block, dims)
        part = part + ((x[j, d:e] - q[i, d:e]) ** 2).sum(1)
        stay = part <= far(e)[i]
        i, j, part = i[stay], j[stay], part[stay]
    seen = np.full((len(q), len(x)), np.inf)
    seen[i, j] = part
    return i, j, part, np.partition(np.hstack([best, seen]), k - 1, axis=1)[:, :k]


def chosen(ids: np.ndarray, v: np.ndarray, w: np.ndarray, i: np.ndarray, j: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, id, score, squared distance) of the k largest inner products of each query among its pairs (i, j), ties to the smaller id."""
    with np.errstate(over="ignore", invalid="ignore"):
        score = np.concatenate([(v[j[a : a + 65_536]] * w[i[a : a + 65_536]]).sum(1) for a in range(0, len(i), 65_536)] or [np.zeros(0)])
    score[np.isnan(score)] = -np.inf
    order = np.lexsort((ids[j], -score, i))
    i, j, score, far = i[order], j[order], score[order], far[order]
    begin = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
    turn = np.arange(len(i)) - np.repeat(begin, np.diff(np.r_[begin, len(i)]))
    top = turn < k
    return i[top], ids[j[top]], score[top], far[top]


FOUND = "_q long, query_id long, vec_id long, score double, _far double"


def searcher(index: Index, k: int, s: Settings, together: int = 1024, wide: int = 512):
    held = index.held()

    def search(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [], [])
        if len(queries) and len(rows):
            rows = rows.sort_by("_list")
            ids, lists, v = rows["_id"].to_numpy(), rows["_list"].to_numpy(), matrix(rows["_v"])
            x, own = index.rows(v), held[key[0].as_py()]
            starts, ends = np.searchsorted(lists, own), np.searchsorted(lists, own, side="right")
            for at in range(0, len(queries), together):
                some = queries.slice(at, together)
                asked, number, w = some["_id"].to_numpy(), some["_q"].to_numpy(), matrix(some["_v"])
                y, best = index.queries(w), np.full((len(some), k), np.inf)
                best[:] = some["_bound"].to_numpy()[:, None]
                probed = np.unpackbits(np.frombuffer(b"".join(some["_lists"].to_pylist()), np.uint8).reshape(len(some), -1), axis=1)
                found = []
                for n, a, b in ((n, a, min(a + wide, ends[n])) for n in range(len(own)) for a in range(starts[n], ends[n], wide)):
                    mine = np.flatnonzero(probed[:, n])
                    if len(mine):
                        i, j, far, best[mine] = scan(y[mine], x[a:b], asked[mine][:, None] == ids[a:b][None], best[mine], s.block, s.epsilon)
                        found.append((mine[i], a + j, far))
                i, j, far = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
                near = far <= best.max(1)[i] * (1 + 1e-9) + 1e-12
                i, near_ids, score, far = chosen(ids, v, w, i[near], j[near], far[near], k)
                for to, z in zip(out, (number[i], asked[i], near_ids, score, far), strict=True):
                    to.append(z)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(np.concatenate(a) if a else [], t) for a, t in zip(out, kinds, strict=True)], names=["_q", "query_id", "vec_id", "score", "_far"])

    return search


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, s: Settings = Settings(), id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found, ties to the smaller vec_id; all candidates, if fewer.

    Candidates are all rows but those with the query's own id. Vectors that are null, empty, zero or hold
    null or non-finite components take no part on either side, nor do null ids, nor vectors of another length
    than most of the rows have (of equally many, the larger length). Repeated rows are candidates each, and a
    query that repeats has its whole result as often. An inner product beyond the range of doubles is infinite;
    one that is not a number comes last. No usable row or query: an empty result.
    """
    spark = rows.sparkSession
    index_rows, asked = durable(usable(rows, id_, vector)), usable(queries, id_, vector)
    sized = index_rows.groupBy(F.size("_v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if sized is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, n = sized["dims"], sized["count"]
    index_rows = index_rows.filter(F.size("_v") == dims)
    asked = durable(asked.filter(F.size("_v") == dims).withColumn("_q", F.monotonically_increasing_id()))
    index = fit(index_rows, s, n, k)
    listed = durable(index_rows.mapInArrow(lister(index), "_id long, _v array<double>, _list int"))
    counts = listed.groupBy("_list").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each list, a bounded number
    index = replace(index, shelves=shelved({r["_list"]: r["n"] for r in counts}, s.shelf_rows))
    dealt = listed.mapInArrow(shelver(index, s.seed), "_id long, _v array<double>, _list int, _shelf int")

    def searched(some: DataFrame, probed: int, kind: int) -> DataFrame:
        # A shelf is sent to as many parts as the queries that meet it fill, most to one only; a shelf that none meets, to none.
        met = some.select("_v").mapInArrow(tallier(index, probed, kind), "_shelf int, n long").groupBy("_shelf").agg(F.ceil(F.sum("n") / s.query_rows).cast("int").alias("_parts"))
        met = durable(met)
        met = F.broadcast(met) if met.count() <= BROADCAST_ROWS else met
        sent = some.select("_id", "_v", "_q", "_bound").mapInArrow(prober(index, probed, kind), "_id long, _v array<double>, _q long, _bound double, _shelf int, _lists binary")
        sent = sent.join(met, "_shelf").withColumn("_part", F.pmod(F.xxhash64("_q"), "_parts").cast("int")).drop("_parts")
        rows_ = dealt.join(met, "_shelf").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        return sent.groupBy("_shelf", "_part").cogroup(rows_.groupBy("_shelf", "_part")).applyInArrow(searcher(index, k, s), FOUND)

    order = Window.partitionBy("_q").orderBy(F.col("score").desc(), "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    open_ = F.lit(float("inf"))
    home = durable(searched(asked.withColumn("_bound", open_), index.probed, HOME))
    bounds = home.groupBy("_q").agg(F.when(F.count(F.lit(1)) >= k, F.max("_far")).alias("_bound"))
    bounded = asked.join(bounds, "_q", "left").withColumn("_bound", F.coalesce("_bound", open_))
    found = durable(best(home.unionByName(searched(bounded, index.probed, REST))))
    # Whoever found fewer than k has its own id in its lists, say, or too few rows there: it reads every list.
    full = found.filter(F.col("rank") == k).select("_q")
    short = asked.join(full, "_q", "left_anti").withColumn("_bound", open_)
    if index.probed < len(index.centroids) and not short.isEmpty():
        again = best(searched(short, len(index.centroids), ALL))
        found = found.join(full, "_q", "left_semi").select(*again.columns).unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")


def nearest_of_table(rows: DataFrame, every: int = 20, k: int = 20, s: Settings = Settings()) -> DataFrame:
    """The query of all rows whose vec_id is divisible by ``every``."""
    return nearest(rows, rows.filter(F.col("vec_id") % every == 0), k, s)
