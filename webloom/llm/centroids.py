"""Centroid clustering of whole-number vectors, by filtering candidates down kd-trees.

Vectors are packed where they are read: each block of them becomes a kd-tree, whose nodes hold a count (by the place of
their range), exact component sums and a bounding box. In every round the centroids are passed down each tree. A candidate
that is strictly farther than the one nearest to the box's middle, at every point of the box, is dropped; a node left with
one candidate is assigned whole, by its count and sums; what reaches a leaf is resolved vector by vector. So each round
gives exactly what comparing all vectors with all centroids would, and its sums are added up as whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import durable, tidy

#: Components are below this in size, so that a squared distance of up to 2^9 of them stays a long.
LIMIT = 1 << 26
BLOCK = "ids array<long>, vectors binary, lows binary, highs binary, sums binary"


@dataclass(frozen=True)
class Settings:
    dims: int = 64
    scale: int = 1024
    clusters: int = 8
    rounds: int = 10
    #: The first centroids are the vectors whose "<seed>:<id>" has the smallest digest.
    seed: int = 3
    #: Vectors of a tree, and of a leaf.
    block: int = 4096
    leaf: int = 32


def whole_vectors(rows: DataFrame, s: Settings, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and v, array<long>: floor(scale * x) of each component. Rows whose vector is null, of another length, or holds a null
    or a number that is not finite are left out. A component whose whole number is LIMIT or more in size is an error: squared
    distances would not be longs."""
    x = F.col(f"`{vector}`").cast("array<double>")
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    good = rows.select(F.col(f"`{key}`").cast("long").alias("key"), x.alias("x")).filter((F.size("x") == s.dims) & F.forall("x", finite))
    scaled = F.transform("x", lambda e: F.floor(F.when(F.abs(e) * s.scale < LIMIT, e * s.scale).otherwise(F.raise_error(F.lit(f"a component is {LIMIT // s.scale} or more in size")).cast("double"))))
    return good.select("key", scaled.alias("v"))


def first_centroids(vectors: DataFrame, s: Settings) -> np.ndarray:
    """The vectors of smallest digest; null ids come last, equal ids in the order of their components."""
    digest = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.col("key").cast("string")).cast("binary"), 256)
    first = vectors.select(digest.alias("d"), "v").orderBy(F.col("d").asc_nulls_last(), "v").limit(s.clusters).collect()
    return np.array([r.v for r in first], np.int64).reshape(-1, s.dims)


# ---- trees


def cuts(n: int, leaf: int) -> list[np.ndarray]:
    """For each level of the tree, where its nodes' ranges begin, and the end of the last: every node is halved by count."""
    depth = 0
    while n >> depth > leaf:
        depth += 1
    return [np.array([n * i >> level for i in range((1 << level) + 1)]) for level in range(depth + 1)]


def planted(v: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of the vectors in a tree; low and high corners and sums of its nodes, level by level."""
    order, levels = np.arange(len(v)), cuts(len(v), leaf)
    for at, below in zip(levels, levels[1:], strict=False):
        for i in range(len(at) - 1):
            own = order[at[i] : at[i + 1]]
            x = v[own]
            widest = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
            order[at[i] : at[i + 1]] = own[np.argpartition(x[:, widest], below[2 * i + 1] - at[i])]
    v = v[order]
    lows, highs, sums = (np.concatenate([f.reduceat(v, at[:-1], axis=0) for at in levels]) for f in (np.minimum, np.maximum, np.add))
    return order, lows, highs, sums


def pack(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Rows (key, v) to blocks, each with its tree."""

    def block(keys: list, v: np.ndarray) -> pa.RecordBatch:
        order, lows, highs, sums = planted(v, s.leaf)
        own = [[keys[i] for i in order], *(x.tobytes() for x in (v[order].astype(np.int32), lows.astype(np.int32), highs.astype(np.int32), sums))]
        return pa.RecordBatch.from_arrays([pa.array([own[0]], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in own[1:])], names=["ids", "vectors", "lows", "highs", "sums"])

    keys, held = [], []
    for b in batches:
        keys += b.column("key").to_pylist()
        held.append(b.column("v").flatten().to_numpy().reshape(-1, s.dims))
        while len(keys) >= s.block:
            v = np.concatenate(held)
            yield block(keys[: s.block], v[: s.block])
            keys, held = keys[s.block :], [v[s.block :]]
    if keys:
        yield block(keys, np.concatenate(held))
    tidy()


@dataclass
class Tree:
    ids: list
    v: np.ndarray
    lows: np.ndarray
    highs: np.ndarray
    sums: np.ndarray


def trees(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[Tree]:
    for b in batches:
        for i in range(b.num_rows):
            at = lambda name, kind: np.frombuffer(b.column(name)[i].as_py(), kind).astype(np.int64).reshape(-1, dims)  # noqa: B023, E731
            yield Tree(b.column("ids")[i].as_py(), at("vectors", np.int32), at("lows", np.int32), at("highs", np.int32), at("sums", np.int64))


def nearest(v: np.ndarray, centroids: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """The nearest of each vector's candidates, the first among equals."""
    bound = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    exact = np.float64 if bound * bound * 4 * v.shape[1] < 1 << 53 else np.int64  # either holds the whole numbers as they are
    v, c = v.astype(exact), centroids.astype(exact)
    d = (c * c).sum(axis=1) - 2 * (v @ c.T)
    d[~alive] = np.iinfo(np.int64).max if exact is np.int64 else np.inf
    return d.argmin(axis=1)


def filtered(tree: Tree, centroids: np.ndarray, s: Settings) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """Whole nodes that have one candidate left (cluster, node, count), and places and clusters of the vectors resolved one by one."""
    k, levels = len(centroids), cuts(len(tree.v), s.leaf)
    nodes, alive, base = np.array([0]), np.ones((1, k), bool), 0
    settled: list[tuple[int, int, int]] = []
    for level, at in enumerate(levels):
        low, high = tree.lows[base + nodes], tree.highs[base + nodes]
        middle = low + high  # twice the box's middle
        away = ((2 * centroids[None] - middle[:, None]) ** 2).sum(axis=2)
        best = np.where(alive, away, np.iinfo(np.int64).max).argmin(axis=1)
        near = centroids[best]
        # The corner of the box that favours a candidate most against the nearest.
        corner = np.where(centroids[None] > near[:, None], high[:, None], low[:, None])
        mine, other = ((centroids[None] - corner) ** 2).sum(axis=2), ((near[:, None] - corner) ** 2).sum(axis=2)
        alive &= mine <= other
        one = alive.sum(axis=1) == 1
        settled += [(int(c), base + int(n), int(at[n + 1] - at[n])) for c, n in zip(alive[one].argmax(axis=1), nodes[one], strict=True)]
        nodes, alive = nodes[~one], alive[~one]
        if level + 1 < len(levels):
            nodes, alive, base = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel(), np.repeat(alive, 2, axis=0), base + len(at) - 1
    at = levels[-1]
    places = np.concatenate([np.arange(at[n], at[n + 1]) for n in nodes]) if len(nodes) else np.empty(0, int)
    own = nearest(tree.v[places], centroids, np.repeat(alive, at[nodes + 1] - at[nodes], axis=0)) if len(places) else places
    return settled, places, own


def labels(tree: Tree, centroids: np.ndarray, s: Settings) -> np.ndarray:
    """The cluster of each of its vectors."""
    settled, places, own = filtered(tree, centroids, s)
    levels = cuts(len(tree.v), s.leaf)
    starts = np.concatenate([at[:-1] for at in levels])
    out = np.zeros(len(tree.v), int)
    for c, node, n in settled:
        out[starts[node] : starts[node] + n] = c
    out[places] = own
    return out


# ---- rounds


def _totals(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, s: Settings) -> Iterator[pa.RecordBatch]:
    """A row for each cluster: count and component sums of a partition."""
    k = len(centroids)
    counts, sums = np.zeros(k, np.int64), np.zeros((k, s.dims), np.int64)
    for tree in trees(batches, s.dims):
        settled, places, own = filtered(tree, centroids, s)
        for c, node, n in settled:
            counts[c] += n
            sums[c] += tree.sums[node]
        np.add.at(sums, own, tree.v[places])
        counts += np.bincount(own, minlength=k)
    has = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(counts[has], pa.int64()), pa.array(sums[has].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])
    tidy()


def moved(blocks: DataFrame, centroids: np.ndarray, s: Settings) -> np.ndarray:
    """The centroids after a round: exact floors of the means; a cluster without vectors keeps its own."""
    parts = blocks.mapInArrow(partial(_totals, centroids=centroids, s=s), "cluster int, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(s.dims)))
    new = centroids.copy()
    for r in total.collect():  # a row a cluster
        new[r.cluster] = [r[f"s{i}"] // r.n for i in range(s.dims)]
    return new


def _inertias(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, s: Settings) -> Iterator[pa.RecordBatch]:
    total = [0] * len(centroids)
    for tree in trees(batches, s.dims):
        own = labels(tree, centroids, s)
        away = ((tree.v - centroids[own]) ** 2).sum(axis=1)
        for c in np.unique(own):
            total[c] += sum(away[own == c].tolist())
    yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.int64())], names=["cluster", "inertia"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, s: Settings, key: str) -> Iterator[pa.RecordBatch]:
    for tree in trees(batches, s.dims):
        own = labels(tree, centroids, s)
        away = ((tree.v - centroids[own]) ** 2).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(tree.ids, pa.int64()), pa.array(own, pa.int32()), pa.array(away, pa.int64())], names=[key, "cluster", "distance"])
    tidy()


def packed_blocks(vectors: DataFrame, s: Settings) -> DataFrame:
    """Trees of the vectors of each partition, written down once: all rounds read them. Nothing is shuffled."""
    return durable(vectors.mapInArrow(partial(pack, s=s), BLOCK))


def fit(vectors: DataFrame, blocks: DataFrame, s: Settings) -> np.ndarray:
    """The centroids after all rounds; only centroids and their sums, a row a cluster, come to the driver."""
    centroids = first_centroids(vectors, s)
    for _ in range(s.rounds):
        after = moved(blocks, centroids, s)
        if (after == centroids).all():  # later rounds change nothing
            break
        centroids = after
    return centroids


def cluster_vectors(rows: DataFrame, s: Settings = Settings(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector that takes part: key, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Null vectors, those of another length and those that hold a null or a number that is not finite take no part. Repeated
    rows are vectors of their own; an id may be null. Ties go to the smaller cluster. With fewer vectors than clusters
    there are as many clusters as vectors; without any, no rows. No other column is read.
    """
    vectors = whole_vectors(rows, s, key, vector)
    blocks = packed_blocks(vectors, s)
    centroids = fit(vectors, blocks, s)
    out = blocks.mapInArrow(partial(_assigned, centroids=centroids, s=s, key=key), f"`{key}` long, cluster int, distance long")
    sums = blocks.mapInArrow(partial(_inertias, centroids=centroids, s=s), "cluster int, inertia long").groupBy("cluster").agg(F.sum("inertia").alias("inertia"))
    inertia = {r.cluster: r.inertia for r in sums.collect()}
    of = lambda values: F.array(*map(F.lit, values))[F.col("cluster")] if len(values) else F.lit(None)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = of([inertia.get(c, 0) for c in range(len(centroids))]).cast("long")
    return out.withColumns({"cluster_inertia": own, "inertia": F.lit(sum(inertia.values())).cast("long"), "centroid_sha256": of(digests).cast("string")})


def _oracle(s: Settings) -> str:
    """The same clustering in SQL, a pair of steps for each round; all vectors meet all centroids."""
    apart = "list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    near = lambda i: f"a{i} AS MATERIALIZED (SELECT id, v, cluster, d FROM (SELECT v.vec_id AS id, v.v, c.cluster, {apart} AS d, row_number() OVER (PARTITION BY v.n ORDER BY {apart}, c.cluster) AS k FROM vs v, c{i} c) WHERE k = 1)"
    step = lambda i: f"""c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT cluster, list(x ORDER BY j) AS v FROM (SELECT cluster, j,
      ((sum(v[j]) - ((sum(v[j]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM a{i}, range(1, {s.dims + 1}) AS t(j) GROUP BY cluster, j) GROUP BY cluster) m USING (cluster))"""  # noqa: E731
    return f"""WITH vs AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({s.scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {s.dims} AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), FALSE)))),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{s.seed}:' || vec_id)) - 1 AS cluster, v FROM vs ORDER BY 1 LIMIT {s.clusters}),
    {", ".join(f"{near(i)}, {step(i)}" for i in range(s.rounds))}, {near(s.rounds)}
    SELECT id AS vec_id, cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{s.rounds} JOIN c{s.rounds} c USING (cluster)"""


ORACLE = _oracle(Settings())
