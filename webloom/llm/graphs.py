"""Connected components of an edge table, by union-find inside partitions and alternating stars between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import durable, tidy


def unite(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and the smallest node each is connected to, by union-find with path halving."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)  # nodes are sorted, so the smallest is the root
    return nodes, nodes[[root(x) for x in range(len(nodes))]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        nodes, low = unite(b.column("a").to_numpy(), b.column("b").to_numpy())
        far = nodes != low
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(low[far])], names=["a", "b"])
    tidy()


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b), longs, not null: (node, component), the component's smallest node, for every node of an edge to another.

    Each round, a node's larger neighbours are tied to its smallest one (large star), then its smaller ones
    (small star); both only take minima, which combine before they are shuffled. Rounds end when every
    node's one edge leads to a smallest node. Edges from a node to itself count for nothing; no edges, no rows.
    """
    own = durable(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_contract, "a long, b long").distinct())
    while True:
        # a > b in every edge. Large star: all neighbours of u above u go to the smallest of u and its neighbours.
        both = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: u and its neighbours below u go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        own = durable(small)
        roots = own.select(F.col("b").alias("a")).distinct()
        again = own.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() or own.join(roots, "a", "left_semi").limit(1).count()
        if not again:
            return own.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select(F.col("a").alias("node"), F.col("a").alias("component")))
