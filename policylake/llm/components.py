"""Connected components of a graph given as edges, by alternating stars.

Each partition first contracts its own edges. What is left is counted: up to SMALL edges, a fixed size, one task contracts
them. More go through rounds in which every node hands its larger neighbours to its smallest one (large
star), and its smaller neighbours to their smallest (small star), until few are left or nothing changes: a number of
rounds that grows with the logarithm of the longest path. A hub's neighbours are never gathered; joins on hubs can be split by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


#: Edges that one task may contract: about 100 MB there.
SMALL = 1_000_000


class Union:
    """Union-find over places 0..n-1; the root is the smallest place."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, smallest node) with the components of the edges."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    union = Union(len(nodes))
    for i, j in zip(places[: len(a)].tolist(), places[len(a) :].tolist()):
        union.join(i, j)
    root = np.array([union.find(i) for i in range(len(nodes))], dtype=np.int64)
    apart = root != np.arange(len(nodes))
    return nodes[apart], nodes[root[apart]]


def _contract_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b, n = [], [], 0
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        n += len(batch)
        if n > 500_000:  # bounded memory: stars are what stays
            x, y = contract(np.concatenate(a), np.concatenate(b))
            if len(x) > 250_000:
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
                x, y = x[:0], y[:0]
            a, b, n = [x], [y], len(x)
    if n:
        x, y = contract(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def _contract_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All of at most SMALL edges at once: what comes out are the components."""
    got = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if got:
        x, y = contract(*(np.concatenate(c) for c in zip(*got)))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def components(edges: DataFrame, most_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(node, root) for all nodes of edges (a, b) of longs; the root is the component's smallest node. Roots have rows too."""

    def sign(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("b", "a"), 24))).first()
        return tuple(r)

    now = materialize(edges.select("a", "b").where("a <> b").mapInArrow(_contract_partition, "a long, b long").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        after = sign(now)
        if after == before or not after[0]:
            break
        if after[0] <= small:
            now = materialize(now.coalesce(1).mapInArrow(_contract_all, "a long, b long"), "edges")
            break
        before = after
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # large: a > b always. Small star: smaller neighbours and the node itself go to the smallest of them.
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        low = large.join(small_least, "a")
        step = low.select(F.col("a"), F.col("m").alias("b")).union(low.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = materialize(step.mapInArrow(_contract_partition, "a long, b long").distinct(), "edges")
    else:
        raise RuntimeError("components didn't settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
