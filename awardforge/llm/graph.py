"""Distributed union-find: connected components of a link table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the links of one task: each node with the smallest node it reaches there."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(inverse[: len(a)].tolist(), inverse[len(a) :].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array([find(x) for x in range(len(nodes))], dtype=np.int64)
    return nodes, nodes[root]


def _contract(links: DataFrame, batch: int = 200_000) -> DataFrame:
    """Replace the links of each batch of a task by stars around their smallest nodes: same components, fewer links."""

    def stars(a, b):
        node, root = _roots(np.concatenate(a), np.concatenate(b))
        away = node != root
        return pa.RecordBatch.from_arrays([pa.array(node[away]), pa.array(root[away])], names=["a", "b"])

    def task(batches):
        a, b, held = [], [], 0
        for x in batches:
            a.append(x.column(0).to_numpy(zero_copy_only=False))
            b.append(x.column(1).to_numpy(zero_copy_only=False))
            held += len(a[-1])
            if held >= batch:
                yield stars(a, b)
                a, b, held = [], [], 0
        if held:
            yield stars(a, b)

    return links.select("a", "b").mapInArrow(task, "a long, b long")


def components(links: DataFrame, tag: str = "components", most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``links (a long, b long)``; component is the smallest node reached.

    Rounds of large-star and small-star (each node points to the smallest of its neighbours, then
    each to the smallest of its smaller ones) until nothing changes. A node's neighbours are only ever
    reduced by ``min``, which Spark combines before the shuffle; no neighbour list is collected. Links
    of one batch are first contracted to stars, so a large class of copies is a star from the start.
    Every round is written to the shared folder. Null ends and self links are dropped.
    """
    links = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = shared.saved(_contract(links).distinct(), tag)
    before = None
    for _ in range(most_rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large-star: every larger neighbour of u is linked to u's lowest
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: u and its smaller neighbours are linked to the lowest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        links = shared.saved(_contract(small).distinct(), tag)
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if state == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b")).distinct()
        before = state
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
