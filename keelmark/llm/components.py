"""Connected components by distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelmark.llm.runtime import prepare, saved


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node of these edges that is not the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    half = len(a)
    for x, y in zip(at[:half].tolist(), at[half:].tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array([find(x) for x in range(len(nodes))], dtype=np.int64)
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _local_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as stars; what is kept is folded whenever it has doubled."""
    a = b = np.empty(0, dtype=np.int64)
    waiting, held = [], 0
    for batch in batches:
        waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        held += batch.num_rows
        if held > max(200_000, len(a)):
            a, b = forest(np.concatenate([a, *(x for x, _ in waiting)]), np.concatenate([b, *(y for _, y in waiting)]))
            waiting, held = [], 0
    if waiting:
        a, b = forest(np.concatenate([a, *(x for x, _ in waiting)]), np.concatenate([b, *(y for _, y in waiting)]))
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge that is not the smallest of its component.

    ``edges`` has two non-null long columns. The component is named by its smallest
    node. Each round first folds the edges of every task by union-find, then
    attaches larger neighbours to the smallest one (large star) and the smaller
    ones to theirs (small star), until the stars no longer change. Rounds grow
    with the logarithm of the longest chain. A round's edges are a written table; no node, link or
    component reaches the driver, only a count and a checksum do. Loops and
    repeated edges are allowed, an empty table gives an empty one.
    """
    prepare(edges.sparkSession)
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    before = None
    while True:
        # Written, as it is read three times and may be costly to make in the first round.
        stars = saved(now.mapInArrow(_local_forests, "u long, v long"), "forests")
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: u's larger neighbours move to the smallest of u and its neighbours
        # Written, so that AQE may split the joins where a star has very many nodes.
        lowest = saved(_smallest(both).select("u", F.least("u", "m").alias("m")), "lowest")
        large = (
            stars.select(F.col("v").alias("u"), F.col("u").alias("w")).join(lowest, "u")
            .select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = saved(large, "large-star")
        # small star: u and its smaller neighbours move to the smallest of them
        lowest = saved(_smallest(large), "lowest")
        small = (
            large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(lowest.select("u", F.col("m").alias("v"))).distinct()
        )
        now = saved(small, "small-star")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
