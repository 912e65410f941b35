"""Connected components by alternating large and small stars, on checkpointed edge lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import saved


def min_labels(n: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over edges ``r - c``."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[r], label[c])
        np.minimum.at(label, r, low)
        np.minimum.at(label, c, low)
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt
        if (label == before).all():
            return label


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's edges as stars: no more edges than nodes, same components."""
    for b in batches:
        u, v = b.column("u").to_numpy(), b.column("v").to_numpy()
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = min_labels(len(nodes), at[: len(u)], at[len(u) :])
        keep = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[label[keep]])], names=["u", "v"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the edges ``(u, v)`` (bigint): the smallest node reachable.

    Hubs are safe: a node's least neighbour is a partial aggregate, and the join
    that applies it splits hot keys under adaptive execution. Self-loops and
    repeated edges are harmless; nodes without an edge do not appear.
    """
    own = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = saved(own.mapInArrow(_contract, "u bigint, v bigint").distinct())
    before = _state(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        e = saved(e.filter("u <> v"))
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v")))
        e = saved(small.distinct())
        if (now := _state(e)) == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
