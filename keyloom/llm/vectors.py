"""Vectors as rows and as packed blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20


def usable(vector: Column) -> Column:
    """True for vectors that are not null, empty or zero and hold no null or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a double matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by their largest component, so no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def per_block(dim: int) -> int:
    """Rows of a block of doubles of at most ``BLOCK_BYTES``."""
    return max(16, BLOCK_BYTES // (8 * max(1, dim)))


def sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The first ``rows`` rows in hash order of ``key``: the same ones whatever the partitioning."""
    return df.orderBy(F.xxhash64(F.lit(3), key), key).limit(rows)


def hashed_sample(df: DataFrame, key: str, vector: str, rows: int) -> DataFrame:
    """The first ``rows`` rows in hash order of ``key`` and ``vector``, in no order: the same ones whatever the partitioning.

    Counts of hash ranges, narrowed 12 bits a step, say up to which hash rows are
    needed, so what comes to the driver is at most about twice ``rows``, not that
    many from each task. Where more share the last range, they are copies of one row.
    """
    hashed = df.withColumn("h", F.xxhash64(F.lit(3), key, vector))
    step, low, left, shift = 12, None, rows, 52
    sure = F.lit(False)
    while True:
        bucket = F.shiftrightunsigned("h", shift)
        inside = hashed if low is None else hashed.filter(F.shiftrightunsigned("h", shift + step) == low)
        counts = sorted((r["b"], r["n"]) for r in inside.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
        ends = np.cumsum([n for _, n in counts])
        at = int(np.searchsorted(ends, left))
        if at == len(counts):
            return df  # no more rows than asked for
        first, last = counts[0][0], counts[at][0]
        if at:
            sure = sure | ((bucket >= first) & (bucket < last) & (F.lit(True) if low is None else F.shiftrightunsigned("h", shift + step) == low))
            left -= int(ends[at - 1])
        low = last
        if counts[at][1] <= rows or shift < step:
            break
        shift -= step
    edge = hashed.filter(bucket == low)
    edge = edge.orderBy("h", key).limit(left) if counts[at][1] <= rows else edge.limit(left)
    return hashed.filter(sure).unionByName(edge).drop("h")
