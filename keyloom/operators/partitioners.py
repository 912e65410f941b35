"""Placement of keys: each function gives a partition id in ``[0, n)`` as a column."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.hashing import djb2_mod

Partitioner = Callable[[Column, int], Column]


def djb2_partition(key: Column, n: int) -> Column:
    return djb2_mod(key, n)


def spark_partition(key: Column, n: int) -> Column:
    """Spark's own Murmur3 placement."""
    return F.pmod(F.hash(key), F.lit(n)).cast("int")


def first_letter_partition(key: Column, n: int) -> Column:
    return F.pmod(F.ascii(key) - 97, F.lit(n)).cast("int")


def python_partition(fn: Callable[[str, int], int]) -> Partitioner:
    """A Python callable as partitioner, run over Arrow batches; results are taken modulo n."""

    def column(key: Column, n: int) -> Column:
        @F.pandas_udf("int")
        def place(keys: pd.Series) -> pd.Series:
            known = {k: int(fn(k, n)) % n for k in keys.unique()}
            return keys.map(known).astype("int32")

        return place(key)

    return column


def partition_by(df: DataFrame, n: int, pid: Column) -> DataFrame:
    """One exchange to exactly ``n`` partitions, row placed by ``pid`` (taken modulo n)."""
    return df.repartitionById(n, F.pmod(pid, F.lit(n)).cast("int"))
