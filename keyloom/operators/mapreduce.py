"""Generic map / combine / partition / sort / reduce over DataFrames.

Two forms share one call. *Native*: mapper is ``DataFrame -> DataFrame[key,
value]`` and reducer a list of aggregate columns, so Catalyst plans the partial
aggregates. *Opaque*: Python callables, run over Arrow batches, with one
exchange between them; keys are reduced in order inside each partition. Map and
combine are one pass over the rows, in pieces of ``PIECE`` pairs, or with a combiner of
``HELD`` (of fewer, where values are long). Where no files are written a partition
is several tasks, as many as the input asks for at ``TASK_BYTES`` each.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from keyloom.operators.partitioners import Partitioner, djb2_partition, partition_by
from keyloom.sources.tables import bounded_batches

PAIR = "key string, value string"
PIECE, HELD = 50_000, 500_000
TASK_BYTES, MOST_TASKS = 4 << 20, 20_000
Mapper = Callable[[str, str], Iterable[tuple[str, str]]]
Combiner = Callable[[str, list[str]], Iterable[str]]
Reducer = Callable[[str, Iterator[str], int], Iterable[Sequence[Any]]]


@dataclass(frozen=True)
class PythonReducer:
    """``fn(key, values, partition)`` yields rows of ``schema``."""

    fn: Reducer
    schema: str = PAIR
    columns: list[str] = field(default_factory=lambda: ["key", "value"])


def _batch(columns: Sequence[Sequence[Any]], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_EMITTED = pa.schema([("key", pa.string()), ("value", pa.string()), ("emits", pa.int64())])


def emitted(df: DataFrame, mapper: Mapper, combiner: Combiner | None = None) -> DataFrame:
    """``(key, value, emits)``: the (combined) pairs, and rows without key that count what ``mapper(value, doc)`` emitted; null values emit nothing."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
        return ((value, doc) for b in batches for doc, value in zip(b.column("doc").to_pylist(), b.column("value").to_pylist()))

    def batch(keys: Sequence[str], values: Sequence[str], emits: int) -> pa.RecordBatch:
        return _batch([[*keys, None], [*values, None], [*[None] * len(keys), emits]], _EMITTED)

    def uncombined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = itertools.chain.from_iterable(mapper(value, doc) for value, doc in rows(batches))
        while piece := list(itertools.islice(pairs, PIECE)):
            yield batch(*zip(*piece), len(piece))

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: defaultdict[str, list[str]] = defaultdict(list)
        held = emits = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            left = emits  # counted with the first of the batches
            pairs = ((k, v) for k, vs in groups.items() for v in combiner(k, vs))  # type: ignore[misc]
            while (piece := list(itertools.islice(pairs, PIECE))) or left:
                keys, values = zip(*piece) if piece else ((), ())
                yield batch(keys, values, left)
                left = 0

        for value, doc in rows(batches):
            for k, v in mapper(value, doc):
                groups[k].append(v)
                emits += 1
                held += 1 if v is doc else 1 + (len(v) >> 4)  # long values count for more
                if held >= HELD:
                    yield from flushed()
                    groups.clear()
                    held = emits = 0
        yield from flushed()

    run = uncombined if combiner is None else combined
    bounded_batches(df.sparkSession)
    return df.select("doc", "value").filter(F.col("value").isNotNull()).mapInArrow(run, "key string, value string, emits bigint")


def pairs_only(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("emits").isNull()).select("key", "value")


def map_pairs(df: DataFrame, mapper: Mapper) -> DataFrame:
    """Apply ``mapper(value, doc)`` to each row of ``(doc, value)``; null values emit nothing."""
    return pairs_only(emitted(df, mapper))


def combine_in_batches(pairs: DataFrame, combiner: Combiner) -> DataFrame:
    """Map-side combine of given pairs: may run on any subset of a key's values, and may drop the key."""
    return pairs_only(emitted(pairs.select(F.col("key").alias("doc"), "value"), lambda value, key: [(key, value)], combiner))


def _splits(df: DataFrame, n: int) -> int:
    """Tasks for each of ``n`` partitions, by the optimizer's bytes of the input; 1 where it does not know them."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(-(-size // (TASK_BYTES * n)), -(-MOST_TASKS // n)) if size < 1 << 60 else 1


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, int]]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in ("key", "value", "pid")))


def reduced(pairs: DataFrame, reducer: PythonReducer, n: int, partitioner: Partitioner = djb2_partition, splits: int = 1) -> DataFrame:
    """The reducer's rows, with ``_pid`` null, and after those of each key one row that has the key's partition as ``_pid``.

    Partition ``i`` of the result holds what was reduced in partition ``i``, keys in order;
    with ``splits`` the partitions from ``i * splits`` on do, each a share of the keys by another hash.
    """
    placed = pairs.withColumn("pid", F.pmod(partitioner(F.col("key"), n), F.lit(n)).cast("int"))
    task = F.col("pid") * splits + F.pmod(F.xxhash64("key"), F.lit(splits)).cast("int") if splits > 1 else F.col("pid")
    placed = partition_by(placed, n * splits, task).sortWithinPartitions("key")
    given = T._parse_datatype_string(reducer.schema)
    schema = pa.schema([*(pa.field(f.name, to_arrow_type(f.dataType)) for f in given), pa.field("_pid", pa.int32())])
    none = (None,) * len(given)
    fn = reducer.fn

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (key, pid), group in itertools.groupby(_rows(batches), key=lambda r: (r[0], r[2])):
            out += [(*row, None) for row in fn(key, (value for _, value, _ in group), pid)]
            out.append((*none, pid))
            if len(out) >= 10_000:
                yield _batch(list(zip(*out)), schema)
                out = []
        if out:
            yield _batch(list(zip(*out)), schema)

    return placed.mapInArrow(run, T.StructType([*given.fields, T.StructField("_pid", T.IntegerType())]))


def rows_only(out: DataFrame) -> DataFrame:
    return out.filter(F.col("_pid").isNull()).drop("_pid")


def group_reduce(pairs: DataFrame, reducer: PythonReducer, n: int, partitioner: Partitioner = djb2_partition, splits: int = 1) -> DataFrame:
    """Place pairs by the partitioner, sort by key, call the reducer once per key.

    Values stream: a group may span any number of Arrow batches and is never
    held in memory unless the reducer keeps it. A reducer may stop early.
    """
    return rows_only(reduced(pairs, reducer, n, partitioner, splits))


def map_reduce(
    df: DataFrame,
    mapper: Mapper | Callable[[DataFrame], DataFrame],
    reducer: PythonReducer | Sequence[Column],
    *,
    combiner: Combiner | None = None,
    partitioner: Partitioner | None = None,
    num_partitions: int = 40,
    partial: bool = True,
) -> DataFrame:
    """A job without side effects: input ``(doc, value)``, output the reducer's rows.

    With aggregate columns as reducer, the combiner is Spark's own partial
    aggregate (with ``partial=False`` every pair is shipped as it is) and a given
    partitioner places the (already aggregated) keys.
    """
    if isinstance(reducer, PythonReducer):
        return group_reduce(pairs_only(emitted(df, mapper, combiner)), reducer, num_partitions, partitioner or djb2_partition, _splits(df, num_partitions))  # type: ignore[arg-type]
    mapped = mapper(df)  # type: ignore[call-arg,arg-type]
    grouped = (mapped if partial else mapped.repartition(num_partitions, "key")).groupBy("key").agg(*reducer)
    if partitioner is None:
        return grouped
    return partition_by(grouped, num_partitions, partitioner(F.col("key"), num_partitions)).sortWithinPartitions("key")
