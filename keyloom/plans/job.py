"""Job description, validation and the run that writes files and a report."""

from __future__ import annotations

import logging
import os
import resource
import sys
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from keyloom.metrics import Metrics, last_stage
from keyloom.operators.mapreduce import Combiner, Mapper, PythonReducer, emitted, map_reduce, pairs_only, reduced, rows_only
from keyloom.operators.partitioners import Partitioner, djb2_partition
from keyloom.operators.sinks import write_parts
from keyloom.sources.text import input_manifest, read_text, readable

log = logging.getLogger("keyloom")


def combiner_disabled() -> bool:
    """``MR_DISABLE_COMBINER=1`` ships every pair: no Python combiner, no partial aggregate before the exchange."""
    return os.environ.get("MR_DISABLE_COMBINER") == "1"


@dataclass(frozen=True)
class Job:
    """``mapper``/``reducer``: see ``map_reduce`` (aggregates come from a function, as columns need a session). ``line`` renders a result row as text.

    ``readers`` and ``mappers`` are accepted, checked and reported; a Spark task
    both reads and maps, so ``mappers`` only acts as a lower bound on the
    number of map tasks. ``reducers`` is the number of output partitions.
    """

    mapper: Mapper | Callable[[DataFrame], DataFrame] | None = None
    reducer: PythonReducer | Callable[[], Sequence[Column]] | None = None
    line: Callable[[DataFrame], Column] | None = None
    combiner: Combiner | None = None
    partitioner: Partitioner | None = djb2_partition
    readers: int = 1
    mappers: int = 20
    reducers: int = 40
    output_dir: str = "output"
    clear_output: bool = True
    metrics_file: str | None = "metrics_report.txt"
    verbose: bool = False
    allow_cli: bool = True

    def validate(self) -> Job:
        for name in ("mapper", "reducer", "partitioner"):
            if getattr(self, name) is None:
                raise ValueError(f"a job needs a {name}")
        for name, top in (("readers", 10), ("mappers", 1000), ("reducers", 1000)):
            if not 1 <= getattr(self, name) <= top:
                raise ValueError(f"{name} must be between 1 and {top}, not {getattr(self, name)}")
        return self

    def effective_combiner(self) -> Combiner | None:
        return None if combiner_disabled() else self.combiner

    def with_options(self, **changes) -> Job:
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


@dataclass(frozen=True)
class Result:
    files: list[str]
    output_dir: str
    metrics: Metrics


def run(spark: SparkSession, job: Job, paths: Sequence[str]) -> Result:
    """Validate, read, map, reduce, write one text file per non-empty partition, report."""
    job.validate()
    good = readable(paths)
    metrics = Metrics(files=len(paths), readers=job.readers, mappers=job.mappers, reducers=job.reducers)
    sizes = input_manifest(spark, good).agg(F.sum("chunks"), F.sum("bytes")).first()
    metrics.chunks, metrics.bytes_read = (int(x or 0) for x in sizes)
    before, began, first = resource.getrusage(resource.RUSAGE_SELF), time.monotonic(), last_stage(spark)
    df = read_text(spark, good)
    if df.rdd.getNumPartitions() < min(job.mappers, metrics.chunks):
        df = df.repartition(min(job.mappers, metrics.chunks))
    emits, keys = Observation("emits"), Observation("keys")
    per_partition = F.histogram_numeric("_pid", F.lit(max(2, job.reducers))).alias("keys")  # a bin for each partition: exact
    if isinstance(job.reducer, PythonReducer):
        rows = emitted(df, job.mapper, job.effective_combiner()).observe(emits, F.coalesce(F.sum("emits"), F.lit(0)).alias("rows"))
        out = rows_only(reduced(pairs_only(rows), job.reducer, job.reducers, job.partitioner).observe(keys, per_partition))
    else:
        mapper = lambda rows: job.mapper(rows).observe(emits, F.count(F.lit(1)).alias("rows"))
        out = map_reduce(df, mapper, job.reducer(), partitioner=job.partitioner, num_partitions=job.reducers, partial=not combiner_disabled())
        pid = F.pmod(job.partitioner(F.col("key"), job.reducers), F.lit(job.reducers))
        out = out.withColumn("_pid", pid).observe(keys, per_partition).drop("_pid")
    rendered = job.line(out) if job.line else F.concat_ws("\t", *out.columns)
    files = write_parts(out.select(rendered.alias("_line")), "_line", job.output_dir, clear=job.clear_output)
    after = resource.getrusage(resource.RUSAGE_SELF)
    metrics.wall_s = time.monotonic() - began
    metrics.user_s, metrics.sys_s = after.ru_utime - before.ru_utime, after.ru_stime - before.ru_stime
    metrics.emits = emits.get["rows"]
    metrics.take_keys(keys.get["keys"] or [])
    if job.metrics_file is not None:
        metrics.take_stages(spark, first)
        metrics.write(job.metrics_file)
    summary = (
        f"{len(paths)} inputs, {job.readers} readers, {job.mappers} mappers, {job.reducers} reducers: {len(files)} files in {job.output_dir}, "
        f"{metrics.wall_s:.2f} s wall, driver {metrics.user_s:.2f} s user and {metrics.sys_s:.2f} s system"
    )
    log.info(summary)
    if job.verbose:
        print(summary, file=sys.stderr)
    return Result(files, job.output_dir, metrics)
