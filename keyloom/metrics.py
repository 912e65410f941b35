"""Counters of a run, and the text report written from them.

Figures that only exist in a lock-and-queue runtime (queue waits and depth,
lock contention) have no Spark counterpart; the report says so. In place of waits
for a partition's lock it lists what reduce tasks waited for their shuffle blocks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NONE = "n/a (tasks pull their input; nothing is queued or locked)"


def _stages(spark: SparkSession, after: int) -> list:
    """Spark's figures of the stages that ran after the one with this number."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    empty = sc._gateway.new_array(sc._jvm.double, 0)
    found = sc._jsc.sc().statusStore().stageList(None, False, False, empty, sc._jvm.java.util.ArrayList())
    return [s for s in (found.apply(i) for i in range(found.size())) if s.stageId() > after and s.numCompleteTasks()]


def last_stage(spark: SparkSession) -> int:
    return max((s.stageId() for s in _stages(spark, -1)), default=-1)


def partition_keys(keys: DataFrame, pid: str = "partition") -> DataFrame:
    """Keys reduced in each partition."""
    return keys.groupBy(pid).agg(F.count(F.lit(1)).alias("keys"))


def top_partitions(stats: DataFrame, n: int = 10) -> DataFrame:
    """Partitions with the most keys, the smaller id first among equals."""
    return stats.orderBy(F.desc("keys"), F.asc("partition")).limit(n)


def balance(stats: DataFrame, n: int) -> DataFrame:
    """Mean and sample deviation of keys over all ``n`` partitions, empty ones included."""
    total = F.coalesce(F.sum("keys"), F.lit(0)).cast("double")
    squares = F.coalesce(F.sum(F.col("keys") * F.col("keys")), F.lit(0)).cast("double")
    mean = total / n
    spread = F.sqrt(F.greatest(squares - total * total / n, F.lit(0.0)) / max(n - 1, 1))
    return stats.agg(F.round(mean, 4).alias("avg_keys"), F.round(spread, 4).alias("sd_keys"))


def ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


@dataclass
class Metrics:
    files: int = 0
    readers: int = 1
    mappers: int = 20
    reducers: int = 40
    wall_s: float = 0.0
    user_s: float = 0.0
    sys_s: float = 0.0
    stages_ms: dict[str, float] = field(default_factory=dict)
    chunks: int = 0
    bytes_read: int = 0
    emits: int | None = None
    map_tasks: int = 0
    map_cpu_s: float = 0.0
    reduce_cpu_s: float = 0.0
    shuffle_rows: int = 0
    shuffle_bytes: int = 0
    keys: int = 0
    top: list[tuple[int, int]] = field(default_factory=list)
    waits: list[tuple[int, int]] = field(default_factory=list)

    def take_keys(self, bins: Iterable) -> None:
        """Keys reduced in each partition, as pairs of partition and count (a partition may come more than once)."""
        per: Counter[int] = Counter()
        for x, y in bins:
            per[round(x)] += round(y)
        self.keys = sum(per.values())
        self.top = sorted(per.items(), key=lambda kv: (-kv[1], kv[0]))[:10]

    def take_stages(self, spark: SparkSession, after: int) -> None:
        """Durations, CPU seconds and shuffle figures. What reads no shuffle is map, the rest (which sorts too) is reduce."""
        store = spark.sparkContext._jsc.sc().statusStore()
        self.stages_ms = {"map": 0.0, "sort and reduce": 0.0}
        for s in _stages(spark, after):
            reads, cpu = s.shuffleReadRecords() > 0, s.executorCpuTime() / 1e9
            if s.submissionTime().isDefined() and s.completionTime().isDefined():
                self.stages_ms["sort and reduce" if reads else "map"] += s.completionTime().get().getTime() - s.submissionTime().get().getTime()
            if reads:
                self.reduce_cpu_s += cpu
                tasks = store.taskList(s.stageId(), s.attemptId(), 100_000)
                for t in (tasks.apply(i) for i in range(tasks.size())):
                    if t.taskMetrics().isDefined():
                        self.waits.append((t.index(), t.taskMetrics().get().shuffleReadMetrics().fetchWaitTime()))
            else:
                self.map_cpu_s += cpu
                self.map_tasks += s.numCompleteTasks()
                self.shuffle_rows += s.shuffleWriteRecords()
                self.shuffle_bytes += s.shuffleWriteBytes()
        self.waits = sorted(self.waits, key=lambda w: (-w[1], w[0]))[:10]

    def report(self) -> str:
        lines = ["== Job configuration ==", f"input files: {self.files}", f"readers: {self.readers}", f"mappers: {self.mappers}", f"reducers: {self.reducers}"]
        lines += ["", "== Timing (s) ==", f"wall: {self.wall_s:.3f}", f"driver user: {self.user_s:.3f}", f"driver system: {self.sys_s:.3f}", f"tasks' JVM cpu: {self.map_cpu_s + self.reduce_cpu_s:.3f}"]
        lines += ["", "== Stages (ms) ==", *(f"{k}: {v:.1f}" for k, v in self.stages_ms.items())]
        lines += ["", "== Input ==", f"chunks: {self.chunks}", f"bytes: {self.bytes_read}", f"bytes per chunk: {ratio(self.bytes_read, self.chunks):.1f}"]
        lines += ["", "== Map ==", f"tasks: {self.map_tasks}", f"pairs emitted: {'n/a' if self.emits is None else self.emits}"]
        lines += ["", "== Flush to the shuffle ==", f"rows: {self.shuffle_rows}", f"bytes: {self.shuffle_bytes}"]
        lines += [f"rows per task: {ratio(self.shuffle_rows, self.map_tasks):.1f}", f"bytes per task: {ratio(self.shuffle_bytes, self.map_tasks):.1f}"]
        lines += ["", "== Work queue ==", _NONE, "", "== Partition locks ==", _NONE]
        lines += ["", "== Reduce ==", f"keys: {self.keys}", f"keys per partition: {ratio(self.keys, self.reducers):.1f}"]
        lines += ["", "== Partitions with most keys ==", *(f"{p}\t{k}" for p, k in self.top)]
        lines += ["", "== Tasks that waited longest for shuffle blocks (ms) ==", *(f"{p}\t{w}" for p, w in self.waits)]
        return "\n".join(lines) + "\n"

    def write(self, path: str) -> None:
        with open(path, "w") as out:
            out.write(self.report())
