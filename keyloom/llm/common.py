"""What several operators of this package share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.sources.tables import bounded_batches

__all__ = ["ascii_lower", "bounded_batches", "claim", "freed", "memo", "parts_of", "removed", "saved", "shared_dir", "texts"]

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; without it, one of this machine, where this machine is all there is."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="keyloom-")


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in ``spark.checkpoint.dir``; the shuffle files behind it go at once.

    Without that they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    before = spark.conf.get(_FREE_SHUFFLES)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan takes the setting of the time it is made
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


def freed(df: DataFrame) -> None:
    """Delete the files of a result of ``saved`` that is no longer read."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        removed(df.sparkSession, file.get())


def parts_of(spark: SparkSession, path: str) -> dict[int, str]:
    """Files of a written table by the number of the task that wrote them."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    names = [f.getPath().getName() for f in found]
    return {int(n.split("-")[1]): f"{path}/{n}" for n in names if n.startswith("part-")}


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that is no longer read."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


_MEMOS: dict[str, Callable[[], None]] = {}


def memo(name: str, clear: Callable[[], None]) -> None:
    """Register what a worker process keeps between tasks, and how to let it go."""
    _MEMOS[name] = clear


def claim(name: str) -> None:
    """At the start of a task: let go of what other operators keep, as Spark reuses workers."""
    for other, clear in _MEMOS.items():
        if other != name:
            clear()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def texts(column: pa.Array) -> Iterator[str]:
    """Strings of an Arrow column, null as empty."""
    for value in column.to_pylist():
        yield value if value is not None else ""
