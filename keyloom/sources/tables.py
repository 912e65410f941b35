"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores if it is read in fewer pieces than there are (a small table in one file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, so long texts cannot fill a Python worker.

    What the caller has set stays; all operators use the same bounds, so it does not matter which comes first.
    """
    given = spark.conf.getAll
    for name, value in ((_BATCH_BYTES, str(8 << 20)), (_BATCH_ROWS, "4096")):
        if name not in given:
            spark.conf.set(name, value)
