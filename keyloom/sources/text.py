"""Text files as rows of ``(doc, value)``.

``doc`` is the path exactly as the caller wrote it (not a percent-encoded URI),
so provenance survives blanks and relative paths.
"""

from __future__ import annotations

import math
import os
import warnings
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 256 * 1024
#: Names of input files are broadcast up to so many characters.
NAMES_BYTES = 32 << 20


class NoReadableInput(ValueError):
    """None of the given paths can be read."""


def _local(path: str) -> bool:
    return "://" not in path


def _spelled(path: str) -> str:
    """Absolute, as the JVM's working directory need not be Python's."""
    return os.path.abspath(path) if _local(path) else path


def readable(paths: Sequence[str]) -> list[str]:
    """The paths that exist, in order and with repetitions; a warning for each that does not."""
    good = []
    for path in paths:
        if _local(path) and not os.path.isfile(path):
            warnings.warn(f"skipping unreadable input {path!r}", stacklevel=3)
        else:
            good.append(path)
    return good


def _escape_glob(path: str) -> str:
    out = path
    for ch in "\\*?[]{}":
        out = out.replace(ch, "\\" + ch)
    return out


def read_text(spark: SparkSession, paths: Sequence[str], *, whole: bool = False, skip_errors: bool = False) -> DataFrame:
    """Rows ``(doc, value)``: one per line, or one per file with ``whole``.

    Missing paths are skipped with a warning; if none is left the call raises
    ``NoReadableInput``. A path given twice contributes its rows twice. The
    scan is one splittable ``spark.read.text`` over all distinct paths: the
    name written by the caller comes back through a join with a small table of
    file URIs, so the plan does not grow with the number of files. ``skip_errors`` also leaves out
    files that vanish or break while they are read, instead of failing the job.
    """
    good = readable(paths)
    if not good:
        raise NoReadableInput("no input path can be read")
    times = Counter(good)
    reader = spark.read.option("ignoreMissingFiles", skip_errors).option("ignoreCorruptFiles", skip_errors)
    base = reader.text([_escape_glob(_spelled(p)) for p in dict.fromkeys(good)], wholetext=whole)
    uri = F.regexp_replace("_metadata.file_path", "^file:/+", "file:///")
    return base.select(uri.alias("_uri"), "value").join(_names(spark, times), "_uri").select("doc", "value")


def _names(spark: SparkSession, times: Counter) -> DataFrame:
    """``(_uri, doc)``: Spark's file URI and the caller's spelling, a row for each time the path was given."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    rows = []
    for p, n in times.items():
        as_uri = path(_spelled(p)).toUri()
        rows += [("file://" + as_uri.getRawPath() if _local(p) else as_uri.toString(), p)] * n
    names = spark.createDataFrame(rows, "_uri string, doc string")
    return F.broadcast(names) if sum(len(u) + len(p) for u, p in rows) <= NAMES_BYTES else names


def input_manifest(spark: SparkSession, paths: Sequence[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(file_idx, doc, bytes, chunks)`` of each given path; an unreadable one has size 0."""
    rows = []
    for i, path in enumerate(paths):
        size = os.path.getsize(path) if os.path.isfile(path) else 0
        rows.append((i, path, size, math.ceil(size / chunk_bytes)))
    return spark.createDataFrame(rows, "file_idx int, doc string, bytes bigint, chunks bigint")
