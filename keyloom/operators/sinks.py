"""Text sinks: one file per non-empty partition, or a single sorted file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fs(df: DataFrame, path: str):
    sc = df.sparkSession.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    return sc._jvm, hadoop.getFileSystem(sc._jsc.hadoopConfiguration()), hadoop


def write_parts(df: DataFrame, line: str, output_dir: str, *, clear: bool = True) -> list[str]:
    """Write ``line`` of each row: partition ``i`` becomes ``part-0000i.txt``, rows as they stand.

    Spark commits the text to a folder inside first; only then does earlier output
    go and are the new files renamed (on the shared file system, by the driver, one
    call per file), so a job that fails leaves what was there. Empty partitions leave no file. Without
    ``clear`` earlier output stays and the new lines are appended to it: the
    old file's lines come first.
    """
    jvm, fs, out = _fs(df, output_dir)
    staging = jvm.org.apache.hadoop.fs.Path(out, "_staging")
    fs.mkdirs(out)
    df.select(F.col(line).alias("value")).write.mode("overwrite").text(staging.toString())
    if clear:
        for status in fs.listStatus(out):
            if not status.getPath().getName() == "_staging":
                fs.delete(status.getPath(), True)
    written = []
    for status in fs.listStatus(staging):
        name = status.getPath().getName()
        if not name.startswith("part-") or status.getLen() == 0:
            continue
        final = f"part-{int(name.split('-')[1]):05d}.txt"
        target = jvm.org.apache.hadoop.fs.Path(out, final)
        if not fs.exists(target):
            _rename(fs, status.getPath(), target)
        elif _appends(fs):
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(fs.open(status.getPath()), fs.append(target), 1 << 16, True)
        else:
            _concat(jvm, fs, target, status.getPath())
        written.append(final)
    fs.delete(staging, True)
    return sorted(written)


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"cannot rename {source} to {target}")


def _appends(fs) -> bool:
    return fs.getScheme() in ("hdfs", "viewfs")


def _concat(jvm, fs, target, extra) -> None:
    """Old lines, then new ones, through a temporary file and a rename."""
    joined = jvm.org.apache.hadoop.fs.Path(target.getParent(), "_" + target.getName())
    sink = fs.create(joined, True)
    for path in (target, extra):
        source = fs.open(path)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, sink, 1 << 16, False)
        source.close()
    sink.close()
    fs.delete(target, False)
    _rename(fs, joined, target)


def write_single(df: DataFrame, key: str, line: str, path: str) -> None:
    """One globally sorted text file (for small results: a single task writes it)."""
    jvm, fs, out = _fs(df, path)
    staging = jvm.org.apache.hadoop.fs.Path(out.getParent(), "_" + out.getName())
    df.orderBy(key).select(F.col(line).alias("value")).coalesce(1).write.mode("overwrite").text(staging.toString())
    fs.delete(out, True)
    part = next((s.getPath() for s in fs.listStatus(staging) if s.getPath().getName().startswith("part-")), None)
    if part is None:
        fs.create(out, True).close()
    else:
        _rename(fs, part, out)
    fs.delete(staging, True)
