"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

A text is its UTF-8 bytes. Every string of ``LENGTH`` bytes has one *anchor*
inside, chosen by its own bytes (see ``suffix.anchors``): the suffixes that begin
at anchors are all a search for strings of that length needs. A suffix array here
is those suffixes of a batch of texts, sorted by the fingerprint of their first
``GRAM`` bytes and then by that of all bytes within ``REACH`` of them. (Order by
fingerprint instead of by the bytes spreads evenly over partitions; equal strings
stand together either way.)

``SuffixFamily`` keeps the arrays of earlier batches in levels, each a table in the
shared folder of as many sorted files as there are partitions; equal anchors lie
in files of the same number. A new batch is sorted once; a task then merges the
files of its number, of the batch and of all levels, as sorted streams, and scans
the runs that the batch takes part in. Arrays of the same level are merged the same
way, without a shuffle, into the next, so ``n`` batches leave at most ``log2 n + 1`` arrays.

A scan yields, for runs of equal ``GRAM`` bytes:

* suffixes whose whole surrounding equals another's: every string over the
  anchor repeats, nothing more to look at;
* else, one suffix per distinct surrounding: their bytes are fetched and, for
  each of the ``REACH + 1`` strings of ``LENGTH`` bytes over the anchor, grouped.
  A run with more than ``HOT`` surroundings has its strings grouped by Spark
  instead of inside one task.

Fingerprints are 64 bits. Texts are known by 92 bits of two hashes; copies of a
text are recognised by them before anything is compared, and a task that meets
several brings the entries of one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import bounded_batches, claim, parts_of, removed, saved, shared_dir
from keyloom.llm.suffix import _BASE, _BYTE, GRAM, LENGTH, REACH, Prints, anchors, mix

BATCHES = 4
HOT = 200_000
HELD = 4_000_000
SEEN = 1_000_000
_FULL, _PART, _HOT = 1, 2, 4
_U = np.uint64
_ENTRY = "fp bigint, h bigint, uid bigint, pos int"


def text_id(text: Column) -> Column:
    return F.xxhash64(F.lit(41), text, F.octet_length(text))


def more_id(text: Column) -> Column:
    """28 bits more, to tell texts of one ``text_id`` apart."""
    return F.xxhash64(F.lit(43), text).bitwiseAND(F.lit((1 << 28) - 1))


def _told_apart(rows: DataFrame) -> DataFrame:
    """Rows with ``uid`` and ``more``, a new ``uid`` for texts that differ in the second only (3 among 10^10 texts, so they are listed)."""
    apart = rows.groupBy("uid").agg(F.min("more").alias("a"), F.max("more").alias("b")).filter("a <> b").select("uid")
    listed = [r["uid"] for r in apart.collect()]
    return rows.withColumn("uid", F.when(F.col("uid").isin(listed), F.xxhash64(F.lit(47), "uid", "more")).otherwise(F.col("uid"))) if listed else rows


def suffix_array(texts: DataFrame) -> DataFrame:
    """Entries ``(fp, h, uid, pos)`` of the rows ``(uid, t)``; not sorted yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substrings")
        seen: set[int] = set()
        for b in batches:
            parts: list[tuple] = []
            for uid, text in zip(b.column("uid").to_pylist(), b.column("t").cast(pa.binary())):
                raw = text.as_py()
                if len(raw) < LENGTH or uid in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(uid)
                prints = Prints(raw)
                pos, fp = anchors(prints)
                low = np.maximum(0, pos - REACH)
                around = prints.at(low, np.minimum(prints.n, pos + LENGTH))
                h = mix(around + (pos - low).astype(_U))
                parts.append((fp.view(np.int64), h.view(np.int64), np.full(len(pos), uid), pos.astype(np.int32)))
            if parts:
                cols = [pa.array(np.concatenate(c)) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays(cols, names=["fp", "h", "uid", "pos"])

    return texts.mapInArrow(run, _ENTRY)


def _marks(fp: np.ndarray, h: np.ndarray, uid: np.ndarray, pos: np.ndarray, fresh: np.ndarray, open_end: bool, hot: int) -> pa.RecordBatch:
    """Marked entries of whole runs that hold a fresh entry; with ``open_end`` the run goes on in another piece."""
    order = np.lexsort((pos, uid, h, fp))
    fp, h, uid, pos, fresh = (x[order] for x in (fp, h, uid, pos, fresh))
    new = np.ones(len(fp), bool)  # the first of equal (fp, h, uid, pos): copies of a text bring the same entry again
    new[1:] = (fp[1:] != fp[:-1]) | (h[1:] != h[:-1]) | (uid[1:] != uid[:-1]) | (pos[1:] != pos[:-1])
    fp, h, uid, pos, fresh = fp[new], h[new], uid[new], pos[new], fresh[new]
    f_start = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])])
    h_start = np.flatnonzero(first)
    h_len = np.diff(np.append(h_start, len(fp)))
    full = np.repeat(h_len > 1, h_len)
    kinds = np.repeat(np.add.reduceat(first.astype(np.int64), f_start), np.diff(np.append(f_start, len(fp))))
    part = first & ((kinds > 1) | open_end)
    mark = full * _FULL + part * (_PART + _HOT * ((kinds > hot) | open_end))
    met = np.repeat(np.maximum.reduceat(fresh, f_start), np.diff(np.append(f_start, len(fp)))) | open_end
    keep = (mark > 0) & met
    return pa.RecordBatch.from_arrays([pa.array(uid[keep]), pa.array(pos[keep].astype(np.int64) * 8 + mark[keep])], names=["uid", "mark"])


_Rows = list[np.ndarray]


def _stream(path: str) -> Iterator[_Rows]:
    """A sorted file in pieces of its columns."""
    fs, at = pa.fs.FileSystem.from_uri(path)
    with fs.open_input_file(at) as source:
        for b in pq.ParquetFile(source).iter_batches(1 << 17, columns=["fp", "h", "uid", "pos"]):
            yield [c.to_numpy() for c in b.columns]


def _cat(parts: list[_Rows]) -> _Rows:
    return [np.concatenate(c) for c in zip(*parts)]


def _merge(streams: list[Iterator[_Rows]], fresh: list[bool], most: int) -> Iterator[tuple[_Rows, bool]]:
    """Runs of equal anchors from sorted streams: ``(fp, h, uid, pos, from a fresh stream)``, whole, or in pieces (then True) where one has more than ``most`` entries."""
    none = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.int32)]
    held, open_, going_on = [none] * len(streams), [True] * len(streams), None

    def take(cuts: list[int]) -> _Rows:
        out = _cat([[*(x[:c] for x in rows), np.full(c, f)] for rows, c, f in zip(held, cuts, fresh)])
        held[:] = [[x[c:] for x in rows] for rows, c in zip(held, cuts)]
        return out

    while True:
        for i, rows in enumerate(held):
            if open_[i] and not len(rows[0]):
                held[i], open_[i] = (more, True) if (more := next(streams[i], None)) is not None else (rows, False)
        if not any(len(rows[0]) for rows in held):
            if not any(open_):
                return
            continue
        reading = [int(rows[0][-1]) for rows, o in zip(held, open_) if o]
        if going_on is not None:
            cuts = [int(np.searchsorted(rows[0], going_on, "right")) for rows in held]
            if sum(cuts):
                yield take(cuts), True
                continue
            going_on = None
        if not reading:
            yield take([len(rows[0]) for rows in held]), False
            return
        limit = min(reading)  # anchors before it are complete
        cuts = [int(np.searchsorted(rows[0], limit)) for rows in held]
        if sum(cuts):
            yield take(cuts), False
            continue
        if sum(int(np.searchsorted(rows[0], limit, "right")) for rows in held) > most:
            going_on = limit
            continue
        i = next(i for i, (rows, o) in enumerate(zip(held, open_)) if o and rows[0][-1] == limit)
        if (more := next(streams[i], None)) is None:
            open_[i] = False
        else:
            held[i] = _cat([held[i], more])


class SuffixFamily:
    """Suffix arrays of the batches so far, at most one a level, in a folder of their own."""

    def __init__(self, spark: SparkSession, hot: int = HOT, most: int = HELD) -> None:
        self.spark, self.hot, self.most = spark, hot, most
        self.folder = f"{shared_dir(spark)}/suffixes-{uuid.uuid4().hex}"
        self.n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, str] = {}
        self.written = 0

    def _write(self, rows: DataFrame) -> str:
        self.written += 1
        path = f"{self.folder}/{self.written}"
        rows.write.option("compression", "zstd").parquet(path)
        return path

    def _tasks(self, arrays: list[str], fresh: list[bool], finish: Callable[[Iterator[tuple[_Rows, bool]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """One task per number of a file: ``finish`` gets the merged runs of the arrays' files of this number."""
        files = [parts_of(self.spark, a) for a in arrays]
        most = self.most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("substrings")
            for b in batches:
                for k in b.column("id").to_pylist():
                    own = [(f[k], new) for f, new in zip(files, fresh) if k in f]
                    yield from finish(_merge([_stream(path) for path, _ in own], [new for _, new in own], most))

        return self.spark.range(0, self.n, 1, self.n).mapInArrow(run, schema)

    def add(self, texts: DataFrame, *, keep: bool = True) -> DataFrame:
        """Add a batch ``(uid, t)``. Returns ``(uid, mark)``, ``mark = pos * 8 + flags``, of the suffixes in runs that the batch has part in.

        A run of more than ``most`` entries is marked piece by piece, each suffix
        for comparison. ``keep=False`` for a last batch: nothing is merged.
        """
        own = self._write(suffix_array(texts).repartition(self.n, "fp").sortWithinPartitions("fp", "h", "uid", "pos"))
        hot = self.hot

        def scan(runs: Iterator[tuple[_Rows, bool]]) -> Iterator[pa.RecordBatch]:
            for rows, open_end in runs:
                yield _marks(*rows, open_end, hot)

        def store(runs: Iterator[tuple[_Rows, bool]]) -> Iterator[pa.RecordBatch]:
            for rows, _ in runs:
                order = np.lexsort((rows[3], rows[2], rows[1], rows[0]))
                yield pa.RecordBatch.from_arrays([pa.array(x[order]) for x in rows[:4]], names=["fp", "h", "uid", "pos"])

        arrays = [*self.levels.values(), own]
        found = saved(self._tasks(arrays, [a == own for a in arrays], scan, "uid bigint, mark bigint").distinct())
        if keep:
            level, merged = 0, [own]
            while level in self.levels:
                merged.append(self.levels.pop(level))
                level += 1
            self.levels[level] = own if len(merged) == 1 else self._write(self._tasks(merged, [True] * len(merged), store, _ENTRY))
            for old in merged if len(merged) > 1 else []:
                removed(self.spark, old)
        return found

    def close(self) -> None:
        removed(self.spark, self.folder)


_WIDE = 2 * REACH
_OFFSETS = np.concatenate([-1 - np.arange(REACH), GRAM + np.arange(REACH)])


def _around(raw: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes to the left (nearest first) and right of each anchor, zero beyond the text; how many there are of each."""
    padded = np.zeros(len(raw) + 2 * LENGTH, np.uint8)
    padded[LENGTH : LENGTH + len(raw)] = raw
    return padded[(pos + LENGTH)[:, None] + _OFFSETS], np.minimum(pos, REACH), np.minimum(len(raw) - pos - GRAM, REACH)


def _strings(fp: np.ndarray, wide: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(l, valid, key)`` for each string with ``l`` bytes before the anchor: where it exists, and its fingerprint with the anchor's."""
    power = [_U(pow(_BASE, j, 1 << 64)) for j in range(REACH + 1)]
    after = np.zeros(len(fp), _U)
    for r in range(REACH):
        after += _BYTE[wide[:, REACH + r]] * power[r]
    before, seed = np.zeros(len(fp), _U), mix(fp.view(_U))
    for l in range(REACH + 1):  # noqa: E741
        yield l, (l <= left) & (REACH - l <= right), mix(mix(before + seed) ^ (after + _U(l)))
        if l < REACH:
            before += _BYTE[wide[:, l]] * power[l]
            after -= _BYTE[wide[:, REACH + REACH - l - 1]] * power[REACH - l - 1]


def _repeated(fp: np.ndarray, wide: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each row and ``l``: does its string occur in another row?"""
    out = np.zeros((len(fp), REACH + 1), bool)
    for l, valid, key in _strings(fp, wide, left, right):  # noqa: E741
        at = np.flatnonzero(valid)
        order = at[np.argsort(key[at], kind="stable")]
        k = key[order]
        same = k[1:] == k[:-1]
        out[order[1:][same], l] = True
        out[order[:-1][same], l] = True
    return out


def _covered(uid: np.ndarray, pos: np.ndarray, dup: np.ndarray) -> pa.RecordBatch:
    """Byte intervals of the repeated strings."""
    edge = np.diff(np.pad(dup.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)  # one past the run
    start, end = pos[row] - (last - 1), pos[row] - first + LENGTH
    return pa.RecordBatch.from_arrays([pa.array(uid[row]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["uid", "start", "end"])


def _surroundings(marked: DataFrame, want_hot: bool) -> DataFrame:
    """``(fp, uid, pos, left, right, wide)`` of the marked anchors whose bytes must be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substrings")
        for b in batches:
            for uid, text, marks in zip(b.column("uid").to_pylist(), b.column("t").cast(pa.binary()), b.column("marks")):
                m = marks.values.to_numpy()
                pos = np.unique(m[((m & _PART) > 0) & (((m & _HOT) > 0) == want_hot)] >> 3)
                if not len(pos):
                    continue
                prints = Prints(text.as_py())
                fp = prints.at(pos, pos + GRAM).view(np.int64)
                for lo in range(0, len(pos), 4096):
                    p = pos[lo : lo + 4096]
                    wide, left, right = _around(prints.raw, p)
                    data = pa.Array.from_buffers(pa.binary(_WIDE), len(p), [None, pa.py_buffer(np.ascontiguousarray(wide))]).cast(pa.binary())
                    cols = [pa.array(fp[lo : lo + 4096]), pa.array(np.full(len(p), uid)), pa.array(p.astype(np.int32)), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), data]
                    yield pa.RecordBatch.from_arrays(cols, names=["fp", "uid", "pos", "left", "right", "wide"])

    return marked.select("uid", "t", "marks").mapInArrow(run, "fp bigint, uid bigint, pos int, left int, right int, wide binary")


def _unpack(b: pa.RecordBatch) -> list[np.ndarray]:
    wide = np.frombuffer(b"".join(b.column("wide").to_pylist()), np.uint8).reshape(-1, _WIDE)
    return [*(b.column(c).to_numpy() for c in ("fp", "uid", "pos", "left", "right")), wide]


def _compare(around: DataFrame) -> DataFrame:
    """``(uid, start, end)``: repeated strings among surroundings of the same anchor, run by run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substrings")
        held: list[np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            held = _unpack(b) if held is None else [np.concatenate(x) for x in zip(held, _unpack(b))]
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut >= 8192:
                fp, uid, pos, left, right, wide = (x[:cut] for x in held)
                yield _covered(uid, pos, _repeated(fp, wide, left, right))
                held = [x[cut:] for x in held]
        if held is not None:
            fp, uid, pos, left, right, wide = held
            yield _covered(uid, pos, _repeated(fp, wide, left, right))

    return around.repartition("fp").sortWithinPartitions("fp").mapInArrow(run, "uid bigint, start int, end int")


def _compare_hot(around: DataFrame) -> DataFrame:
    """The same for runs of any size: one row per string, grouped by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substrings")
        for b in batches:
            if not b.num_rows:
                continue
            fp, uid, pos, left, right, wide = _unpack(b)
            for l, valid, key in _strings(fp, wide, left, right):  # noqa: E741
                cols = [key[valid].view(np.int64), uid[valid], (pos[valid] - l).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["w", "uid", "start"])

    strings = around.mapInArrow(run, "w bigint, uid bigint, start int").distinct()
    place = F.struct("uid", "start")
    twice = strings.groupBy("w").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("w")
    return strings.join(twice, "w", "left_semi").select("uid", "start", (F.col("start") + LENGTH).alias("end"))


def _cut(raw: bytes, marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """What is left of a text, and the removed runs as rows (start, end)."""
    n = len(raw)
    pos = (marks >> 3)[(marks & _FULL) > 0]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.concatenate([np.maximum(0, pos - REACH), starts]), 1)
    np.add.at(edge, np.concatenate([np.minimum(pos, n - LENGTH) + LENGTH, ends]), -1)
    gone = np.cumsum(edge[:n]) > 0
    step = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
    runs = np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], 1)
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), runs


def dedup(df: DataFrame, *, key: str = "doc_id", text: str = "text", batches: int = BATCHES, texts: bool = True, hot: int = HOT) -> DataFrame:
    """Every row of ``df`` with the bytes removed that a repeated string of ``LENGTH`` bytes covers.

    ``texts=True``: all columns, ``text`` being what is left (a character cut in
    two is dropped whole), and ``removed_spans array<struct<start,end>>`` in bytes.
    ``texts=False``: ``key, n_bytes, n_removed, n_spans, kept_sha256`` only.
    Null text counts as empty (and stays null in the first form); texts shorter than
    ``LENGTH`` lose nothing; a text that occurs in several rows loses all; an empty
    table gives an empty result; a column of ``df`` named ``removed_spans`` is replaced.
    """
    bounded_batches(df.sparkSession)
    base = df.drop("removed_spans")
    others = [c for c in base.columns if c != text] if texts else [key]
    value, seen = F.coalesce(F.col(text), F.lit("")), F.xxhash64(F.col(key).cast("string"))
    carried = F.struct(F.col(text).isNull().alias("none"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)])
    rows = base.select(text_id(value).alias("uid"), more_id(value).alias("more"), value.alias("t"), carried.alias("r"), seen.alias("seen"))
    size = F.octet_length("t")
    rows = _told_apart(rows)
    family, found = SuffixFamily(df.sparkSession, hot), None
    for i in range(batches):
        part = rows.select("uid", "t").filter((size >= LENGTH) & (F.pmod("uid", F.lit(batches)) == i))
        marks = family.add(part, keep=i < batches - 1)
        found = marks if found is None else found.unionByName(marks)
    family.close()
    any_hot = bool(found.filter(F.col("mark").bitwiseAND(F.lit(_HOT)) > 0).limit(1).count())

    # What is known of each text; of a text's copies, the one with the least key stands for all in comparisons.
    copies = rows.groupBy("uid").agg(F.count(F.lit(1)).alias("mult"), F.min("seen").alias("least"))
    known = copies.join(found.groupBy("uid").agg(F.collect_set("mark").alias("marks")), "uid", "left")
    joined = rows.join(known, "uid").withColumns({"whole": (F.col("mult") > 1) & (size >= LENGTH), "lead": F.col("seen") == F.col("least")})
    cut = F.col("marks").isNotNull() & ~F.col("whole")
    compared = F.col("marks").isNotNull() & F.col("lead")
    need = cut | compared | F.lit(texts) & ~F.col("whole")
    digest = F.when(~cut, F.sha2(F.when(F.col("whole"), F.lit("")).otherwise(F.col("t")).cast("binary"), 256)) if not texts else F.lit(None).cast("string")
    state = joined.select(
        "uid", "r", "whole", cut.alias("cut"), size.cast("bigint").alias("n_bytes"), digest.alias("sha"),
        F.when(need, F.col("t")).alias("t"), F.when(cut | compared, F.col("marks")).alias("marks"), compared.alias("compared"),
    )
    state = saved(state)
    lead = state.filter("compared")
    spans = _compare(_surroundings(lead, False))
    if any_hot:
        spans = spans.unionByName(_compare_hot(_surroundings(lead, True)))
    code = F.shiftleft(F.col("start").cast("bigint"), 32) + F.col("end")
    per_text = spans.groupBy("uid").agg(F.collect_list(code).alias("spans"))
    left = state.filter("cut").join(per_text, "uid", "left").select("r", "n_bytes", "t", "marks", "spans")
    out = _removed(left, texts).unionByName(_untouched(state.filter(~F.col("cut")), texts))
    fields = [F.col("r")[f"c{i}"].alias(c) for i, c in enumerate(others)]
    if not texts:
        return out.select(*fields, "n_bytes", "n_removed", "n_spans", "kept_sha256")
    by_name = dict(zip(others, fields)) | {text: F.when(~F.col("r")["none"], F.col("kept")).alias(text)}
    return out.select(*[by_name[c] for c in base.columns], "removed_spans")


_SPANS = "array<struct<start:int,end:int>>"


def _untouched(state: DataFrame, texts: bool) -> DataFrame:
    """Texts that no comparison is needed for: all of it goes (a copied text) or nothing."""
    whole, n = F.col("whole"), F.col("n_bytes")
    if not texts:
        return state.select("r", "n_bytes", F.when(whole, n).otherwise(0).cast("bigint").alias("n_removed"), whole.cast("bigint").alias("n_spans"), F.col("sha").alias("kept_sha256"))
    one = F.array(F.struct(F.lit(0).alias("start"), n.cast("int").alias("end")))
    return state.select("r", F.when(whole, F.lit("")).otherwise(F.col("t")).alias("kept"), F.when(whole, one).otherwise(F.array()).cast(_SPANS).alias("removed_spans"))


def _removed(state: DataFrame, texts: bool) -> DataFrame:
    """Cut the marked strings and the compared ones out of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substrings")
        for b in batches:
            kept, runs = [], []
            for text, marks, spans in zip(b.column("t").cast(pa.binary()), b.column("marks"), b.column("spans")):
                code = spans.values.to_numpy() if spans.is_valid else np.zeros(0, np.int64)
                left, gone = _cut(text.as_py(), marks.values.to_numpy(), code >> 32, code & 0xFFFFFFFF)
                kept.append(left.decode(errors="ignore") if texts else hashlib.sha256(left).hexdigest())
                runs.append(gone)
            if texts:
                value = pa.array([[{"start": int(s), "end": int(e)} for s, e in g] for g in runs], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                cols = {"r": b.column("r"), "kept": pa.array(kept, pa.string()), "removed_spans": value}
            else:
                gone = [int((g[:, 1] - g[:, 0]).sum()) for g in runs]
                cols = {"r": b.column("r"), "n_bytes": b.column("n_bytes"), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array([len(g) for g in runs], pa.int64()), "kept_sha256": pa.array(kept, pa.string())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    r = state.schema["r"]
    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    if texts:
        schema = T.StructType([r, T.StructField("kept", T.StringType()), T.StructField("removed_spans", spans_type)])
    else:
        schema = T.StructType([r, *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])
    return state.mapInArrow(run, schema)
