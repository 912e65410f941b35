"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine >= t are at most ``eps = sqrt(2 - 2 t)`` apart, and so
are their projections on any orthonormal axes. Vectors are projected on the
leading principal axes, which a bounded sample gives (they steer pruning only;
any axes give the same result), and sorted by label and by the eps-wide grid
cells of the first ``GRID`` axes. Consecutive runs of the order are packed into
blocks with their bounding box. Pairs of sequence intervals are joined from the
root down: a pair whose boxes are more than eps apart is dropped, any other is
split eightfold, down to pairs of blocks; inside a task the same recursion goes
on down to ``LEAF`` rows, where a matrix product gives the cosines.

Exactly equal vectors of a label are one class from the start. A pair of blocks
returns, for each class, the number of vectors linked to it, and a spanning
forest of the links it found: all links are counted, none is shipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from keyloom.llm.common import bounded_batches, saved
from keyloom.llm.graph import components, min_labels
from keyloom.llm.vectors import matrix, per_block, sample, unit, usable

COSINE = 0.93
GRID, BOX, LEAF, FAN = 4, 16, 256, 8
SAMPLE_ROWS = 4096
_SLACK = 1e-9


def principal_axes(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` leading principal directions of the rows of ``x``."""
    centred = x - x.mean(axis=0)
    return np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :k]


def _axes_by_dim(reps: DataFrame) -> dict[int, np.ndarray]:
    rows = sample(reps, "rep", SAMPLE_ROWS).select("v").collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["v"]), []).append(r["v"])
    return {d: principal_axes(unit(np.array(vs, np.float64)), min(BOX, d)) for d, vs in by.items()}


def _project(x: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    d = x.shape[1]
    y = x @ axes[d] if d in axes else x[:, :BOX]
    return np.pad(y, ((0, 0), (0, BOX - y.shape[1])))


def _far(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column, eps: float) -> Column:
    """True if two boxes are provably more than ``eps`` apart."""
    gap = lambda lo, hi: F.zip_with(lo, hi, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    apart = F.zip_with(gap(lo_b, hi_a), gap(lo_a, hi_b), lambda a, b: F.greatest(a, b))
    return F.aggregate(apart, F.lit(0.0), lambda s, g: s + g * g) > eps * eps + _SLACK


class _Tile:
    """Links between the rows of two blocks, found by recursive halving."""

    def __init__(self, xa, ya, xb, yb, same: bool, cosine: float):
        self.xa, self.ya, self.xb, self.yb, self.same, self.cosine = xa, ya, xb, yb, same, cosine
        self.eps2 = 2 - 2 * cosine + _SLACK
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def run(self, a0: int, a1: int, b0: int, b1: int) -> None:
        if self.same and b1 <= a0:
            return
        ya, yb = self.ya[a0:a1], self.yb[b0:b1]
        gap = np.maximum(0, np.maximum(yb.min(0) - ya.max(0), ya.min(0) - yb.max(0)))
        if gap @ gap > self.eps2:
            return
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            r, c = np.nonzero(self.xa[a0:a1] @ self.xb[b0:b1].T >= self.cosine)
            r, c = r + a0, c + b0
            if self.same:
                r, c = r[keep := r < c], c[keep]
            self.found.append((r, c))
            return
        if a1 - a0 >= b1 - b0:
            m = (a0 + a1) // 2
            self.run(a0, m, b0, b1)
            self.run(m, a1, b0, b1)
        else:
            m = (b0 + b1) // 2
            self.run(a0, a1, b0, m)
            self.run(a0, a1, m, b1)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        self.run(0, len(self.xa), 0, len(self.xb))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *(r for r, _ in self.found)]), np.concatenate([none, *(c for _, c in self.found)])


def _blocks(reps: DataFrame, eps: float) -> DataFrame:
    """``(g, idx, lo, hi, data)``: the grid order cut into blocks, numbered within each group."""
    axes = _axes_by_dim(reps)
    cells = [f"c{i}" for i in range(GRID)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            sizes = pa.compute.list_value_length(v).to_numpy()
            cell = np.zeros((len(v), GRID), np.int64)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                cell[at] = np.floor(_project(unit(matrix(v.take(pa.array(at)))), axes)[:, :GRID] / eps)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(cell[:, i]) for i in range(GRID))], names=[*b.schema.names, *cells])

    schema = T.StructType([*reps.schema.fields, *(T.StructField(c, T.LongType()) for c in cells)])
    order = ["g", *cells, "rep"]
    placed = reps.mapInArrow(place, schema).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.select("g", "rep", "mult", "v", F.spark_partition_id().alias("pid"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {"g": None, "x": [], "rep": [], "mult": [], "n": 0, "seq": 0, "pid": 0}

        def flush() -> Iterator[pa.RecordBatch]:
            if held["n"]:
                x = np.concatenate(held["x"])
                y = _project(x, axes)
                data = [np.concatenate(held["rep"]).tobytes(), np.concatenate(held["mult"]).tobytes(), x.tobytes(), y.tobytes()]
                cols = [[held["g"]], [held["pid"]], [held["seq"]], [y.min(0).tolist()], [y.max(0).tolist()], *([d] for d in data)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)
                held["seq"] += 1
            held.update(x=[], rep=[], mult=[], n=0)

        names = ["g", "pid", "seq", "lo", "hi", "rep", "mult", "x", "y"]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), *[pa.binary()] * 4]
        for b in batches:
            groups = b.column("g").to_pylist()
            cuts = [i for i in range(len(groups)) if i == 0 or groups[i] != groups[i - 1]] + [len(groups)]
            for lo, hi in zip(cuts, cuts[1:]):
                if groups[lo] != held["g"]:
                    yield from flush()
                    held.update(g=groups[lo], pid=b.column("pid")[lo].as_py(), seq=0)
                x = unit(matrix(b.column("v").slice(lo, hi - lo)))
                rep, mult = (b.column(c).slice(lo, hi - lo).to_numpy() for c in ("rep", "mult"))
                most = per_block(x.shape[1])
                at = 0
                while at < len(x):
                    take = min(most - held["n"], len(x) - at)
                    held["x"].append(x[at : at + take])
                    held["rep"].append(rep[at : at + take])
                    held["mult"].append(mult[at : at + take])
                    held["n"] += take
                    at += take
                    if held["n"] >= most:
                        yield from flush()
        yield from flush()

    out = "g string, pid int, seq bigint, lo array<double>, hi array<double>, rep binary, mult binary, x binary, y binary"
    packed = saved(placed.mapInArrow(pack, out))
    # Number blocks along each group: what comes before is a sum over partitions (one row per group and partition).
    per = packed.groupBy("g", "pid").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("g").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return packed.join(per.select("g", "pid", before.alias("_off")), ["g", "pid"]).withColumn("idx", F.col("seq") + F.col("_off"))


def _block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """``(g, a, b)`` with ``a <= b``: block pairs that may hold a link, from the root interval down."""
    base = saved(blocks.select("g", F.col("idx").alias("node"), "lo", "hi"))
    top = base.agg(F.max("node")).first()[0]
    if top is None:
        return blocks.select("g", F.col("idx").alias("a"), F.col("idx").alias("b"))
    levels = [base]
    edge = lambda f, c: F.array(*[f(F.get(c, F.lit(i))) for i in range(BOX)]).alias(c)
    while top > 0:
        up = levels[-1].groupBy("g", F.floor(F.col("node") / FAN).cast("bigint").alias("node")).agg(edge(F.min, "lo"), edge(F.max, "hi"))
        levels.append(saved(up))
        top //= FAN
    pairs = levels[-1].select("g", F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(levels[:-1]):
        child = level.withColumn("up", F.floor(F.col("node") / FAN).cast("bigint"))
        side = lambda s: child.select("g", F.col("up").alias(s), F.col("node").alias(f"{s}2"), F.col("lo").alias(f"{s}_lo"), F.col("hi").alias(f"{s}_hi"))  # noqa: B023, E731
        near = pairs.join(side("a"), ["g", "a"]).join(side("b"), ["g", "b"])
        near = near.filter((F.col("a2") <= F.col("b2")) & ~_far(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi"), eps))
        pairs = saved(near.select("g", F.col("a2").alias("a"), F.col("b2").alias("b")))
    return pairs


def _join_blocks(pairs: DataFrame, blocks: DataFrame, cosine: float) -> DataFrame:
    """``(rep, other, n)``: ``n`` vectors linked to ``rep`` inside a pair; ``other`` the root of its tree there."""
    data = ["rep", "mult", "x", "y"]
    side = lambda s: blocks.select("g", F.col("idx").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in data])
    joined = pairs.join(side("a"), ["g", "a"]).join(side("b"), ["g", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c, kind: np.frombuffer(batch.column(c)[row].as_py(), kind)  # noqa: B023, E731
                same = batch.column("a")[row] == batch.column("b")[row]
                side = {}
                for s in "ab":
                    rep, mult = get(f"rep_{s}", np.int64), get(f"mult_{s}", np.int64)
                    side[s] = rep, mult, get(f"x_{s}", np.float64).reshape(len(rep), -1), get(f"y_{s}", np.float64).reshape(len(rep), -1)
                (ra, ma, xa, ya), (rb, mb, xb, yb) = side["a"], side["b"]
                r, c = _Tile(xa, ya, xb, yb, same, cosine).links()
                if not len(r):
                    continue
                if same:
                    rep, c2 = ra, c
                    n = np.bincount(r, mb[c], len(rep)) + np.bincount(c, ma[r], len(rep))
                else:
                    rep, c2 = np.concatenate([ra, rb]), c + len(ra)
                    n = np.concatenate([np.bincount(r, mb[c], len(ra)), np.bincount(c, ma[r], len(rb))])
                rank = np.argsort(rep, kind="stable")
                place = np.empty(len(rep), np.int64)
                place[rank] = np.arange(len(rep))
                root = rep[rank][min_labels(len(rep), place[r], place[c2])][place]
                keep = n > 0
                arrays = [pa.array(rep[keep]), pa.array(root[keep]), pa.array(n[keep].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=["rep", "other", "n"])

    return joined.mapInArrow(run, "rep bigint, other bigint, n bigint")


def near_duplicates(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row.

    Vectors link if their labels are equal and not null, they are equally long
    and their cosine (in doubles) is at least ``cosine``. Unusable vectors (null,
    empty, zero, with null or non-finite components), null labels and null keys
    link with nothing and stand alone (a null key: null component, not kept).
    Rows that repeat a key are separate vectors but one node of the graph: what
    one of them links with, their common component holds. Other columns are not looked at.
    """
    bounded_batches(df.sparkSession)
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    v = F.col(vector)
    rows = df.select(F.col(key).cast("bigint").alias("k"), F.col(label).cast("string").alias("l"), v.alias("v"))
    rows = rows.withColumn("ok", usable(F.col("v")) & F.col("l").isNotNull() & F.col("k").isNotNull())
    group = F.concat_ws(":", F.size("v").cast("string"), "l")
    plain = F.transform("v", lambda x: x + F.lit(0).cast("float"))  # -0.0 equals 0.0
    hashes = {"h1": F.xxhash64(F.lit(1), plain), "h2": F.xxhash64(plain, F.lit(2))}
    rows = rows.withColumns({c: F.when(F.col("ok"), x) for c, x in ({"g": group} | hashes).items()})
    # The 128 bits of two hashes stand for the vector: copies meet by partial aggregation.
    classes = rows.filter("ok").groupBy("g", "h1", "h2").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("v").alias("v"))
    classes = saved(classes)
    blocks = saved(_blocks(classes.select("g", "rep", "mult", "v"), eps).select("g", "idx", "lo", "hi", "rep", "mult", "x", "y"))
    tiles = saved(_join_blocks(_block_pairs(blocks, eps), blocks, cosine))
    totals = tiles.groupBy("rep").agg(F.sum("n").alias("linked"))
    member = rows.select("k", "g", "h1", "h2").join(classes.select("g", "h1", "h2", "rep", "mult"), ["g", "h1", "h2"], "left")
    member = saved(member.join(totals, "rep", "left").select("k", "rep", "mult", "linked"))
    edges = tiles.select(F.col("rep").alias("u"), F.col("other").alias("v")).union(member.filter("rep <> k").select(F.col("k").alias("u"), F.col("rep").alias("v")))
    comp = components(edges).withColumnRenamed("node", "k")
    n = F.coalesce("linked", F.lit(0)) + F.coalesce(F.col("mult") - 1, F.lit(0))
    out = member.join(comp, "k", "left").select("k", n.cast("bigint").alias("n_links"), F.coalesce("component", "k").alias("component_id"))
    return out.select(F.col("k").alias(key), "n_links", "component_id", F.coalesce(F.col("k") == F.col("component_id"), F.lit(False)).alias("kept"))
