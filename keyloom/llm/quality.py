"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

``score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))``

The pairwise part is the sum of ``<v_i, v_j> x_i x_j`` over all pairs, got in
time linear in the number of features. Words of the whole text are hashed to
``WORDS`` buckets; shares of character classes, word and line statistics and the
metadata column ``n_chars`` are binned, one feature a bin. The fit uses at most
``TRAIN_ROWS`` labelled documents with ``TRAIN_VALUES`` features in all, the first
in hash order; every document is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from keyloom.llm.common import bounded_batches, claim, memo

WORDS = 1 << 14
BINS = 16
RANK = 8
TRAIN_ROWS = 12_000
TRAIN_VALUES = 16_000_000
FOLDS = 5
ACCEPT = 0.3
_MEMO = 200_000
_CLASSES = 10
_STATS = _CLASSES + 9
SIZE = WORDS + _STATS * BINS


def _class_table() -> np.ndarray:
    t = np.full(256, 7, np.uint8)  # other symbols
    for chars, c in ((b" \t", 0), (b"\n\r", 1), (b".,;:'\"-()?", 6), (b"!", 8)):
        t[list(chars)] = c
    for lo, hi, c in ((65, 91, 2), (97, 123, 3), (48, 58, 4), (128, 256, 5)):
        t[lo:hi] = c
    t[[*range(9), 11, 12, *range(14, 32), 127]] = 9
    return t


_TABLE = _class_table()


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        self[word] = b = zlib.crc32(word.encode()) & (WORDS - 1)
        return b


_BUCKETS = _Buckets()
memo("quality", _BUCKETS.clear)


def _structure(text: str, words: np.ndarray, counts: np.ndarray, n: int, n_chars: int | None) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    size = max(1, len(raw))
    share = np.bincount(_TABLE[raw], minlength=_CLASSES) / size
    lines = text.split("\n")
    ratios = [len(words) / max(1, n), (counts.max() / n) if n else 0.0, len(set(lines)) / len(lines)]
    logs = [np.log2(1 + n), np.log2(1 + len(lines)), 1.5 * np.log2(1 + len(text) / len(lines)), 2 * np.log2(1 + size / max(1, n)), 1.5 * np.log2(1 + max(map(len, lines)))]
    meta = 0 if n_chars is None or n_chars < 0 else 1 + np.log2(1 + n_chars)
    bins = np.concatenate([np.sqrt(share) * (BINS - 1), np.array(ratios) * (BINS - 1), logs, [meta]])
    return WORDS + np.arange(_STATS) * BINS + np.clip(bins, 0, BINS - 1).astype(np.int64)


def features(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (distinct) and values of one whole text."""
    words = text.split()
    ids, counts = np.unique(np.fromiter(map(_BUCKETS.__getitem__, words), np.int64, len(words)), return_counts=True)
    x = np.log1p(counts)
    x /= max(1e-9, float(np.sqrt((x * x).sum())))
    own = _structure(text, ids, counts, len(words), n_chars)
    return np.concatenate([ids, own]), np.concatenate([x, np.full(_STATS, 0.5)])


@dataclass
class Machine:
    b: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, ids: np.ndarray, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid of rows that begin at ``start`` in the flat features."""
        vx = self.v[ids] * x[:, None]
        s = np.add.reduceat(vx, start, axis=0)
        square = np.add.reduceat((vx * vx).sum(1), start)
        return self.b + np.add.reduceat(self.w[ids] * x, start) + 0.5 * ((s * s).sum(1) - square)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        start = np.cumsum([0, *(len(i) for i, _ in rows[:-1])])
        z = self.raw(np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), start)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, *, rank: int = RANK, epochs: int = 8, updates: int = 400, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Logistic loss, Adam over mini-batches: ``epochs`` over the rows, or as many as make ``updates`` steps. One class or no rows give the smoothed base rate."""
    rng = np.random.default_rng(seed)
    p = (y.sum() + 1) / (len(y) + 2)
    m = Machine(float(np.log(p / (1 - p))), np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, rank)))
    if len(set(y.tolist())) < 2:
        m.v[:] = 0
        return m
    state = {k: (np.zeros_like(a), np.zeros_like(a)) for k, a in (("w", m.w), ("v", m.v))}
    bm, bv, t = 0.0, 0.0, 0
    for _ in range(max(epochs, -(-updates * batch // len(rows)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            ids = np.concatenate([rows[i][0] for i in own])
            x = np.concatenate([rows[i][1] for i in own])
            size = np.array([len(rows[i][0]) for i in own])
            start = np.cumsum(size) - size
            z = m.raw(ids, x, start)
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[own]) / len(own)
            each = np.repeat(g, size) * x
            vx = m.v[ids] * x[:, None]
            s = np.repeat(np.add.reduceat(vx, start, axis=0), size, axis=0)
            dv = each[:, None] * (s - vx)
            gw = np.bincount(ids, each, SIZE) + decay * m.w
            gv = np.stack([np.bincount(ids, dv[:, f], SIZE) for f in range(rank)], 1) + decay * m.v
            t += 1
            for k, a, grad in (("w", m.w, gw), ("v", m.v, gv)):
                m1, m2 = state[k]
                m1 += 0.1 * (grad - m1)
                m2 += 0.001 * (grad * grad - m2)
                a -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
            gb = g.sum()
            bm, bv = bm + 0.1 * (gb - bm), bv + 0.001 * (gb * gb - bv)
            m.b -= rate * (bm / (1 - 0.9**t)) / (np.sqrt(bv / (1 - 0.999**t)) + 1e-8)
    return m


def held_out(key: Column, folds: int = FOLDS) -> Column:
    """True for the fold that is never learnt from: ``crc32(key as text) mod folds = 0``; a null key is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(True))


def train(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars", label: str = "quality", rows: int = TRAIN_ROWS, values: int = TRAIN_VALUES
) -> Machine:
    """Fit on at most ``rows`` labelled documents outside the held-out fold, with at most ``values`` features in all.

    They are the first in hash order of key and text. A key labelled more than
    once counts with its least label; null labels and null keys are left out; of
    documents that share a key, each text counts once.
    """
    bounded_batches(docs.sparkSession)
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("_k")).agg(F.min(label).alias("_y"))
    base = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(n_chars).cast("bigint").alias("n"))
    base = base.withColumn("_t", F.xxhash64(F.lit(11), "_k", "text"))
    # Bounded: at most ``rows`` places, whatever repeats.
    chosen = base.select("_k", "_t").join(known, "_k").distinct().orderBy("_t", "_k").limit(rows)
    picked = base.join(F.broadcast(chosen), ["_k", "_t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        seen: set[int] = set()
        for b in batches:
            once = [i for i, h in enumerate(b.column("_t").to_pylist()) if not (h in seen or seen.add(h))]
            b = b.take(pa.array(once, pa.int64()))
            got = [features(t, n) for t, n in zip(b.column("text").to_pylist(), b.column("n").to_pylist())]
            arrays = [b.column("_t"), b.column("_y").cast(pa.int32())]
            arrays += [pa.array([i.astype(np.int32).tobytes() for i, _ in got], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in got], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["h", "y", "i", "x"])

    found = picked.mapInArrow(run, "h bigint, y int, i binary, x binary").groupBy("h").agg(F.min(F.struct("y", "i", "x")).alias("f")).select("h", "f.*")
    upto = F.sum(F.length("i") / 4).over(W.orderBy("h"))  # one row for each chosen place, so a bounded window
    data, y = [], []
    for r in found.withColumn("upto", upto).filter(F.col("upto") <= values).toLocalIterator():
        data.append((np.frombuffer(r["i"], np.int32), np.frombuffer(r["x"], np.float32)))
        y.append(float(r["y"] > 0))
    return fit(data, np.array(y))


def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        start = np.cumsum([0, *(len(i) for i, _ in rows[:-1])])
        z = self.raw(np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), start)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, *, rank: int = RANK, epochs: int = 8, updates: int = 400, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Logistic loss, Adam over mini-batches: ``epochs`` over the rows, or as many as make ``updates`` steps. One class or no rows give the smoothed base rate."""
    rng = np.random.default_rng(seed)
    p = (y.sum() + 1) / (len(y) + 2)
    m = Machine(float(np.log(p / (1 - p))), np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, rank)))
    if len(set(y.tolist())) < 2:
        m.v[:] = 0
        return m
    state = {k: (np.zeros_like(a), np.zeros_like(a)) for k, a in (("w", m.w), ("v", m.v))}
    bm, bv, t = 0.0, 0.0, 0
    for _ in range(max(epochs, -(-updates * batch // len(rows)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            ids = np.concatenate([rows[i][0] for i in own])
            x = np.concatenate([rows[i][1] for i in own])
            size = np.array([len(rows[i][0]) for i in own])
            start = np.cumsum(size) - size
            z = m.raw(ids, x, start)
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[own]) / len(own)
            each = np.repeat(g, size) * x
            vx = m.v[ids] * x[:, None]
            s = np.repeat(np.add.reduceat(vx, start, axis=0), size, axis=0)
            dv = each[:, None] * (s - vx)
            gw = np.bincount(ids, each, SIZE) + decay * m.w
            gv = np.stack([np.bincount(ids, dv[:, f], SIZE) for f in range(rank)], 1) + decay * m.v
            t += 1
            for k, a, grad in (("w", m.w, gw), ("v", m.v, gv)):
                m1, m2 = state[k]
                m1 += 0.1 * (grad - m1)
                m2 += 0.001 * (grad * grad - m2)
                a -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
            gb = g.sum()
            bm, bv = bm + 0.1 * (gb - bm), bv + 0.001 * (gb * gb - bv)
            m.b -= rate * (bm / (1 - 0.9**t)) / (np.sqrt(bv / (1 - 0.999**t)) + 1e-8)
    return m


def held_out(key: Column, folds: int = FOLDS) -> Column:
    """True for the fold that is never learnt from: ``crc32(key as text) mod folds = 0``; a null key is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars", label: str = "quality", rows: int = TRAIN_ROWS) -> Machine:
    """Fit on at most ``rows`` labelled documents outside the held-out fold.

    A key labelled more than once counts with its least label; null labels and
    null keys are left out; of repeated documents each counts.
    """
    bounded_batches(docs.sparkSession)
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("_k")).agg(F.min(label).alias("_y"))
    present = known.join(docs.select(F.col(key).alias("_k")).distinct(), "_k", "left_semi")
    chosen = F.broadcast(present.orderBy(F.xxhash64(F.lit(11), "_k"), "_k").limit(rows))
    base = docs.select(F.col(key).alias("_k"), F.col(text).alias("text"), F.col(n_chars).cast("bigint").alias("n")).join(chosen, "_k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for b in batches:
            got = [features(t or "", n) for t, n in zip(b.column("text").to_pylist(), b.column("n").to_pylist())]
            arrays = [b.column("_k"), b.column("_y").cast(pa.int32())]
            arrays += [pa.array([i.astype(np.int32).tobytes() for i, _ in got], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in got], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["k", "y", "i", "x"])

    kind = dict(base.dtypes)["_k"]
    found = sorted(base.mapInArrow(run, f"k {kind}, y int, i binary, x binary").collect(), key=lambda r: (r["k"], r["i"]))[:rows]
    data = [(np.frombuffer(r["i"], np.int32), np.frombuffer(r["x"], np.float32)) for r in found]
    return fit(data, np.array([float(r["y"] > 0) for r in found]))


def score(docs: DataFrame, machine: Machine, *, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars", accept: float = ACCEPT) -> DataFrame:
    """All columns of ``docs`` and ``held_out boolean, score double, predicted int``, which replace columns of these names.

    Null and empty texts are scored by their structure alone; every row gets a score.
    """
    bounded_batches(docs.sparkSession)
    base = docs.drop("held_out", "score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for b in batches:
            sizes = b.column(n_chars).to_pylist()
            scores: list[float] = []
            for at in range(0, b.num_rows, 256):
                rows = [features(t or "", n) for t, n in zip(b.column(text).slice(at, 256).to_pylist(), sizes[at : at + 256])]
                scores += machine.score(rows).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, "score"])

    out = base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())]))
    return out.withColumns({"held_out": held_out(F.col(key)), "predicted": (F.col("score") >= accept).cast("int")})
