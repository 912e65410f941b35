"""N-gram Jaccard join by signature trees.

Texts link if the Jaccard similarity of their shingle sets is at least
``PERCENT`` / 100. The join is exact; nothing below drops a pair that qualifies.

*Routing.* All of a corpus in one tree would leave every node pair near the root
unpruned, so sets are first routed to cells, by two prefix filters. Of ``n``
tokens, ``n - ceil(t n)`` at most are missing in a linked set. With ``p(n) = n -
ceil(t n) + 1``, two linked sets of ``m <= n`` tokens have ``p(m)`` in common among
the ``2 p - 1`` of least hash of each. These are shuffled once, and counted: how
many sets hold a token there. In order of that count, the first token in common
is then among the first ``2 p(n) - p(m)`` of the larger set and ``p(m)`` of the
smaller, where ``m >= ceil(t n)``; ``2 p(n) - p(ceil(t n))`` covers both. Tokens that no other set
holds come first, so texts that only share a passage are left with nothing, and
the passages of many texts come last. The sets that meet at a token are a cell;
equal cells are one. Cells that overlap form clusters. A cluster of up to ``BLOCK``
sets, or with fewer pairs than its cells have in all, is treated as one cell, so
that copies of copies meet once. In other clusters the cells stay, but for those
whose members all have the same larger home cell, which add nothing.

*Trees.* In a cell the sets, ordered by size, are the leaves of a tree of fan-out
``FAN``. A node holds the OR of its sets' token bitmaps and the range of their
sizes; sets ``x, y`` below nodes ``A, B`` have ``|x & y| <= popcount(A & B) +
min(a, b)``, where ``a, b`` are the most bits that a set of the node loses to
collisions. Two trees are walked in parallel, level by level; a node pair whose
bound cannot reach the least overlap that its sizes ask for is dropped. Pairs of
leaves are verified on the sets themselves.

A cell of more than ``BLOCK`` sets is cut into size classes (a link never spans
more than two adjacent ones) and hashed blocks of them; blocks of small sets hold up
to ``WIDE`` times as many. A set is written once for each of its cells: blocks that meet
others go to files in the folder that executors share, and a task reads the blocks that it pairs. A
pair that meets in several cells counts in the first. What leaves a task is, per
set, the number of texts linked to it and a spanning forest.

Only texts whose place may be needed are moved to where the tasks of their sets are
known: a bitmap of bounded size over hashes of the places says which (``Places``).

Copies (equal sets) are one class from the start. Sets are known by 64-bit hashes
of their tokens, and tokens are 64-bit hashes of shingles.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import bounded_batches, claim, freed, parts_of, removed, saved, shared_dir
from keyloom.llm.graph import components, min_labels
from keyloom.llm.shingles import shingle_set

PERCENT = 80
FAN, BLOCK = 8, 256
WIDE, BLOCK_BYTES = 4, 16 << 20
#: Blocks that a row of a task pairs with its own, and rows of results that a task holds.
PARTNERS, TILE_ROWS = 16, 500_000
HELD = 4_000_000
PLACE_BITS = 1 << 26
_U = np.uint64


def _set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _scan(docs: DataFrame) -> DataFrame:
    """``(k, th, id, n)``: the set of each of the texts ``(k, th, t)`` and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        for b in batches:
            sets = map(shingle_set, b.column("t").to_pylist())
            ids, sizes = zip(*((_set_id(s), len(s)) for s in sets)) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("th"), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], names=["k", "th", "id", "n"])

    return docs.select("k", "th", "t").mapInArrow(run, "k bigint, th bigint, id bigint, n bigint")


def least_overlap(n: int, percent: int) -> int:
    """Tokens of a set of ``n`` that a linked one must have."""
    return -(-percent * n // 100)


def _prefix(n: int, percent: int) -> int:
    return n - least_overlap(n, percent) + 1


def _first_tokens(docs: DataFrame, percent: int) -> DataFrame:
    """``(token, id)``: the ``2 p - 1`` tokens of least hash of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        for b in batches:
            seen: set[int] = set()
            tokens, ids = [], []
            for t in b.column("t").to_pylist():
                s = shingle_set(t)
                i = _set_id(s)
                if len(s) and i not in seen:
                    seen.add(i)
                    first = s[: 2 * _prefix(len(s), percent) - 1]
                    tokens.append(first)
                    ids.append(np.full(len(first), i, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(ids))], names=["token", "id"])

    return docs.select("t").mapInArrow(run, "token bigint, id bigint")


def _token_runs(
    rows: DataFrame, schema: str, whole: Callable[[np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], piece: Callable[[np.ndarray, np.ndarray], pa.RecordBatch], held_rows: int
) -> DataFrame:
    """Walk rows ``(token, id)`` in order: ``whole`` gets complete runs of tokens, ``piece`` pieces of a run too long to hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        token, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        going_on = None
        for b in batches:
            token, ids = np.concatenate([token, b.column("token").to_numpy()]), np.concatenate([ids, b.column("id").to_numpy()])
            if going_on is not None and (more := int(np.searchsorted(token, going_on, "right"))):
                yield piece(token[:more], ids[:more])
                token, ids = token[more:], ids[more:]
            if not len(token):
                continue
            going_on = None
            cut = int(np.searchsorted(token, token[-1]))
            if cut:
                yield from whole(token[:cut], ids[:cut])
                token, ids = token[cut:], ids[cut:]
            elif len(token) > held_rows:
                going_on = token[0]
                yield piece(token, ids)
                token, ids = token[:0], ids[:0]
        if len(token):
            yield from whole(token, ids)

    return rows.repartition("token").sortWithinPartitions("token", "id").mapInArrow(run, schema)


def _distinct(token: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows without repetitions (copies bring theirs again), and the start and length of each token's run."""
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (ids[1:] != ids[:-1])
    token, ids = token[new], ids[new]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    return token, ids, start, np.diff(np.append(start, len(token)))


def _shared(first: DataFrame, held_rows: int = HELD) -> DataFrame:
    """``(id, token, df)`` of tokens that several sets hold; ``df`` of a run too long to hold is ``held_rows``."""
    names = ["id", "token", "df"]

    def whole(token: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        token, ids, _, size = _distinct(token, ids)
        df = np.repeat(size, size)
        keep = df > 1
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(token[keep]), pa.array(np.minimum(df[keep], held_rows))], names=names)

    def piece(token: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        token, ids, _, _ = _distinct(token, ids)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(token), pa.array(np.full(len(ids), held_rows))], names=names)

    return _token_runs(first, "id bigint, token bigint, df bigint", whole, piece, held_rows)


def _routed(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``(token, id)``: of the first tokens of each set those that fewest sets hold, as many as a link may need, less those that no other holds."""
    own = shared.groupBy("id").agg(F.collect_set(F.struct("df", "token")).alias("own")).join(classes.select("id", "n"), "id")
    least = lambda n: F.floor((n * percent + 99) / 100)
    p = lambda n: n - least(n) + 1
    total = F.least(F.col("n"), 2 * p(F.col("n")) - 1)
    take = (2 * p(F.col("n")) - p(least(F.col("n"))) - (total - F.size("own"))).cast("int")
    routed = own.filter(take > 0).select("id", F.explode(F.slice(F.array_sort("own"), F.lit(1), take)).alias("t"))
    return routed.select(F.col("t.token").alias("token"), "id")


def _cells(routed: DataFrame, held_rows: int = HELD) -> DataFrame:
    """``(cell, id)`` of sets that meet at a token; a cell is named by its members, one too long to hold by its token."""

    def members(token: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        token, ids, start, size = _distinct(token, ids)
        many = np.flatnonzero(size > 1)
        if len(many):
            names = [_set_id(ids[start[i] : start[i] + size[i]]) for i in many]
            keep = np.repeat(size > 1, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, np.int64), size[many])), pa.array(ids[keep])], names=["cell", "id"])

    def piece(token: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(ids)], names=["cell", "id"])

    return _token_runs(routed, "cell bigint, id bigint", members, piece, held_rows)


def _size_class(n: Column, percent: int) -> Column:
    return F.floor(F.log(n.cast("double")) / float(np.log(100 / percent) + 1e-9)).cast("int")


def _block(cell: Column | str, cls: Column | str, b: Column | str) -> Column:
    return F.xxhash64(cell, cls, b)


def _targets(met: DataFrame, classes: DataFrame, percent: int, block: int) -> DataFrame:
    """``(id, cells, targets)`` from distinct ``(cell, id)``: the cells of each set, and its block in each.

    A block ``b`` of the ``nb`` of its size class meets the later ones, and the ``above`` of the next class; ``alone`` says that there is no other.
    """
    least = saved(met.groupBy("cell").agg(F.min("id").alias("v"), F.count(F.lit(1)).alias("n")))
    cluster = saved(components(met.join(least, "cell").select(F.col("id").alias("u"), "v")))
    sets = cluster.groupBy("component").agg(F.count(F.lit(1)).alias("k"))
    work = least.join(cluster, least["v"] == cluster["node"]).groupBy("component").agg(F.sum(F.col("n") * F.col("n")).alias("work"))
    whole = sets.join(work, "component").filter((F.col("k") <= block) | (F.col("k") * F.col("k") <= F.col("work"))).select("component")
    whole = cluster.join(whole, "component").select(F.xxhash64(F.lit(17), "component").alias("cell"), F.col("node").alias("id"))
    met = met.join(whole.select("id"), "id", "left_anti").select("cell", "id").union(whole)
    size = met.groupBy("cell").agg(F.count(F.lit(1)).alias("n_cell"))
    sized = saved(met.join(size, "cell"))
    home = sized.groupBy("id").agg(F.max(F.struct("n_cell", "cell")).alias("h")).select("id", F.col("h.cell").alias("home"))
    needed = sized.join(home, "id").groupBy("cell").agg(F.min("home").alias("lo"), F.max("home").alias("hi"))
    needed = needed.filter((F.col("lo") != F.col("hi")) | (F.col("lo") == F.col("cell"))).select("cell")
    kept = saved(sized.join(needed, "cell").join(classes.select("id", "n"), "id"))
    big = F.col("n_cell") > block
    kept = kept.withColumn("cls", F.when(big, _size_class(F.col("n"), percent)).otherwise(0))
    per = F.greatest(F.lit(block), F.least(F.lit(WIDE * block), F.floor(BLOCK_BYTES / (8 * F.max("n")))))
    count = kept.filter(big).groupBy("cell", "cls").agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias("nb"))
    up = count.select("cell", (F.col("cls") - 1).alias("cls"), F.col("nb").alias("above"))
    down = count.select("cell", (F.col("cls") + 1).alias("cls"), F.col("nb").alias("below"))
    placed = kept.join(count.join(up, ["cell", "cls"], "left").join(down, ["cell", "cls"], "left"), ["cell", "cls"], "left")
    own = F.pmod(F.xxhash64("id"), F.coalesce("nb", F.lit(1))).cast("int")
    nb, above, below = (F.coalesce(c, F.lit(d)).cast("int") for c, d in (("nb", 1), ("above", 0), ("below", 0)))
    alone = (nb == 1) & (above == 0) & (below == 0)
    task = F.struct(_block("cell", "cls", "b").alias("block"), "cell", "cls", "b", nb.alias("nb"), above.alias("above"), alone.alias("alone"))
    tasks = placed.withColumn("b", own).select("id", "cell", task.alias("task"))
    return tasks.groupBy("id").agg(F.array_sort(F.collect_list("cell")).alias("cells"), F.collect_list("task").alias("targets"))


class Leaves:
    """Sets of one block with their tree: per level the bitmaps, size ranges and collision counts, leaves first."""

    def __init__(self, sets: list[np.ndarray], bits: int, fan: int = FAN):
        self.sets = sets
        n = np.array([len(s) for s in sets], np.int64)
        maps = np.zeros((len(sets), bits // 8), np.uint8)
        for row, s in zip(maps, sets):
            at = (s & _U(bits - 1)).astype(np.int64)
            np.bitwise_or.at(row, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        maps = maps.view(_U)
        lost = n - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, n, n, lost)]
        while len(self.levels[-1][1]) > 1:
            maps, lo, hi, lost = self.levels[-1]
            at = np.arange(0, len(lo), fan)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(lost, at)))


def _children(at: np.ndarray, n: int, fan: int) -> tuple[np.ndarray, np.ndarray]:
    """For each node of the level above, its children among ``n``: (index into ``at``, child)."""
    kids = at[:, None] * fan + np.arange(fan)
    ok = kids < n
    return np.nonzero(ok)[0], kids[ok]


def walk(a: Leaves, b: Leaves, percent: int, fan: int = FAN, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that may link, by dual traversal; with ``a is b`` only ``i < j``."""
    same = a is b
    depth = max(len(a.levels), len(b.levels)) - 1
    x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for d in range(depth, -1, -1):
        la, lb = a.levels[min(d, len(a.levels) - 1)], b.levels[min(d, len(b.levels) - 1)]
        if d < depth:
            if d < len(a.levels) - 1:
                i, x = _children(x, len(la[1]), fan)
                y = y[i]
            if d < len(b.levels) - 1:
                i, y = _children(y, len(lb[1]), fan)
                x = x[i]
        if same:
            keep = x < y if d == 0 else x <= y
            x, y = x[keep], y[keep]
        # Sizes: the smaller must be at least t times the larger.
        near = (100 * la[2][x] >= percent * lb[1][y]) & (100 * lb[2][y] >= percent * la[1][x])
        x, y = x[near], y[near]
        good = np.zeros(len(x), bool)
        for lo in range(0, len(x), step):
            i, j = x[lo : lo + step], y[lo : lo + step]
            bound = np.bitwise_count(la[0][i] & lb[0][j]).sum(1, dtype=np.int64) + np.minimum(la[3][i], lb[3][j])
            bound = np.minimum(bound, np.minimum(la[2][i], lb[2][j]))
            # J >= t  <=>  (1 + t) overlap >= t (sizes): with the least sizes of both nodes.
            good[lo : lo + step] = (100 + percent) * bound >= percent * (la[1][i] + lb[1][j])
        x, y = x[good], y[good]
    return x, y


def linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    if len(s) > len(t):
        s, t = t, s
    at = np.minimum(np.searchsorted(t, s), len(t) - 1)
    common = int((t[at] == s).sum())
    return 100 * common >= percent * (len(s) + len(t) - common)


def _verified(every: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int, wide: int = 2048) -> np.ndarray:
    """Which of the pairs ``i, j`` of sets are linked: one by one, or where they are many by products of 0/1 matrices over shared tokens."""
    rows, at_i = np.unique(i, return_inverse=True)
    cols, at_j = np.unique(j, return_inverse=True)
    if len(i) > 10_000:
        used, back = np.unique(np.concatenate([rows, cols]), return_inverse=True)
        n = np.array([len(every[u]) for u in used], np.int64)
        _, token, held = np.unique(np.concatenate([every[u] for u in used]), return_inverse=True, return_counts=True)
        number = np.where(held > 1, np.cumsum(held > 1) - 1, -1)[token]
        owner = np.repeat(np.arange(len(used)), n)[number >= 0]
        number = number[number >= 0]
        shared = int((held > 1).sum())
        if len(rows) * len(cols) * shared < 200_000 * len(i):
            by = np.argsort(number, kind="stable")
            owner, number = owner[by], number[by]
            common = np.zeros((len(rows), len(cols)), np.float32)  # exact: counts are below 2 ** 24
            for lo in range(0, shared, wide):
                a, b = np.searchsorted(number, [lo, lo + wide])
                x = np.zeros((len(used), wide), np.float32)
                x[owner[a:b], number[a:b] - lo] = 1
                common += x[back[: len(rows)]] @ x[back[len(rows) :]].T
            both = common[at_i, at_j].astype(np.int64)
            return 100 * both >= percent * (n[back[: len(rows)]][at_i] + n[back[len(rows) :]][at_j] - both)
    return np.array([linked(every[p], every[q], percent) for p, q in zip(i.tolist(), j.tolist())], bool)


def _met_before(rows: list[dict], cell: int) -> np.ndarray:
    """Bitmaps of the cells before ``cell`` in which each set is, too."""
    earlier = [[c for c in r["cells"] if c < cell] for r in rows]
    number = {c: i for i, c in enumerate(dict.fromkeys(c for cs in earlier for c in cs))}
    flags = np.zeros((len(rows), max(64, -(-len(number) // 64) * 64)), bool)
    for row, cs in zip(flags, earlier):
        row[[number[c] for c in cs]] = True
    return np.packbits(flags, axis=1).view(_U)


def _links(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs between two blocks, or inside one; numbers in the second follow those of the first.

    ``before``: pairs with a bit in common there are left out.
    """
    every = [*a, *(b or [])]
    most = max(map(len, every))
    bits = min(1 << 16, max(512, 1 << int(np.ceil(np.log2(4 * most)))))
    by_size = lambda lo, hi: np.array(sorted(range(lo, hi), key=lambda i: (len(every[i]), every[i][0])), np.int64)
    order_a = order_b = by_size(0, len(a))
    ta = tb = Leaves([every[i] for i in order_a], bits)
    if b:
        order_b = by_size(len(a), len(every))
        tb = Leaves([every[i] for i in order_b], bits)
    x, y = walk(ta, tb, percent)
    i, j = order_a[x], order_b[y]
    if before is not None:
        new = np.concatenate([np.zeros(0, bool), *(~(before[i[k : k + 4096]] & before[j[k : k + 4096]]).any(1) for k in range(0, len(i), 4096))])
        i, j = i[new], j[new]
    good = _verified(every, i, j, percent)
    return i[good], j[good]


def _join_task(rows: list[dict], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """``(set id, root id, n)`` of one task's rows."""
    seen: set[tuple[int, int]] = set()
    sides: tuple[list[dict], list[dict], list[dict]] = ([], [], [])
    for r in rows:
        if (r["id"], r["side"]) not in seen:  # a repeated row brings its set again
            seen.add((r["id"], r["side"]))
            sides[r["side"]].append(r)
    left, right = (sides[0], []) if sides[0] else sides[1:]
    if not left or (right == [] and (not sides[0] or len(left) < 2)):
        return None
    a, b = ([np.frombuffer(r["s"], _U) for r in side] for side in (left, right))
    every = [*left, *right]
    cell = rows[0]["cell"]
    before = _met_before(every, cell) if any(r["cells"][0] < cell for r in every) else None
    i, j = _links(a, b or None, percent, before)
    if not len(i):
        return None
    ids, mult = np.array([r["id"] for r in every], np.int64), np.array([r["mult"] for r in every], np.int64)
    n = np.bincount(i, mult[j], len(every)) + np.bincount(j, mult[i], len(every))
    names, at = np.unique(ids, return_inverse=True)
    root = names[min_labels(len(names), at[i], at[j])][at]
    keep = n > 0
    return ids[keep], root[keep], n[keep].astype(np.int64)


class Places:
    """A bitmap, of at most ``most`` bits, of the hashes ``th`` of places; it may also hold others."""

    def __init__(self, th: DataFrame, most: int = PLACE_BITS):
        self.log = min(most.bit_length() - 1, max(10, (16 * th.count()).bit_length()))
        bit = F.shiftrightunsigned("th", 64 - self.log)
        words = th.select(bit.alias("b")).groupBy(F.shiftrightunsigned("b", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("m")).toArrow()
        self.words = np.zeros(1 << (self.log - 6), np.int64)
        self.words[words["w"].to_numpy()] = words["m"].to_numpy()

    def may_hold(self, th: Column) -> Column:
        words, log = self.words.view(_U), self.log

        @F.arrow_udf("boolean")
        def look(th: pa.Array) -> pa.Array:
            at = th.to_numpy().view(_U) >> _U(64 - log)
            return pa.array((words[at >> _U(6)] >> (at & _U(63))) & _U(1) == 1)

        return look(th)


_SET = "block bigint, cell bigint, cls int, b int, nb int, above int, id bigint, mult bigint, cells array<bigint>, s binary"


def _shipped(docs: DataFrame, need: DataFrame) -> DataFrame:
    """The set of each of ``need``, once for each of its targets."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        last = None
        for b in batches:
            out: dict[str, list] = {c: [] for c in schema.names}
            size = 0
            for t, r in zip(b.column("t").to_pylist(), b.select(["id", "mult", "cells", "targets"]).to_pylist()):
                if r["id"] == last:
                    continue  # the same row once more
                s, last = shingle_set(t), r["id"]
                for task in r["targets"]:
                    row = task | {"id": r["id"], "mult": r["mult"], "cells": r["cells"], "s": s.tobytes()}
                    for c, v in out.items():
                        v.append(row[c])
                    size += 8 * len(s)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pydict(out, schema)
                    out, size = {c: [] for c in out}, 0
            if size:
                yield pa.RecordBatch.from_pydict(out, schema)

    small = [(c, pa.int32()) for c in ("cls", "b", "nb", "above")]
    schema = pa.schema([("block", pa.int64()), ("cell", pa.int64()), *small, ("id", pa.int64()), ("mult", pa.int64()), ("cells", pa.list_(pa.int64())), ("s", pa.binary())])
    near = docs.filter(Places(need.select(F.col("rep_th").alias("th"))).may_hold(F.col("th")))
    own = near.join(need, (F.col("th") == F.col("rep_th")) & F.col("k").eqNullSafe(F.col("rep"))).select("t", "id", "mult", "cells", "targets")
    return own.mapInArrow(sets, _SET)


def _alone(shipped: DataFrame, percent: int) -> DataFrame:
    """``(id, root, n)`` of blocks that meet no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        held: list[dict] = []
        for b in batches:
            found = []
            for r in b.to_pylist():
                if held and (r["block"], r["cell"]) != (held[0]["block"], held[0]["cell"]):
                    found.append(_join_task(held, percent))
                    held = []
                held.append(r | {"side": 0})
            if any(f is not None for f in found):
                yield _batch([f for f in found if f is not None])
        if held and (last := _join_task(held, percent)) is not None:
            yield _batch([last])

    tasks = shipped.select("block", "cell", "id", "mult", "cells", "s").repartition("block").sortWithinPartitions("block", "cell")
    return tasks.mapInArrow(run, "id bigint, root bigint, n bigint")


class _Blocks:
    """Blocks in files that are sorted by block; the file of a number is open from its first block on, up to ``most`` files."""

    def __init__(self, files: dict[int, str], most: int = 32) -> None:
        self.files, self.most = files, most
        self.open: dict[int, tuple] = {}

    def _file(self, number: int) -> tuple:
        if number not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open)))[0].close()
            fs, at = pa.fs.FileSystem.from_uri(self.files[number])
            source = fs.open_input_file(at)
            table = pq.ParquetFile(source)
            meta, col = table.metadata, table.schema_arrow.get_field_index("block")
            stats = [meta.row_group(i).column(col).statistics for i in range(meta.num_row_groups)]
            self.open[number] = source, table, [(x.min, x.max) if x is not None and x.has_min_max else (-(1 << 63), 1 << 63) for x in stats]
        return self.open[number]

    def read(self, number: int, block: int, cell: int) -> list[dict]:
        if number not in self.files:
            return []
        _, table, ranges = self._file(number)
        rows: list[dict] = []
        for i in (i for i, (lo, hi) in enumerate(ranges) if lo <= block <= hi):
            for b in table.iter_batches(4096, row_groups=[i], columns=["block", "cell", "id", "mult", "cells", "s"]):
                keep = pa.compute.and_(pa.compute.equal(b.column("block"), block), pa.compute.equal(b.column("cell"), cell))
                rows += b.filter(keep).select(["cell", "id", "mult", "cells", "s"]).to_pylist()
        return rows


def _merged(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row a set from ``(id, root, n)`` of several tasks: the same links, counted together."""
    ids, root, n = (np.concatenate(c) for c in zip(*found))
    names, at = np.unique(np.concatenate([ids, root]), return_inverse=True)
    i, r = at[: len(ids)], at[len(ids) :]
    sums = np.zeros(len(names), np.int64)
    np.add.at(sums, i, n)
    return names, names[min_labels(len(names), i, r)], sums


def _paired(shipped: DataFrame, percent: int) -> DataFrame:
    """``(id, root, n)`` of blocks that meet others: what is written grows with the sets, not with the pairs of blocks."""
    spark = shipped.sparkSession
    path, n = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    shipped.repartition(n, "block").sortWithinPartitions("block", "cell").write.option("parquet.block.size", 8 << 20).parquet(path)
    files = parts_of(spark, path)
    upto = lambda lo, hi: F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    other = lambda cls: lambda j: _block(F.col("cell"), cls, j)
    same = F.transform(upto(F.col("b"), F.col("nb") - 1), other(F.col("cls")))
    above = F.transform(upto(F.lit(0), F.col("above") - 1), other(F.col("cls") + 1))
    file = lambda block: F.pmod(F.hash(block), F.lit(n)).cast("int")
    meets = F.transform(F.concat(same, above), lambda x: F.struct(x.alias("block"), file(x).alias("file")))
    blocks = spark.read.schema(_SET).parquet(path).select("block", "cell", "cls", "b", "nb", "above").distinct()
    chunks = F.transform(F.sequence(F.lit(0), F.size("meets") - 1, F.lit(PARTNERS)), lambda i: F.slice("meets", i + 1, F.lit(PARTNERS)))
    tasks = blocks.withColumn("meets", meets).select("block", "cell", file(F.col("block")).alias("file"), F.explode(chunks).alias("meets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        read, held, merged = _Blocks(files), [], 0
        for b in batches:
            for r in b.to_pylist():
                left = read.read(r["file"], r["block"], r["cell"])
                for m in r["meets"]:
                    own = m["block"] == r["block"]
                    right = [] if own else read.read(m["file"], m["block"], r["cell"])
                    if not own and not right:
                        continue
                    rows = [*(x | {"side": 0 if own else 1} for x in left), *(x | {"side": 2} for x in right)]
                    if (found := _join_task(rows, percent)) is not None:
                        held.append(found)
                if sum(len(f[0]) for f in held) > TILE_ROWS + 2 * merged:
                    held = [_merged(held)]
                    merged = len(held[0][0])
                    if merged > TILE_ROWS:
                        yield _batch(held)
                        held, merged = [], 0
        if held:
            yield _batch([_merged(held)])

    found = saved(tasks.repartition(4 * n, "block", "meets").sortWithinPartitions("cell", "block").mapInArrow(run, "id bigint, root bigint, n bigint"))
    removed(spark, path)
    return found


def _joined(docs: DataFrame, need: DataFrame, percent: int) -> DataFrame:
    """``(id, root, n)`` from all tasks. ``need``: ``(rep, rep_th, id, mult, cells, targets)`` of the sets that meet others."""

    def having(alone: bool) -> DataFrame:
        own = F.filter("targets", lambda t: t["alone"] == alone)
        return need.withColumn("targets", own).filter(F.size("targets") > 0)

    found = saved(_alone(_shipped(docs, having(True)), percent))
    if having(False).limit(1).count():
        found = found.unionByName(_paired(_shipped(docs, having(False)), percent))
    return found


def _batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["id", "root", "n"])


def _located(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with ``k`` and ``th``, the place of a row: its key, and a hash of its text that tells rows of one key apart."""
    return df.withColumns({"k": F.col(key).cast("bigint"), "t": F.coalesce(F.col(text), F.lit(""))}).withColumn("th", F.xxhash64(F.lit(29), "t"))


def _join(df: DataFrame, key: str, text: str, percent: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows ``(k, th, id, n)``; classes of equal sets ``(id, rep, rep_th, mult, n)``, ``rep`` being the least key; links ``(id, root, n)``."""
    bounded_batches(df.sparkSession)
    docs = _located(df.select(F.col(key), F.col(text)), key, text).select("k", "th", "t")
    rows = saved(_scan(docs))
    place = F.struct(F.col("k").isNull().alias("none"), "k", "th")
    grouped = rows.filter("n > 0").groupBy("id").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("mult"), F.first("n").alias("n"))
    classes = saved(grouped.select("id", F.col("at.k").alias("rep"), F.col("at.th").alias("rep_th"), "mult", "n"))
    shared = saved(_shared(_first_tokens(docs, percent)))
    met = saved(_cells(_routed(shared, classes, percent)).distinct())
    freed(shared)
    need = saved(classes.join(_targets(met, classes, percent, block), "id").select("rep", "rep_th", "id", "mult", "cells", "targets"))
    return rows, classes, _joined(docs, need, percent)


def similar(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = PERCENT, block: int = BLOCK
) -> DataFrame:
    """``key, n_shingles, n_similar, component_id`` for every row.

    Null and empty texts and texts without words have no shingles and link with
    nothing. Rows that repeat a key are separate documents but one node of the
    graph. Rows without a key are separate throughout: the component of one is that
    of what it links with, null if nothing there has a key. Other columns are not
    looked at; an empty table gives an empty result.
    """
    rows, classes, tiles = _join(df, key, text, percent, block)
    full = rows.filter("n > 0")
    # Classes that one key's rows belong to are one node.
    split = full.filter("k is not null").groupBy("k").agg(F.min("id").alias("v"), F.max("id").alias("last")).filter("v <> last").select("k", "v")
    one_key = full.join(split, "k").select(F.col("id").alias("u"), "v")
    comp = components(tiles.select(F.col("id").alias("u"), F.col("root").alias("v")).union(one_key))
    totals = tiles.groupBy("id").agg(F.sum("n").alias("linked"))
    whole = classes.join(comp, F.col("id") == F.col("node"), "left").join(totals, "id", "left")
    whole = saved(whole.select("id", "rep", "mult", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("component", "id").alias("c")))
    whole = whole.join(whole.groupBy("c").agg(F.min("rep").alias("component_id")), "c")
    found = full.join(whole, "id").select("k", "n", (F.col("linked") + F.col("mult") - 1).alias("n_similar"), "component_id")
    bare = rows.filter("n = 0").select("k", "n")
    other = found.join(bare.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.min("component_id").alias("o"))
    bare = bare.join(other, "k", "left").select("k", "n", F.lit(0).alias("n_similar"), F.coalesce("o", "k").alias("component_id"))
    return found.unionByName(bare).select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.col("n_similar").cast("bigint").alias("n_similar"), "component_id")


def keep_one(df: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` that stay: of each group of linked documents one row, that of the smallest key.

    Only links group rows: of rows that repeat a key, those whose texts do not link
    all stay, and so do texts without words. Rows without a key come after all
    others of their group. Of rows with the same key and text the first in order of a
    digest of all columns stays.
    """
    rows, classes, tiles = _join(df, key, text, percent, BLOCK)
    comp = components(tiles.select(F.col("id").alias("u"), F.col("root").alias("v")))
    group = classes.join(comp, F.col("id") == F.col("node"), "left").withColumn("c", F.coalesce("component", "id"))
    first = group.groupBy("c").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "rep_th")).alias("at"))
    times = rows.filter("n > 0").groupBy("k", "th").agg(F.count(F.lit(1)).alias("times"))
    same_place = (F.col("th") == F.col("rep_th")) & F.col("k").eqNullSafe(F.col("rep"))
    places = saved(times.join(first.select("at.rep", "at.rep_th"), same_place, "left"))
    stay = places.filter("rep_th is not null").select("rep", "rep_th", "times")
    unsure = Places(places.filter("rep_th is null or times > 1").select("th"))  # all others stay where they are
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole")
    digest = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if not kind.startswith(("map", "variant"))])
    placed = df.select(whole, F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), digest.alias("digest"))
    placed = placed.withColumn("th", F.xxhash64(F.lit(29), "t"))
    words = F.col("t").rlike(r"[^\x20\x09-\x0D]")
    near = unsure.may_hold(F.col("th"))
    met = placed.filter(near).join(stay, same_place, "left")
    kept = placed.filter(~near).select("whole").unionByName(met.filter(~words | (F.col("times") == 1)).select("whole"))
    if stay.filter("times > 1").limit(1).count():  # else the texts need not be moved a second time
        again = met.filter(words & (F.col("times") > 1)).groupBy("k", "th").agg(F.min_by("whole", "digest").alias("whole"))
        kept = kept.unionByName(again.select("whole"))
    return kept.select("whole.*")
