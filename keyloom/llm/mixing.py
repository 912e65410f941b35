"""Mixing sources to target weights by a Pfair schedule.

Rows of a source are grouped into blocks. Block ``j`` (from 0) of a source of
weight ``w`` is released at slot ``floor(j / w)`` and due by ``ceil((j + 1) /
w)``; earliest deadline first over released blocks (ties: the lesser source name)
keeps every source within less than one block of ``w * t`` at every slot ``t``.
Weights are exact: whole parts of one common total, whatever numbers were given.

*Phases.* A source that runs out leaves its later slots empty. Once the sources
that still have blocks weigh half of the total or less, the phase ends and a new
one begins among them, with weights in proportion; so there are at most
``log2(1 / least weight)`` phases and never more empty slots than full ones. What
is done when a phase ends is fixed beforehand: ``floor(w * end)`` blocks of each
source, and one more of those whose next block was released first, as many as
fill ``end`` slots. These are due by ``end``, the others wait for the next phase.

*Ranges.* What earliest deadline first has done by a slot follows without its
history: of the blocks released before, taken by deadline, each that still leaves
every suffix of slots enough room (the greedy basis of a matroid). All blocks
released a longest window earlier are done. So tasks work out ranges of slots by
themselves; the driver holds one number per source and phase. A source of weight
``w`` makes a range look back over ``1 / w`` slots: ranges grow with it.

No row is dropped or repeated.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BLOCK = 64
BUCKET_ROWS = 10_000
RANGE = 1 << 14
_NULL = "\x00null"


def parts(weights: Mapping[str, float | Fraction]) -> dict[str, int]:
    """Weights as whole numbers in exactly their proportion."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("target weights must be positive")
    common = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * common) for s, w in exact.items()}
    least = math.gcd(*whole.values())
    return {s: p // least for s, p in whole.items()}


@dataclass(frozen=True)
class Phase:
    """``names`` (sorted) with their ``part`` of ``total``; ``first``: blocks used before; ``count``: done at the end; ``real``: of these, blocks that exist."""

    start: int
    length: int
    total: int
    names: tuple[str, ...]
    part: tuple[int, ...]
    first: tuple[int, ...]
    count: tuple[int, ...]
    real: tuple[int, ...]

    def released(self, i: int, t: int) -> int:
        """Blocks of the ``i``-th source that are released before slot ``t``."""
        return min(self.count[i], -(-self.part[i] * t // self.total))

    def window(self) -> int:
        """No block has more slots between release and deadline."""
        return -(-self.total // min(self.part)) + 2

    def jobs(self, lo: int, hi: int) -> Iterator[tuple[int, int, int, int]]:
        """``(release, deadline, source, block)`` of blocks released in ``[lo, hi)``."""
        for i, p in enumerate(self.part):
            for j in range(self.released(i, lo), self.released(i, hi)):
                yield j * self.total // p, min(self.length, -(-(j + 1) * self.total // p)), i, j


def phases(part: Mapping[str, int], blocks: Mapping[str, int]) -> list[Phase]:
    left = {s: n for s, n in blocks.items() if n > 0}
    used = dict.fromkeys(left, 0)
    start, out = 0, []
    while left:
        names = sorted(left)
        p = [part[s] for s in names]
        q = sum(p)
        ends = [-(-left[s] * q // x) for s, x in zip(names, p)]
        rest, end = q, 0
        for e, x in sorted(zip(ends, p)):
            if 2 * rest <= q and e > end:
                break
            rest, end = rest - x, e
        count = [x * end // q for x in p]
        next_up = sorted((n * q // x, -(-(n + 1) * q // x), i) for i, (n, x) in enumerate(zip(count, p)) if x * end % q)
        for _, _, i in next_up[: end - sum(count)]:
            count[i] += 1
        real = [min(n, left[s]) for n, s in zip(count, names)]
        out.append(Phase(start, end, q, tuple(names), tuple(p), tuple(used[s] for s in names), tuple(count), tuple(real)))
        for s, n in zip(names, real):
            used[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        start += end
    return out


def done_by(ph: Phase, t: int) -> list[int]:
    """Blocks of each source that earliest deadline first has done in the slots before ``t``."""
    lo = max(0, t - ph.window())
    out = [ph.released(i, lo) for i in range(len(ph.part))]
    room = t - sum(out)
    due, optional = 0, []  # blocks due by t come first; of each source one block at most is due later
    for release, deadline, i, _ in sorted(ph.jobs(lo, t), reverse=True):
        if deadline <= t:
            due += 1
            out[i] += 1
        else:
            heapq.heappush(optional, (-deadline, -i))
        while due + len(optional) > t - release:
            heapq.heappop(optional)
    while due + len(optional) > room:
        heapq.heappop(optional)
    for _, i in optional:
        out[-i] += 1
    return out


def slots(ph: Phase, lo: int, hi: int) -> Iterator[tuple[str, int, int]]:
    """``(source, block, slot)`` of the blocks that exist in the slots ``[lo, hi)`` of a phase."""
    at = done_by(ph, lo)
    ready = [(d, i, j) for _, d, i, j in ph.jobs(max(0, lo - ph.window()), lo) if j >= at[i]]
    heapq.heapify(ready)
    coming = sorted(ph.jobs(lo, hi), reverse=True)
    for t in range(lo, hi):
        while coming and coming[-1][0] <= t:
            heapq.heappush(ready, coming.pop()[1:])
        _, i, j = heapq.heappop(ready)
        if j < ph.real[i]:
            yield ph.names[i], ph.first[i] + j, ph.start + t


def block_slots(spark: SparkSession, plan: list[Phase], span: int = RANGE) -> DataFrame:
    """``(_s, mix_block, mix_slot)`` of every block, each range of slots worked out in a task of its own."""
    spans = [max(span, 4 * ph.window()) for ph in plan]
    counts = [-(-ph.length // n) for ph, n in zip(plan, spans)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("id").to_pylist():
                n = 0
                while k >= counts[n]:
                    k, n = k - counts[n], n + 1
                rows = list(slots(plan[n], k * spans[n], min(plan[n].length, (k + 1) * spans[n])))
                s, j, t = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(j, pa.int64()), pa.array(t, pa.int64())], names=["_s", "mix_block", "mix_slot"])

    n = sum(counts)
    return spark.range(0, n, 1, max(1, min(n, 10_000))).mapInArrow(run, "_s string, mix_block bigint, mix_slot bigint")


def row_hash(df: DataFrame, first: str) -> Column:
    """Digest of a whole row (but for columns without a text form), ``first`` leading."""
    plain = [c for c, kind in df.dtypes if not kind.startswith(("map", "variant")) and c != first]
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in [first, *plain]]
    return F.md5(F.concat_ws("\x1f", *texts))


def schedule(
    df: DataFrame,
    weights: Mapping[str | None, float | Fraction] | None = None,
    *,
    key: str = "doc_id",
    source: str = "source",
    block: int = BLOCK,
    temper: float = 0.5,
) -> DataFrame:
    """All rows and columns of ``df``, and ``mix_index``, ``mix_block``, ``mix_slot`` (long).

    ``mix_index`` numbers a source's rows in the order of a digest of the row,
    whatever other sources hold; ``mix_block`` is ``mix_index // block`` and
    ``mix_slot`` the block's place in the mixture. ``weights`` names the targets;
    without it a source of ``n`` rows weighs ``n ** temper`` (to three decimals). A source that
    ``weights`` omits gets the least of the given weights. Null is a source of its
    own; null and repeated keys are separate rows, told apart by their other
    columns (rows that are equal throughout stand next to one another); columns of
    ``df`` with the new names are replaced; an empty table stays empty. Sources are
    a dimension: the driver holds one count for each.
    """
    base = df.drop("mix_index", "mix_block", "mix_slot")
    name = F.coalesce(F.col(source).cast("string"), F.lit(_NULL))
    counts = {r["_s"]: r["n"] for r in base.groupBy(name.alias("_s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    plan: list[Phase] = []
    if counts:
        if weights is None:
            target: dict[str, float | Fraction] = {s: Fraction(max(1, round(1000 * float(n) ** temper))) for s, n in counts.items()}
        else:
            given = {_NULL if s is None else s: v for s, v in weights.items()}
            target = {s: given.get(s, min(given.values())) for s in counts}
        plan = phases(parts(target), {s: -(-n // block) for s, n in counts.items()})
    # Buckets are ranges of the digest, so that ranks do not depend on how many there are.
    cut = df.sparkSession.createDataFrame([(s, -(-n // BUCKET_ROWS)) for s, n in counts.items()], "_s string, _nb bigint")
    spread = base.withColumns({"_s": name, "_h": row_hash(base, key)}).join(cut, "_s")
    lead = F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint")
    spread = spread.withColumn("_b", F.shiftright(lead * F.col("_nb"), 32)).drop("_nb")
    sizes = spread.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_s", "_b", F.coalesce(before, F.lit(0)).cast("bigint").alias("_off"))
    local = F.row_number().over(W.partitionBy("_s", "_b").orderBy("_h"))
    ranked = spread.withColumn("_r", local).join(offsets, ["_s", "_b"])
    index = (F.col("_r") - 1 + F.col("_off")).cast("bigint")
    ranked = ranked.withColumn("mix_index", index).withColumn("mix_block", F.floor(F.col("mix_index") / block).cast("bigint"))
    placed = ranked.join(block_slots(df.sparkSession, plan), ["_s", "mix_block"])
    return placed.select(*[F.col(f"`{c}`") for c in base.columns], "mix_index", "mix_block", "mix_slot")


def in_order(scheduled: DataFrame) -> DataFrame:
    """Rows range-partitioned and sorted by slot: files written from it hold the mixture in order."""
    return scheduled.repartitionByRange("mix_slot", "mix_index").sortWithinPartitions("mix_slot", "mix_index")
