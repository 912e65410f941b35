import numpy as np
import pytest

from keyloom.llm import ego_join, vectors
from keyloom.llm.graph import components
from keyloom.llm.queries import QUERIES


def brute(rows, t=0.93):
    """rows: (key, vector, label)."""
    ok = [k is not None and lab is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0) for k, v, lab in rows]
    n = [0] * len(rows)
    near = {}
    for i, (k, v, lab) in enumerate(rows):
        for j in range(i):
            k2, v2, lab2 = rows[j]
            if ok[i] and ok[j] and lab == lab2 and len(v) == len(v2):
                a, b = np.array(v, float), np.array(v2, float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= t:
                    n[i] += 1
                    n[j] += 1
                    near.setdefault(k, set()).add(k2)
                    near.setdefault(k2, set()).add(k)
    comp = {}
    for k in sorted(near):
        todo = [k]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = k
                todo += near[x]
    return sorted(((k, c, comp.get(k, k), k is not None and comp.get(k, k) == k) for (k, _, _), c in zip(rows, n)), key=repr)


def rows_of(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def test_near_duplicates_against_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 64 * 8 * 20)
    monkeypatch.setattr(ego_join, "LEAF", 8)
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert rows_of(QUERIES["op2_near_vectors"](spark, sf)) == brute(rows)


def test_near_duplicates_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, [0.0, 0.0], 1), (6, None, 1), (7, [nan, 1.0], 1),
        (8, [inf, 1.0], 1), (9, [1.0, None], 1), (10, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0], 1), (None, [1.0, 0.0], 1), (11, [1e38, 0.0], 1), (12, [1e-38, 0.0], 1), (13, [], 1),
        (14, [0.0, 1.0], 1), (15, [-0.0, 1.0], 1), (16, [0.3, 1.0], 1), (17, [0.6, 1.0], 1),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    assert rows_of(ego_join.near_duplicates(df)) == brute(rows)
    assert ego_join.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = rng.integers(0, 400, (260, 2)).tolist() + [[1000 + i, 1001 + i] for i in range(60)] + [[5, 5]]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long").repartition(4)).collect()}
    low = {x: x for p in pairs for x in p}
    for _ in range(len(low)):
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    alone = {5} - {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {k: c for k, c in low.items() if k not in alone}
