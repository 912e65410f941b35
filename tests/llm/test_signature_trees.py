import os
import random
import re
import time

import numpy as np
import pytest

from keyloom.llm import common
from keyloom.llm import signature_trees as st
from keyloom.llm.queries import QUERIES

ASCII = {i: i + 32 for i in range(65, 91)}


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(ASCII))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    s = [shingles(t) for _, t in rows]
    n = [0] * len(rows)
    near = {}
    index = {}
    for i, x in enumerate(s):
        for g in x:
            index.setdefault(g, []).append(i)
    for i, x in enumerate(s):
        for j in {j for g in x for j in index[g] if j < i}:
            both = len(x & s[j])
            if 100 * both >= 80 * (len(x) + len(s[j]) - both):
                n[i] += 1
                n[j] += 1
                near.setdefault(rows[i][0], set()).add(rows[j][0])
                near.setdefault(rows[j][0], set()).add(rows[i][0])
    comp = {}
    for k in sorted(near):
        todo = [k]
        while todo:
            v = todo.pop()
            if v not in comp:
                comp[v] = k
                todo += near[v]
    return sorted(((k, len(x), c, comp.get(k, k)) for (k, _), x, c in zip(rows, s, n)), key=repr)


def planted(seed):
    rng = random.Random(seed)
    text = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) + str(rng.randint(0, 99)) for _ in range(n)]
    passage, rows = text(60), []
    for i in range(60):
        rows.append((len(rows), " ".join(text(rng.randint(0, 60)) + (passage if i % 2 else []) + text(rng.randint(0, 90)))))
    for c in range(6):
        base = text(rng.choice([6, 30, 120, 400]))
        for _ in range(rng.randint(2, 25)):
            v = list(base)
            for _ in range(rng.randint(0, max(1, len(v) // 50))):
                v[rng.randrange(len(v))] = "edit" + str(rng.randint(0, 9))
            rows.append((len(rows), " ".join(v).upper() if c % 2 else "\n".join(v)))
    for c in range(40):  # a text and a longer one near the threshold, with a passage of its own group
        base, shared = text(rng.randint(20, 90)), text(20)
        for extra in (0, rng.randint(0, 3), int(len(base) * 0.22), int(len(base) * 0.25), int(len(base) * 0.27)):
            more = shared[: rng.randint(0, 20)] + text(extra)
            rows.append((len(rows), " ".join(base + more[:extra])))
    return rows + [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE two x"), (905, "One  TWO"), (905, "One  TWO"), (906, "É a b c d e"), (907, "é a b c d e")]


def rows_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("seed", "block"), [(0, 256), (1, 4)])
def test_planted_against_brute_force(spark, monkeypatch, seed, block):
    rows = planted(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, id string, n int").repartition(3)
    assert rows_of(st.similar(df, block=block)) == brute(rows)


def test_long_runs_in_pieces(spark, monkeypatch):
    rows = planted(2)
    cells, shared = st._cells, st._shared
    monkeypatch.setattr(st, "_cells", lambda routed: cells(routed, 3))
    monkeypatch.setattr(st, "_shared", lambda first: shared(first, 3))
    monkeypatch.setattr(st, "bounded_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(st.similar(df)) == brute(rows)


def test_query_over_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(QUERIES["op5_similar"](spark, sf)) == brute(rows)


def test_walk_loses_nothing():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(1, 1 << 63, 300, dtype=np.uint64))
    sets = []
    for _ in range(70):
        s = base[rng.random(len(base)) < rng.choice([0.6, 0.95])]
        sets.append(np.unique(np.concatenate([s, rng.integers(1, 1 << 63, rng.integers(0, 60), dtype=np.uint64)])))
    want = {(i, j) for i in range(70) for j in range(i + 1, 70) if st.linked(sets[i], sets[j], 80)}
    i, j = st._links(sets, None, 80)
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())} == want
    i, j = st._links(sets[:30], sets[30:], 80)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in want if a < 30 <= b}


def test_edges_and_keep_one(spark):
    rows = [(None, "a b c d e f g"), (7, "a b c d e f g"), (8, "a b c d e f g"), (None, "zz"), (9, "other words here"), (9, "other words here")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, k string")
    assert rows_of(st.similar(df)) == sorted([(None, 3, 2, 7), (7, 3, 2, 7), (8, 3, 2, 7), (None, 1, 0, None), (9, 1, 1, 9), (9, 1, 1, 9)], key=repr)
    assert sorted((r.doc_id for r in st.keep_one(df).collect()), key=str) == [7, 9, None]
    assert st.similar(df.limit(0)).count() == 0
    assert st.keep_one(df.limit(0)).count() == 0


def test_repeated_and_null_keys(spark):
    near = "one two three four five six seven eight nine ten"
    rows = [(5, near, "a"), (5, "quite another text than that", "b"), (5, near, "c"), (6, near, "d"), (None, near, "e"), (None, "a text without a key", "f"), (None, "a text without a key", "g"), (8, " ", "h"), (8, "eight has words as well", "i"), (None, "", "j"), (4, "eight has words as well", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    got = sorted(((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in st.similar(df).collect()), key=repr)
    assert got == sorted([(5, 6, 3, 5), (5, 1, 0, 5), (5, 6, 3, 5), (6, 6, 3, 5), (None, 6, 3, 5), (None, 1, 1, None), (None, 1, 1, None), (8, 0, 0, 4), (8, 1, 1, 4), (None, 0, 0, None), (4, 1, 1, 4)], key=repr)
    kept = sorted((r.doc_id or 0, r.text) for r in st.keep_one(df).collect())
    assert kept == sorted([(5, near), (5, "quite another text than that"), (0, "a text without a key"), (8, " "), (0, ""), (4, "eight has words as well")])
    tags = {r.tag for r in st.keep_one(df).collect()}
    assert tags == {r.tag for r in st.keep_one(df.repartition(5)).collect()}


def test_many_linked_rows_without_a_key(spark):
    """Pairs of linked texts, none with a key: as many rows meet in the join as there are sets."""
    rng = random.Random(4)
    rows = []
    for i in range(1000):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
        rows += [(None, " ".join(w)), (None, " ".join([*w, "more"]))]
    got = st.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 2000 and all((r.doc_id, r.n_similar, r.component_id) == (None, 1, None) for r in got)


def test_saved_results_leave_no_shuffle_files(spark):
    files = lambda: {f for f in str(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")).split("\n") if "shuffle_" in f}
    before = files()
    kept = common.saved(spark.range(1000).groupBy((st.F.col("id") % 100).alias("g")).count().repartition(3, "g"))
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert kept.count() == 100
    path = kept._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.exists(path)
    common.freed(kept)
    assert not os.path.exists(path)


def test_small_sets_are_not_shipped_many_times(spark):
    met = spark.range(600).select(st.F.lit(1).cast("bigint").alias("cell"), "id")
    classes = spark.range(600).select("id", st.F.lit(50).cast("bigint").alias("n"))
    assert {len(r.targets) for r in st._targets(met, classes, 80, 256).collect()} == {1}


def test_many_pairs_as_products(monkeypatch):
    rng = np.random.default_rng(7)
    base = np.unique(rng.integers(1, 1 << 63, 400, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.9], rng.integers(1, 1 << 63, rng.integers(0, 9), dtype=np.uint64)])) for _ in range(160)]
    pairs = [(i, j) for i in range(160) for j in range(i + 1, 160)]
    want = [st.linked(sets[i], sets[j], 80) for i, j in pairs]
    assert 0 < sum(want) < len(want)
    monkeypatch.setattr(st, "linked", None)  # not pair by pair
    i, j = np.array(pairs).T
    assert st._verified(sets, i, j, 80, wide=100).tolist() == want


def test_places_hold_all_they_were_given(spark):
    th = spark.range(3000).select(st.F.xxhash64("id").alias("th"))
    for most in (1 << 10, 1 << 26):
        near = st.Places(th.filter("th % 3 = 0"), most).may_hold(st.F.col("th"))
        held = {r.th for r in th.filter(near).collect()}
        assert held >= {r.th for r in th.collect() if r.th % 3 == 0}
    assert len(held) < 1500
    assert th.filter(st.Places(th.limit(0)).may_hold(st.F.col("th"))).count() == 0


def test_only_texts_in_doubt_move(spark, monkeypatch):
    """Of 300 texts 10 are copies: the rows that the last join is given are these, not all."""
    rows = [(i, f"text number {i} has words of its own {i * i}") for i in range(290)]
    rows += [(300 + i, rows[i][1]) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held, made = st.Places.may_hold, []
    monkeypatch.setattr(st.Places, "may_hold", lambda self, th: made.append(self) or held(self, th))
    assert sorted(r.doc_id for r in st.keep_one(df).collect()) == list(range(290))
    th = st._located(df, "doc_id", "text")
    assert 10 <= th.filter(held(made[-1], st.F.col("th"))).count() < 60


def test_a_set_is_written_once_for_each_of_its_cells(spark):
    """However many blocks a cell has: what is written grows with the sets, not with the pairs of blocks."""
    met = spark.range(600).select(st.F.lit(1).cast("bigint").alias("cell"), "id")
    classes = spark.range(600).select("id", st.F.lit(50).cast("bigint").alias("n"))
    got = st._targets(met, classes, 80, 8).collect()
    assert {len(r.targets) for r in got} == {1}
    assert len({r.targets[0].block for r in got}) > 4 and not any(r.targets[0].alone for r in got)


def test_blocks_in_files_against_brute_force(spark, monkeypatch):
    """Two sets a block and two partners a row; the files go in the end."""
    monkeypatch.setattr(st, "WIDE", 1)
    monkeypatch.setattr(st, "PARTNERS", 2)
    monkeypatch.setattr(st, "TILE_ROWS", 3)
    paths, paired = [], st.removed
    monkeypatch.setattr(st, "removed", lambda s, path: paths.append(path) or paired(s, path))
    rows = planted(3)
    assert rows_of(st.similar(spark.createDataFrame(rows, "doc_id long, text string"), block=2)) == brute(rows)
    assert len(paths) == 1 and not os.path.exists(paths[0].removeprefix("file:"))
