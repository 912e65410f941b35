import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import substrings, suffix
from keyloom.llm.queries import QUERIES

L = suffix.LENGTH


def brute(rows):
    """rows: (key, text) -> (key, n_bytes, n_removed, n_spans, kept_sha256), by grouping every string of L bytes."""
    raws = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(r[i : i + L] for _, r in raws for i in range(len(r) - L + 1))
    out = []
    for k, r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - L + 1):
            if seen[r[i : i + L]] > 1:
                gone[i : i + L] = True
        step = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        out.append((k, len(r), int(gone.sum()), int((step == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def digest(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def planted(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(25, 60)) for _ in range(5)]
    rows = []
    for i in range(120):
        parts = [text(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            lo, hi = rng.randint(0, 40), len(p) - rng.randint(0, 40)
            parts += [p[lo:hi], text(rng.randint(0, 30))]
        rows.append((i, "".join(parts)))
    rows += [(200, rows[3][1]), (200, rows[3][1]), (201, None), (202, ""), (None, "short"), (203, "a" * 1000), (204, "ab" * 150), (205, "x" * 199), (206, "x" * 200)]
    rows += [(300 + i, rows[7][1][: 300 + i] + "!" + rows[7][1][301 + i :]) for i in range(12)]
    return rows


@pytest.mark.parametrize(("batches", "hot"), [(1, 200_000), (2, 200_000), (3, 3)])
def test_planted_against_brute_force(spark, batches, hot):
    rows = planted()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, uid string").repartition(3)
    assert digest(substrings.dedup(df, texts=False, batches=batches, hot=hot)) == brute(rows)


def test_long_runs_in_pieces(spark, monkeypatch):
    rows = planted(1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    real = substrings.SuffixFamily
    monkeypatch.setattr(substrings, "SuffixFamily", lambda spark, hot: real(spark, 2, 3))
    assert digest(substrings.dedup(df, texts=False)) == brute(rows)


def test_merge_of_streams():
    rng = np.random.default_rng(1)
    for most in (3, 1000):
        parts, files = [], []
        for _ in range(3):
            fp = np.sort(rng.integers(0, 30, 80))
            parts.append(fp)
            files.append(iter([[fp[i : i + 7], fp[i : i + 7], fp[i : i + 7], fp[i : i + 7].astype(np.int32)] for i in range(0, 80, 7)]))
        got = list(substrings._merge(files, [True, False, False], most))
        assert sorted(np.concatenate([r[0] for r, _ in got])) == sorted(np.concatenate(parts))
        assert sum(r[4].sum() for r, _ in got) == 80
        last = -1
        for rows, piece in got:
            assert rows[0].min() > last or (piece and rows[0].min() == last)
            last = rows[0].max()
            assert not piece or most == 3


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(substrings, "text_id", lambda text: F.length(text).cast("bigint") % 3)
    rows = planted(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(substrings.dedup(df, texts=False)) == brute(rows)


def test_query_over_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert digest(QUERIES["op9_substrings"](spark, sf)) == brute(rows)


def test_texts_and_edges(spark):
    rows = planted(2)
    df = spark.createDataFrame([(k, t, "x", 5) for k, t in rows], "doc_id long, text string, removed_spans string, c0 int")
    got = substrings.dedup(df).collect()
    want = {(k, n, r, s): h for k, n, r, s, h in brute(rows)}
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "c0", "removed_spans"}
    removed = sorted((r.doc_id or -1, sum(s.end - s.start for s in r.removed_spans), len(r.removed_spans)) for r in got)
    assert removed == sorted((k or -1, r, s) for k, _, r, s in want) or len(want) < len(rows)
    assert sum(r.text is None for r in got) == 1
    assert substrings.dedup(df.limit(0)).count() == 0
    assert substrings.dedup(df.limit(0), texts=False).count() == 0


def test_family_levels(spark):
    fam = substrings.SuffixFamily(spark)
    for i in range(5):
        t = spark.createDataFrame([(i, "abc %d " % i * 60)], "uid long, t string")
        assert fam.add(t).count() > 0
    assert sorted(fam.levels) == [0, 2]
    whole = spark.read.parquet(fam.levels[2])
    assert {r.uid for r in whole.select("uid").distinct().collect()} == {0, 1, 2, 3}
    fam.close()
