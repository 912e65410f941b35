import zlib

import numpy as np

from keyloom.llm import quality
from keyloom.llm.queries import QUERIES


def test_identity_equals_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, 4)))
    ids, x = quality.features("some words, SOME more! words\nline", 31)
    pairs = sum(m.v[a] @ m.v[b] * x[i] * x[j] for i, a in enumerate(ids) for j, b in enumerate(ids) if i < j)
    assert np.isclose(m.raw(ids, x, np.array([0]))[0], 0.3 + m.w[ids] @ x + pairs)


def test_held_out_accuracy_and_coverage(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op4_quality"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in got]
    test = [(got[k].predicted, y) for k, y in labels if got[k].held_out]
    assert np.mean([p == y for p, y in test]) > 0.93, test


def test_edges(spark):
    data = [(1, None, None, 0.5), (2, "", 0, 0.5), (None, "x " * 40000, 80000, 0.5), (3, "a", -1, 0.5), (3, "a", -1, 0.5)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_chars long, score double")
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (2, None)], "doc_id long, quality int")
    m = quality.train(docs, labels)
    got = quality.score(docs, m).collect()
    assert len(got) == 5 and all(0 < r.score < 1 for r in got)
    assert quality.score(docs.limit(0), m).count() == 0
    assert quality.train(docs.limit(0), labels.limit(0)).b == 0.0
