import hashlib
from collections import Counter

import numpy as np
import test_signature_trees
from tokenizers import Tokenizer

import corpus_pipeline as cp
from keyloom.llm import bpe, mixing, quality, suffix


def keep_bytes(rows):
    raws = [(k, (t or "").encode()) for k, t in rows]
    n = suffix.LENGTH
    seen = Counter(r[i : i + n] for _, r in raws for i in range(len(r) - n + 1))
    out = {}
    for k, r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i : i + n] = True
        out[k] = np.frombuffer(r, np.uint8)[~gone].tobytes().decode(errors="ignore")
    return out


def rowset(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_each_stage_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, cols = [n for n, _ in cp.STAGES], docs.columns
    assert len(names) == 5

    def after(k, given):
        path = f"{tmp_path}/{k}"
        cp.STAGES[k][1](spark, given, sf).write.parquet(path)
        got = spark.read.parquet(path)
        assert k == 4 or got.columns == cols
        return got

    one = after(0, docs)
    m = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = []
    for r in docs.collect():
        ids, x = quality.features(r.text, r.n_chars)
        v = m.v[ids] * x[:, None]
        z = m.b + m.w[ids] @ x + (np.triu(v @ v.T, 1)).sum()
        if 1 / (1 + np.exp(-z)) >= quality.ACCEPT:
            want.append(tuple(r))
    assert rowset(one) == sorted(want, key=repr) and 0 < len(want) < docs.count()

    two = after(1, one)
    first = {k for k, _, _, c in test_signature_trees.brute([(r.doc_id, r.text) for r in one.collect()]) if k == c}
    assert rowset(two) == [r for r in rowset(one) if r[0] in first]

    three = after(2, two)
    kept = keep_bytes([(r.doc_id, r.text) for r in two.collect()])
    assert {r.doc_id: r.text for r in three.collect()} == kept
    assert all(r.n_chars == len(r.text) for r in three.collect())

    four = after(3, three)
    assert rowset(four) == rowset(three)
    slots = {r.doc_id: (r.mix_slot, r.mix_index) for r in mixing.schedule(three).collect()}
    order = [slots[r.doc_id] for r in four.collect()]
    assert sorted(order) == sorted(slots.values())

    lib = Tokenizer.from_file(bpe.vocabulary())
    got = {r.doc_id: r for r in after(4, four).collect()}
    for k, t in kept.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[k].ids == ids and got[k].n_tokens == len(ids)
        assert got[k].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_gives_the_last_stage(spark, sf):
    got = cp.run(spark, sf)
    assert got.columns == ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"] and got.count() > 0


def test_stages_with_nulls_repeats_and_no_rows(spark, sf, tmp_path):
    long = "a passage that several documents hold, word by word, " * 6
    rows = [
        (None, None, None, None, None), (None, long, "en", "s", len(long)), (1, None, "en", None, 0), (1, None, "en", None, 0), (2, "", "en", "s", 0), (3, long, "en", "s", len(long)),
        (3, long, "en", "s", len(long)), (4, "short text of four", "en", "t", 18), (4, "another under the same id", "en", "t", 25), (5, "x " * 30000, "en", "u", 60000),
    ]
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    docs = spark.createDataFrame(rows, schema)
    stages = dict(cp.STAGES)
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        got = stage(spark, docs, sf)
        if name != "bpe":
            assert got.columns == docs.columns, name
    assert 0 <= stages["quality_classifier"](spark, docs, sf).count() <= len(rows)
    kept = sorted(((r.doc_id, r.text) for r in stages["ngram_jaccard_join"](spark, docs, sf).collect()), key=repr)
    assert kept == sorted([(None, None), (1, None), (1, None), (2, ""), (3, long), (4, "short text of four"), (4, "another under the same id"), (5, "x " * 30000)], key=repr)
    cut = sorted(((r.doc_id, r.text if r.text is None or len(r.text) < 30 else "long") for r in stages["suffix_array_dedup"](spark, docs, sf).collect()), key=repr)
    assert cut == sorted([(None, None), (None, ""), (1, None), (1, None), (2, ""), (3, ""), (3, ""), (4, "short text of four"), (4, "another under the same id"), (5, "")], key=repr)
    assert rowset(stages["mixing"](spark, docs, sf)) == sorted(rows, key=repr)
    assert [r.n_tokens for r in stages["bpe"](spark, docs, sf).filter("doc_id = 2").collect()] == [0]
