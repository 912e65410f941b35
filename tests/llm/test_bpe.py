import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keyloom.llm import bpe
from keyloom.llm.queries import op10_bpe

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def want(lib, text):
    ids = lib.encode(text or "", add_special_tokens=False).ids
    return ids, lib.decode(ids, skip_special_tokens=False)


HARD = [
    "", " ", "café Straße’s <|endoftext|> x  y's don't 12a 中文 İx é a<|startoftext|>b", "hello world z \x1c q \x85 r \xa0\xa0",
    "a" * 5000, "ab" * 3000 + "'s", "!?" * 4000, "thethe" * 900 + "<|endoftext|>" + "é" * 2000, "ΑΣΣ ὈΔΥΣΣΕΎΣ " * 3, "é ̈x " * 5, " 　x",
    "Σ" * 1500 + "ς" * 600, "👩‍👩‍👧" * 300, "\x00\x01 a\x00b", "1234567890" * 200,
]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(lib, text):
    enc = bpe.Encoder(PATH, long=64)
    ids, decoded = want(lib, text)
    got = enc.strings(text)
    assert got == (" ".join(map(str, ids)), decoded)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdefghitns eo'!.1é"), min_size=1, max_size=400))
def test_tree_join_equals_direct(text):
    own = _own()
    span = text.replace(" ", "") or "x"
    span = "".join(c for c in span if c.isascii())or "x"
    assert own.encode_span(span, leaf=7) == own.merge(own.symbols(span))


_cache = []


def _own():
    if not _cache:
        _cache.append(bpe.WordBPE(PATH))
    return _cache[0]


def test_memo_turnover(lib):
    enc = bpe.Encoder(PATH, memo=20)
    for k in range(60):
        text = " ".join(f"word{k * 7 + j} x{j}" for j in range(30))
        assert enc.strings(text)[0] == " ".join(map(str, want(lib, text)[0]))


def test_query_over_whole_table(spark, sf, lib):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op10_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids, decoded = want(lib, texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_nulls_clashes_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "y"), (None, "a b", "z")], "doc_id long, text string, ids string")
    got = bpe.encode(df, PATH).collect()
    assert [(r.doc_id, r.ids, r.decoded) for r in got] == [(1, [], ""), (1, [], ""), (None, [320, 321], "a</w> b</w>")]
    assert bpe.encode(df.limit(0), PATH).count() == 0
    assert bpe.digests(df.limit(0), PATH).count() == 0
