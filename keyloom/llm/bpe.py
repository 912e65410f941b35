"""BPE encoding and decoding of whole texts, with tree concatenation of long unsplit spans.

White space never reaches a token of this tokenizer, so a text is encoded chunk
by chunk and a bounded memo keeps the chunks seen before; unknown chunks go to
the ``tokenizers`` library together. A chunk longer than ``LONG`` bytes could
hold one unsplit span of any length, on which a priority-queue BPE grows faster
than its input. Such spans are halved into leaves; the leaves are encoded on
their own and joined pairwise up a tree. At a join, a window of tokens around
the seam is encoded again and widened until its first and last token agree with
their neighbours: two tokens agree if encoding their concatenation gives the two
back, and a token row all of whose neighbours agree *is* the encoding.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator, Sequence
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import bounded_batches, claim, memo

LONG = 1024
LEAF = 128
MEMO = 300_000


class WordBPE:
    """Merges of a word-end BPE; symbols are byte-level characters, the last with the word end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank: dict[tuple[str, str], int] = {m: i for i, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.agree = lru_cache(maxsize=200_000)(self._agree)

    def symbols(self, span: str) -> list[str]:
        return [*span[:-1], span[-1] + self.end]

    def split(self, token: str) -> list[str]:
        """The symbols a token was merged from."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            return self.symbols(token[: -len(self.end)])
        return list(token)

    def merge(self, parts: Sequence[str]) -> list[str]:
        """Lowest rank first, leftmost among equals."""
        n = len(parts)
        if n < 2:
            return list(parts)
        word: list[str | None] = list(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, word[i], word[i + 1]) for i in range(n - 1) if (r := self.rank.get((word[i], word[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if word[i] != a or j >= n or word[j] != b:
                continue
            word[i], word[j] = a + b, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := self.rank.get((word[k], word[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, word[k], word[after[k]]))
        return [w for w in word if w is not None]

    def _agree(self, a: str, b: str) -> bool:
        return self.merge(self.split(a) + self.split(b)) == [a, b]

    def join(self, left: list[str], right: list[str]) -> list[str]:
        """The encoding of two spans' concatenation from the encodings of both."""
        if not left or not right:
            return left + right
        if self.agree(left[-1], right[0]):
            return left + right
        reach = 2
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            window = self.merge([s for t in left[a:] + right[:b] for s in self.split(t)])
            if (a == 0 or self.agree(left[a - 1], window[0])) and (b == len(right) or self.agree(window[-1], right[b])):
                return left[:a] + window + right[b:]
            reach *= 2

    @cached_property
    def inner(self):
        """The same merges without word ends, in the library: it encodes a batch on all cores given to it."""
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        return Tokenizer(BPE(vocab=self.vocab, merges=list(self.rank)))

    def encode_span(self, span: str, leaf: int = LEAF) -> list[str]:
        """Tokens of one unsplit span: the leaves in parallel, then pairwise joins. Only the last has the word end."""
        parts = [span[i : i + leaf] for i in range(0, len(span), leaf)]
        level = [e.tokens for e in self.inner.encode_batch(parts[:-1], add_special_tokens=False)] if parts[1:] else []
        level.append(self.merge(self.symbols(parts[-1])))
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]


class Encoder:
    """Encodes texts as id and token strings, each id or token followed by a blank."""

    def __init__(self, path: str, memo: int = MEMO, long: int = LONG):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.bpe = WordBPE(path)
        self.memo, self.long = memo, long
        self.new: dict[bytes, tuple[str, str]] = {}
        self.old: dict[bytes, tuple[str, str]] = {}

    def _pair(self, ids: Sequence[int]) -> tuple[str, str]:
        token = self.bpe.token
        return "".join([f"{i} " for i in ids]), "".join([token[i] + " " for i in ids])

    def _long_chunk(self, chunk: bytes) -> list[int]:
        bpe, ids = self.bpe, []
        for part in bpe.special_pattern.split(chunk.decode()) if bpe.special_pattern else [chunk.decode()]:
            if part in bpe.special:
                ids.append(bpe.special[part])
            elif part:
                for span, _ in self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(part)):
                    ids += [bpe.vocab[t] for t in bpe.encode_span(span)]
        return ids

    def _learn(self, chunks: list[bytes]) -> None:
        if len(self.new) > self.memo:
            self.old, self.new = self.new, {}
        missing = []
        for c in dict.fromkeys(chunks):
            if c in self.new:
                continue
            if (known := self.old.get(c)) is not None:
                self.new[c] = known
            elif len(c) > self.long:
                self.new[c] = self._pair(self._long_chunk(c))
            else:
                missing.append(c)
        if missing:
            got = self.lib.encode([c.decode() for c in missing], is_pretokenized=True, add_special_tokens=False)
            ids: list[list[int]] = [[] for _ in missing]
            for i, w in zip(got.ids, got.word_ids):
                ids[w].append(i)
            for c, own in zip(missing, ids):
                self.new[c] = self._pair(own)

    def strings(self, text: str) -> tuple[str, str]:
        chunks = text.encode().split()  # ASCII white space only: the library drops any other
        try:
            pairs = list(map(self.new.__getitem__, chunks))
        except KeyError:
            self._learn(chunks)
            pairs = list(map(self.new.__getitem__, chunks))
        return "".join([p[0] for p in pairs])[:-1], "".join([p[1] for p in pairs])[:-1]


_ENCODERS: dict[str, Encoder] = {}
memo("bpe", _ENCODERS.clear)


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    claim("bpe")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of an installed public vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode(df: DataFrame, path: str, text: str = "text", *, decoded: str = "text", keep_text: bool = True) -> DataFrame:
    """All columns of ``df`` (without ``text``, if it is not to be kept) and ``ids array<int>``, ``decoded string``.

    ``decoded="sha256"`` gives the digest of the decoded text instead, so that it
    never leaves the worker. Null and empty texts give no ids and an empty
    decoding. Columns of ``df`` named ``ids`` or ``decoded`` are replaced. Row for
    row: repeated rows and ids stay, an empty table gives an empty result.
    """
    bounded_batches(df.sparkSession)
    base = df.drop("ids", "decoded")
    kept = [f for f in base.schema.fields if keep_text or f.name != text]
    names = [*(f.name for f in kept), "ids", "decoded"]
    shown = (lambda t: t) if decoded == "text" else (lambda t: hashlib.sha256(t.encode()).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            flat, texts = [np.zeros(0, np.int32)], []
            for value in b.column(text):
                ids, plain = enc.strings(value.as_py() or "")
                flat.append(np.array(ids.split(" "), np.int32) if ids else flat[0])
                texts.append(shown(plain))
            ends = np.cumsum([len(f) for f in flat]).astype(np.int32)
            arrays = [*(b.column(f.name) for f in kept), pa.ListArray.from_arrays(ends, np.concatenate(flat)), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return base.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of each row, as ``encode`` would give them.

    The ids and texts themselves never leave the worker. Null text counts as empty.
    """
    bounded_batches(df.sparkSession)
    base = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sha = encoder(path), hashlib.sha256
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for value in b.column("text"):
                ids, decoded = enc.strings(value.as_py() or "")
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(sha(ids.encode()).hexdigest())
                text_sha.append(sha(decoded.encode()).hexdigest())
            arrays = [b.column("key"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(base.dtypes)["key"]
    out = base.mapInArrow(run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)
