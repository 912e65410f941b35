"""License scan: phrases, and templates found by an exact set-similarity join.

Native throughout. The tokens of a wording are its pairs of neighbouring words, so
order counts. A text's words are cut into overlapping blocks of ``2 * stride``
words, one every ``stride`` words, so a passage of up to ``stride`` words lies
whole in some block; templates have the least stride of 32, 128, 512 ... that
they fit in. A block holds a template if it has at least ``threshold`` of the
template's distinct tokens. Only tokens of some template can count, so a block is
reduced to those, ordered from the rarest in the corpus (by the number of documents
with the rarer word of the pair, then the other; ties by the text). Filters, none
of which can lose a match:

* prefix: of ``n`` template tokens, ``need = ceil(threshold * n)`` must occur, so
  one of the ``n - need + 1`` rarest does, and with it its rarer word. Documents
  without any such word, and blocks away from one, are never looked at again;
* length: the reduced block has at least ``need`` tokens;
* position: with the first common token at rank ``i`` of the template and ``k`` of
  the block, ``1 + min(n - 1 - i, len - 1 - k) >= need``.

The templates are the only thing sent to tasks, as literals.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import ascii_lower
from keyloom.llm.license_texts import TEMPLATES

#: ASCII but for letters and digits; written out, as the JVM's threads contend at the type checks of a union of ranges.
SEPARATORS = "[" + "".join(f"\\x{c:02x}" for c in range(128) if not chr(c).isalnum()) + "]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
STRIDE = 32
THRESHOLD = 0.7


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _lits(values: Sequence[str]) -> Column:
    """An array literal (folded from one string: thousands of literals would be slow to plan)."""
    return F.split(F.lit("|".join(values)), "\\|") if values else F.array().cast("array<string>")


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    tokens: tuple[str, ...]
    stride: int


def prepared(templates: Mapping[str, Sequence[str]], stride: int = STRIDE) -> list[Template]:
    """Templates with their distinct tokens and their stride; a wording needs two words at least."""
    out = []
    for label, texts in sorted(templates.items()):
        for t in texts:
            own = re.findall("[0-9a-z]+", t.lower())
            if len(own) < 2:
                raise ValueError(f"template {t!r} has fewer than two words")
            fits = stride
            while fits < len(own):
                fits *= 4
            out.append(Template(label, " ".join(own), tuple(dict.fromkeys(map(" ".join, zip(own, own[1:])))), fits))
    return out


def vocabulary_df(rows: DataFrame, vocab: Sequence[str]) -> dict[str, int]:
    """Documents holding each template word; at most one row per template word reaches the driver."""
    found = rows.select(F.explode(F.array_intersect(_lits(vocab), F.col("_w"))).alias("word"))
    counted = found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    return {w: 0 for w in vocab} | {r["word"]: r["n"] for r in counted}


def _starts(w: Column, phrase: str) -> Column:
    """Word numbers where the phrase stands."""
    own = phrase.split()
    stop = F.size(w) - len(own)
    at = F.when(stop >= 0, F.sequence(F.lit(0), stop)).otherwise(F.array().cast("array<int>"))
    hit = lambda i: [F.get(w, i + k) == v for k, v in enumerate(own)]

    def both(i: Column) -> Column:
        conditions = hit(i)
        out = conditions[-1]
        for c in reversed(conditions[:-1]):
            out = c & out
        return out

    return F.filter(at, both)


def scan(
    df: DataFrame,
    *,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    stride: int = STRIDE,
) -> DataFrame:
    """``keep`` and ``n_words, n_base, first_word, last_word, base_labels, labels, score, matches`` for every row.

    ``matches`` lists ``(label, template, first_word, containment)`` of every block
    that meets the threshold, ``first_word`` being the block's. ``score`` is 1 with a
    phrase, else the best containment found, else 0. Null and empty texts have no
    words, no labels and score 0. Rows are handled one by one: repeated rows and
    clashing column names other than ``keep`` have no effect.
    """
    listed = prepared(templates, stride)
    base = df.select(*keep, words(F.col(text)).alias("_w"))
    df_of = vocabulary_df(base, sorted({w for t in listed for pair in t.tokens for w in pair.split()}))
    rarer = {pair: min(pair.split(), key=lambda v: (df_of[v], v)) for t in listed for pair in t.tokens}
    rank = {pair: (df_of[rarer[pair]], max(df_of[v] for v in pair.split()), pair) for pair in rarer}
    w = F.col("_w")

    gate = F.array_contains(w, "license")
    spots = base.withColumns({
        f"_p{i}": F.when(gate if "license" in ph.split() else F.lit(True), _starts(w, ph)).otherwise(F.array().cast("array<int>"))
        for i, ph in enumerate(phrases)
    })
    hits = F.flatten(F.array(*[F.col(f"_p{i}") for i in range(len(phrases))]))
    base_labels = F.array_distinct(F.array_compact(F.array(*[F.when(F.size(f"_p{i}") > 0, F.lit(v)) for i, v in enumerate(phrases.values())])))

    def blocks(rare: list[str], order: list[str], step: int) -> Column:
        """One entry per candidate block: its first word and its template tokens, rarest first."""
        near = F.filter(F.transform(w, lambda x, i: F.when(x.isin(rare), F.floor(i / step).cast("int"))), lambda k: k.isNotNull())
        numbers = F.array_distinct(F.flatten(F.transform(near, lambda k: F.when(k > 0, F.array(k - 1, k)).otherwise(F.array(k)))))

        def block(k: Column) -> Column:
            own = F.slice(w, k * step + 1, F.lit(2 * step))
            pairs = F.zip_with(own, F.slice(w, k * step + 2, F.lit(2 * step - 1)), lambda a, b: F.concat(a, F.lit(" "), b))
            return F.struct((k * step).alias("first_word"), F.array_intersect(_lits(order), pairs).alias("own"))

        return F.transform(numbers, block)

    def found(spec: Column, b: Column) -> Column:
        """What of the templates ``spec`` a block holds."""

        def passes(t: Column) -> Column:
            common = F.array_intersect(F.slice(t["ranked"], F.lit(1), t["n"] - t["need"] + 1), b["own"])
            first = F.get(common, F.lit(0))
            left_t = t["n"] - F.array_position(t["ranked"], first)
            left_b = F.size(b["own"]) - F.array_position(b["own"], first)
            return (F.size(b["own"]) >= t["need"]) & (F.size(common) > 0) & (1 + F.least(left_t, left_b) >= t["need"])

        def scored(t: Column) -> Column:
            share = F.size(F.array_intersect(t["ranked"], b["own"])) / t["n"].cast("double")
            return F.struct(t["label"].alias("label"), t["template"].alias("template"), b["first_word"].alias("first_word"), share.alias("containment"), t["least"].alias("least"))

        return F.filter(F.transform(F.filter(spec, passes), scored), lambda m: m["containment"] >= m["least"])

    none = F.array().cast("array<struct<first_word:int,own:array<string>>>")
    empty = F.array().cast("array<struct<label:string,template:string,first_word:int,containment:double>>")
    lists, columns = [], {}
    for step in sorted({t.stride for t in listed}):
        own, spec, rare = [t for t in listed if t.stride == step], [], set()
        for t in own:
            ranked = sorted(t.tokens, key=rank.__getitem__)
            need = math.ceil(round(threshold * len(ranked), 9))
            rare |= {rarer[v] for v in ranked[: len(ranked) - need + 1]}
            spec.append({"label": t.label, "template": t.text, "n": len(ranked), "need": need, "least": need / len(ranked) - 1e-9, "ranked": ranked})
        order = sorted({v for t in own for v in t.tokens}, key=rank.__getitem__)
        columns[f"_b{step}"] = F.when(F.arrays_overlap(w, _lits(sorted(rare))), blocks(sorted(rare), order, step)).otherwise(none)
        # Templates are one folded literal, so the plan does not grow with their number.
        literal = F.from_json(F.lit(json.dumps(spec)), "array<struct<label:string,template:string,n:int,need:int,least:double,ranked:array<string>>>")
        held = F.flatten(F.transform(f"_b{step}", lambda b: found(literal, b)))  # noqa: B023
        lists.append(F.when(F.size(f"_b{step}") > 0, F.transform(held, lambda m: m.dropFields("least"))).otherwise(empty))
    spots = spots.withColumns(columns)
    matches = F.flatten(F.array(*lists)) if lists else empty
    out = spots.select(*keep, F.size(w).cast("bigint").alias("n_words"), hits.alias("_hits"), base_labels.alias("_base"), matches.alias("matches"))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    labels = F.array_sort(F.array_union("_base", F.transform("matches", lambda m: m["label"])))
    return out.select(
        *keep,
        "n_words",
        F.size("_hits").cast("bigint").alias("n_base"),
        F.array_min("_hits").cast("bigint").alias("first_word"),
        F.array_max("_hits").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("_hits") > 0, F.lit(1.0)).otherwise(best).alias("score"),
        "matches",
    )


def _sql() -> str:
    """The same result without any filter: every block of every document against every template."""
    listed = prepared(TEMPLATES)
    values = ", ".join(f"('{t.label}', string_split('{'|'.join(t.tokens)}', '|'), {t.stride})" for t in listed)
    strides = sorted({t.stride for t in listed})
    places = []
    for phrase, label in PHRASES.items():
        own = phrase.split()
        cond = " AND ".join(f"w[i + {k}] = '{v}'" for k, v in enumerate(own))
        places.append(f"SELECT doc_id, '{label}' AS label, i - 1 AS spot FROM p WHERE {cond}")
    blocks = " UNION ALL ".join(
        f"SELECT doc_id, {s} AS stride, list_transform(range(1, len(own)), lambda i: own[i] || ' ' || own[i + 1]) AS own FROM "
        f"(SELECT doc_id, w[k * {s} + 1 : k * {s} + {2 * s}] AS own FROM (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // {s} + 1)) AS k FROM d WHERE len(w) > 0))"
        for s in strides
    )
    return f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE list_contains(w, 'license')),
hits AS ({" UNION ALL ".join(places)}),
h AS (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits GROUP BY doc_id),
t AS (SELECT label, own, stride FROM (VALUES {values}) AS v(label, own, stride)),
b AS ({blocks}),
m AS (SELECT doc_id, label, len(list_intersect(t.own, b.own)) / len(t.own) AS share FROM b JOIN t ON b.stride = t.stride WHERE len(list_intersect(t.own, b.own)) >= ceil(round({THRESHOLD} * len(t.own), 9))),
s AS (SELECT doc_id, max(share) AS best FROM m GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM m UNION ALL SELECT doc_id, label FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_base, 0)::BIGINT AS n_base, h.first_word::BIGINT AS first_word, h.last_word::BIGINT AS last_word,
    coalesce(h.base_labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
    CASE WHEN h.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(s.best, 0)::DOUBLE END AS score
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN l USING (doc_id)"""


ORACLE_SQL = _sql()
