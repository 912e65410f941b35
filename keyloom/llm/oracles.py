"""SQL (DuckDB) for operators that it can express, each by the plainest method."""

from __future__ import annotations

from keyloom.llm import ego_join, mixing, signature_trees, urls
from keyloom.llm.common import LOWER, UPPER


def _components(edges: str) -> str:
    """CTEs over the pairs ``edges(x, y)``: both directions, degrees, and the smallest node reachable."""
    return f"""
s AS (SELECT x, y FROM {edges} UNION ALL SELECT y, x FROM {edges}),
deg AS (SELECT x, count(*) AS c FROM s GROUP BY x),
r AS (SELECT DISTINCT x, x AS root FROM s UNION SELECT s.y, r.root FROM r JOIN s ON r.x = s.x),
comp AS (SELECT x, min(root) AS root FROM r GROUP BY x)"""


def near_vectors() -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda c: c * c))) AS size FROM v),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id < b.vec_id
    WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= {ego_join.COSINE}),
{_components("p")}
SELECT vec_id, coalesce(c, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept
FROM embeddings LEFT JOIN deg ON deg.x = vec_id LEFT JOIN comp ON comp.x = vec_id"""


def similar() -> str:
    p = signature_trees.PERCENT
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM g),
t AS (SELECT doc_id, unnest(g) AS h FROM g),
q AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM t a JOIN t b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
p AS (SELECT x, y FROM q JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {p} * (a.n + b.n - c)),
{_components("p")}
SELECT doc_id, n::BIGINT AS n_shingles, coalesce(c, 0)::BIGINT AS n_similar, coalesce(root, doc_id) AS component_id
FROM n LEFT JOIN deg ON deg.x = doc_id LEFT JOIN comp ON comp.x = doc_id"""


def url_verdicts() -> str:
    rules = sorted(urls.RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for h, p, _ in rules]
    rule = "CASE " + " ".join(f"{f} '{h + p}'" for f, (h, p, _) in zip(fits, rules)) + " END"
    ruled = "CASE " + " ".join(f"{f} '{v}'" for f, (*_, v) in zip(fits, rules)) + " END"
    shape = (
        "CASE WHEN regexp_full_match(g, '[0-9A-Fa-f-]{8,}') AND regexp_matches(g, '[0-9]') AND NOT regexp_full_match(g, '[0-9]+') THEN '{h}' "
        "ELSE regexp_replace(g, '^[0-9]+(\\.[A-Za-z0-9]{1,5})?$', '{n}\\1') END"
    )
    ctes = [
        "u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        "q AS (SELECT *, string_split(regexp_replace(path, '^/', ''), '/') AS parts FROM h)",
        f"a AS (SELECT page_id, host, path, {rule} AS rule, {ruled} AS ruled, list_concat(list_transform(parts[1:{urls.DEPTH}], lambda g: {shape}), "
        f"CASE WHEN len(parts) > {urls.DEPTH} THEN ['**'] ELSE []::VARCHAR[] END) AS segs FROM q)",
        "leaf AS (SELECT host, segs, count(*)::DOUBLE AS n, count(ruled)::DOUBLE AS lab, count(*) FILTER (ruled = 'block')::DOUBLE AS blk FROM a GROUP BY host, segs)",
        "x0 AS (SELECT *, '' AS prefix FROM leaf)",
    ]
    rate = "(blk + 1.0) / (lab + 2.0)"
    pool = "((blk + pb + 1.0) / (lab + pl + 2.0))"
    for d in range(urls.DEPTH + 1):
        ctes += [
            f"c{d} AS (SELECT host, prefix, segs[{d + 1}] AS seg, sum(n) AS n, sum(lab) AS lab, sum(blk) AS blk FROM x{d} WHERE len(segs) > {d} GROUP BY ALL)",
            f"g{d} AS (SELECT *, CASE WHEN n >= {urls.SUPPORT} AND n >= {urls.SHARE} * sum(n) OVER (PARTITION BY host, prefix) THEN seg ELSE '*' END AS gen FROM c{d})",
            f"k{d} AS (SELECT host, prefix, gen, sum(lab) AS lab, sum(blk) AS blk FROM g{d} GROUP BY ALL)",
            f"o{d} AS (SELECT *, lag(lab) OVER w AS pl, lag(blk) OVER w AS pb FROM k{d} WINDOW w AS (PARTITION BY host, prefix, lab > 0 ORDER BY {rate}, gen))",
            f"s{d} AS (SELECT *, CASE WHEN lab = 0 OR pl IS NULL THEN 1 WHEN abs(blk / lab - pb / pl) / sqrt({pool} * (1.0 - {pool}) * (1.0 / lab + 1.0 / pl)) > {urls.Z_SPLIT} THEN 1 ELSE 0 END AS st FROM o{d})",
            f"b{d} AS (SELECT *, sum(st) OVER (PARTITION BY host, prefix, lab > 0 ORDER BY {rate}, gen ROWS UNBOUNDED PRECEDING) AS br FROM s{d})",
            f"m{d} AS (SELECT host, prefix, lab > 0 AS f, br, string_agg(gen, '|' ORDER BY gen) AS name FROM b{d} GROUP BY ALL)",
            f"x{d + 1} AS (SELECT x.host, x.segs, x.n, x.lab, x.blk, CASE WHEN m.name IS NULL THEN x.prefix ELSE x.prefix || '/' || m.name END AS prefix FROM x{d} x "
            f"LEFT JOIN g{d} g ON g.host = x.host AND g.prefix = x.prefix AND g.seg = x.segs[{d + 1}] LEFT JOIN b{d} b ON b.host = g.host AND b.prefix = g.prefix AND b.gen = g.gen "
            f"LEFT JOIN m{d} m ON m.host = b.host AND m.prefix = b.prefix AND m.f = (b.lab > 0) AND m.br = b.br)",
        ]
    last, k = f"x{urls.DEPTH + 1}", urls.SMOOTH
    ctes += [
        "tot AS (SELECT (sum(blk) + 1.0) / (sum(lab) + 2.0) AS overall FROM leaf)",
        "hosts AS (SELECT host, sum(lab) AS hl, sum(blk) AS hb FROM leaf GROUP BY host)",
        f"t AS (SELECT host, prefix, sum(lab) AS lab, sum(blk) AS blk FROM {last} GROUP BY ALL)",
        f"z AS (SELECT t.host, t.prefix, round((blk + (hb + (SELECT overall FROM tot) * {k}) / (hl + {k}) * {k}) / (lab + {k}), 12) AS purity FROM t JOIN hosts USING (host))",
    ]
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT page_id, a.host, path, rule, coalesce(ruled, CASE WHEN purity >= {urls.REJECT} THEN 'block' ELSE 'allow' END) AS verdict, "
        f"y.prefix AS template, purity FROM a JOIN {last} y ON y.host = a.host AND y.segs = a.segs JOIN z ON z.host = y.host AND z.prefix = y.prefix"
    )


def _phase(rows: str) -> str:
    """One phase among ``rows(k, start, s, p, used, n)``: also its total ``q``, its length, and blocks done (``cnt``) and existing (``real``)."""
    return f"""
SELECT k, start, s, p, used, n, q, length, cnt, least(cnt, n) AS real FROM (
SELECT *, f + (m AND row_number() OVER (PARTITION BY m ORDER BY f * q // p, ((f + 1) * q + p - 1) // p, s) <= length - sum(f) OVER ())::BIGINT AS cnt FROM (
SELECT *, p * length // q AS f, p * length % q > 0 AS m FROM (
SELECT *, max(CASE WHEN stops = 0 THEN e END) OVER () AS length FROM (
SELECT *, sum(stop) OVER (ORDER BY e, p, s ROWS UNBOUNDED PRECEDING) AS stops FROM (
SELECT *, CASE WHEN 2 * (q - coalesce(sum(p) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) <= q AND e > coalesce(lag(e) OVER o, 0) THEN 1 ELSE 0 END AS stop
FROM (SELECT *, (n * q + p - 1) // p AS e FROM (SELECT *, (sum(p) OVER ())::BIGINT AS q FROM ({rows}))) WINDOW o AS (ORDER BY e, p, s))))))"""


def mixture() -> str:
    """Earliest deadline first, slot by slot."""
    b = mixing.BLOCK
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, chr(0) || 'null') AS s, md5(doc_id::VARCHAR || chr(31) || coalesce(source, chr(0))) AS h FROM documents),
i AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h) - 1 AS mix_index FROM d),
c AS (SELECT 0 AS k, 0::BIGINT AS start, s, round(1000 * sqrt(count(*)))::BIGINT AS p, 0::BIGINT AS used, ((count(*) + {b - 1}) // {b})::BIGINT AS n FROM d GROUP BY s),
ph AS ({_phase("SELECT * FROM c")}
UNION ALL {_phase("SELECT k + 1 AS k, (start + length)::BIGINT AS start, s, p, (used + real)::BIGINT AS used, (n - real)::BIGINT AS n FROM ph WHERE n > real")}),
run AS (SELECT k, start, s, p, used, q, length, cnt, real, 0::BIGINT AS t, 0::BIGINT AS done FROM ph
UNION ALL SELECT k, start, s, p, used, q, length, cnt, real, t + 1, done + (row_number() OVER (PARTITION BY k ORDER BY (done < cnt AND done * q // p <= t) DESC,
    least(length, ((done + 1) * q + p - 1) // p), s) = 1)::BIGINT FROM run WHERE t < length),
slots AS (SELECT s, used + done - 1 AS mix_block, min(start + t) - 1 AS mix_slot FROM run WHERE done BETWEEN 1 AND real GROUP BY k, s, used, done)
SELECT doc_id, source, mix_index, mix_index // {b} AS mix_block, mix_slot FROM i JOIN slots ON slots.s = i.s AND slots.mix_block = mix_index // {b}"""


SQL = {"op7_mix": mixture(), "op1_urls": url_verdicts(), "op2_near_vectors": near_vectors(), "op5_similar": similar()}
