import math
import re
from collections import defaultdict

import pytest

from keyloom.llm import urls
from keyloom.llm.queries import QUERIES


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule_of(host, path):
    fit = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def shape(s):
    if re.fullmatch(r"(?=.*[0-9])[0-9A-Fa-f-]{8,}", s) and not re.fullmatch("[0-9]+", s):
        return "{h}"
    m = re.fullmatch(r"[0-9]+(\.[A-Za-z0-9]{1,5})?", s)
    return "{n}" + (m.group(1) or "") if m else s


def segs(path):
    parts = path.removeprefix("/").split("/")
    return tuple(map(shape, parts[: urls.DEPTH])) + (("**",) if len(parts) > urls.DEPTH else ())


def brute(rows):
    pages = [(k, *host_path(u)) for k, u in rows]
    leaf = defaultdict(lambda: [0, 0, 0])
    for _, h, p in pages:
        v = rule_of(h, p)[1]
        x = leaf[h, segs(p)]
        x[0] += 1
        x[1] += v is not None
        x[2] += v == "block"
    prefix = dict.fromkeys(leaf, "")
    for d in range(urls.DEPTH + 1):
        child = defaultdict(lambda: [0, 0, 0])
        for (h, s), x in leaf.items():
            if d < len(s):
                c = child[h, prefix[h, s], s[d]]
                for i in range(3):
                    c[i] += x[i]
        node = defaultdict(int)
        for (h, p, _), x in child.items():
            node[h, p] += x[0]
        gen = {k: k[2] if x[0] >= urls.SUPPORT and x[0] >= node[k[:2]] * urls.SHARE else "*" for k, x in child.items()}
        kept = defaultdict(lambda: [0, 0, 0])
        for k, x in child.items():
            for i in range(3):
                kept[(*k[:2], gen[k])][i] += x[i]
        name = {}
        for np in {k[:2] for k in kept}:
            own = [(k[2], *x[1:]) for k, x in kept.items() if k[:2] == np]
            for g, lab, _ in own:
                if not lab:
                    name[(*np, g)] = g
            groups, last = [], None
            for g, lab, blk in sorted((o for o in own if o[1]), key=lambda o: ((o[2] + 1) / (o[1] + 2), o[0])):
                if last:
                    pool = (blk + last[1] + 1) / (lab + last[0] + 2)
                    z = abs(blk / lab - last[1] / last[0]) / math.sqrt(pool * (1 - pool) * (1 / lab + 1 / last[0]))
                if not last or z > urls.Z_SPLIT:
                    groups.append([])
                groups[-1].append(g)
                last = (lab, blk)
            for gs in groups:
                for g in gs:
                    name[(*np, g)] = "|".join(sorted(gs))
        for h, s in leaf:
            if d < len(s):
                p = prefix[h, s]
                prefix[h, s] = p + "/" + name[h, p, gen[h, p, s[d]]]
    tot = [sum(x[i] for x in leaf.values()) for i in (1, 2)]
    overall = (tot[1] + 1) / (tot[0] + 2)
    host, temp = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (h, s), x in leaf.items():
        for t, k in ((host, h), (temp, (h, prefix[h, s]))):
            t[k][0] += x[1]
            t[k][1] += x[2]
    out = []
    for k, h, p in pages:
        rule, v = rule_of(h, p)
        t = prefix[h, segs(p)]
        hr = (host[h][1] + overall * urls.SMOOTH) / (host[h][0] + urls.SMOOTH)
        pur = round((temp[h, t][1] + hr * urls.SMOOTH) / (temp[h, t][0] + urls.SMOOTH), 12)
        out.append((k, h, p, rule, v or ("block" if pur >= urls.REJECT else "allow"), t, pur))
    return sorted(out, key=repr)


def test_against_brute_force(spark, sf):
    rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op1_urls"](spark, sf).collect()), key=repr)
    assert got == brute(rows)


def test_edges(spark):
    given = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/en/12?x", "x://org", "x://org/", "x://a.com/fr/", "x://a.com/de", "x://acom/de/1",
        "x://a.com/de/1#f/../", "x://b.example.org/es/ü", "x://É.net?a=://b", "http://h.net/" + "a/" * 5000, "x://h.net/0a1b2c3d4e/9.html//", "x://a.com\n/de/",
    ] + [f"x://a.com/{'de' if i % 2 else 'zz'}/{i}" for i in range(40)] + ["x://a.com/de/7"] * 5 + [f"x://a.com/slug{i}/q" for i in range(300)]
    rows = list(enumerate(given))
    df = spark.createDataFrame([(k, u, "h") for k, u in rows], "page_id long, url string, host string")
    got = sorted(map(tuple, urls.judge(df).collect()), key=repr)
    assert got == brute(rows)
    assert urls.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1_urls"])
def test_plan_is_native(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
