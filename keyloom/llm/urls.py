"""URL filter: fixed rules first, then a path-template tree.

Native throughout. Each path segment is first reduced to its shape where it is
a number or a hash, which makes most urls of a host alike; the tree is then
built on the distinct ``(host, segments)`` with their counts, level by level:

1. *generalise*: at a node, a child keeps its name only with at least
   ``support`` urls and ``share`` of the node's; the others become ``*``. A node
   thus has at most ``1 / share + 1`` children left;
2. *merge*: labelled children, in order of their smoothed block rate, join
   their predecessor unless a two-proportion test tells them apart (``|z| >
   z_split``); the branch carries all names, as ``de|fr``;
   Each level reads the one before it twice, so levels are checkpointed; they
   hold one row per distinct ``(host, segments)``, not per url;
3. after ``depth`` levels what is left of a path is one more segment, ``**`` or
   nothing.

The urls that a rule decides are the labelled ones. A template's purity is its
block rate, smoothed to its host's rate, which is smoothed to the rate over all
hosts; at ``reject`` or more the template is rejected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from keyloom.llm.common import ascii_lower, saved

RULES: Sequence[tuple[str, str, str]] = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DEPTH, SUPPORT, SHARE, Z_SPLIT, SMOOTH, REJECT = 3, 3, 0.02, 1.96, 4.0, 0.5
SALT = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    at = F.coalesce(F.position(F.lit("://"), url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null without one; equally long ones in order of their strings."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def segments(path: Column, depth: int = DEPTH) -> Column:
    """Shapes of the first ``depth`` segments, and ``**`` for any further ones."""
    parts = F.split(F.regexp_replace(path, r"^/", ""), "/")

    def shape(s: Column) -> Column:
        number = F.regexp_replace(s, r"^[0-9]+(\.[A-Za-z0-9]{1,5})?\z", "{n}$1")
        return F.when(s.rlike(r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}\z") & ~s.rlike(r"^[0-9]+\z"), F.lit("{h}")).otherwise(number)

    head = F.transform(F.slice(parts, 1, depth), shape)
    return F.when(F.size(parts) > depth, F.concat(head, F.array(F.lit("**")))).otherwise(head)


def _rate(block: str, labelled: str, prior: Column, smooth: float) -> Column:
    return (F.col(block) + prior * smooth) / (F.col(labelled) + F.lit(smooth))


def _level(leaves: DataFrame, d: int, support: int, share: float, z_split: float) -> DataFrame:
    """Extend ``prefix`` of each leaf by its generalised segment ``d`` (from 0)."""
    sums = [F.sum(c).alias(c) for c in ("n", "lab", "blk")]
    here = leaves.withColumn("seg", F.get("segs", F.lit(d)))
    children = here.filter(F.col("seg").isNotNull()).groupBy("host", "prefix", "seg").agg(*sums)
    total = children.groupBy("host", "prefix").agg(F.sum("n").alias("node_n"))
    # A node may have very many children: their join with the node's one row is salted.
    total = total.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    children = children.withColumn("salt", F.pmod(F.xxhash64("seg"), F.lit(SALT)).cast("int")).join(total, ["host", "prefix", "salt"])
    own = (F.col("n") >= support) & (F.col("n") >= F.col("node_n") * share)
    children = saved(children.select("host", "prefix", "seg", F.when(own, F.col("seg")).otherwise(F.lit("*")).alias("gen"), "n", "lab", "blk"))
    kept = children.groupBy("host", "prefix", "gen").agg(*sums)
    by_rate = W.partitionBy("host", "prefix", F.col("lab") > 0).orderBy(_rate("blk", "lab", F.lit(0.5), 2.0), "gen")
    before_l, before_b = F.lag("lab").over(by_rate), F.lag("blk").over(by_rate)
    pooled = (F.col("blk") + before_b + 1.0) / (F.col("lab") + before_l + 2.0)
    gap = F.col("blk") / F.col("lab") - before_b / before_l
    z = F.abs(gap) / F.sqrt(pooled * (1.0 - pooled) * (1.0 / F.col("lab") + 1.0 / before_l))
    starts = F.when(F.col("lab") == 0, 1).when(before_l.isNull(), 1).when(z > z_split, 1).otherwise(0)
    kept = kept.withColumn("start", starts).withColumn("branch", F.sum("start").over(by_rate.rowsBetween(W.unboundedPreceding, 0)))
    names = F.array_join(F.array_sort(F.collect_list("gen").over(W.partitionBy("host", "prefix", F.col("lab") > 0, "branch"))), "|")
    kept = kept.select("host", "prefix", "gen", names.alias("name"))
    named = children.join(kept, ["host", "prefix", "gen"]).select("host", "prefix", "seg", "name")
    joined = here.join(named, ["host", "prefix", "seg"], "left")
    longer = F.when(F.col("name").isNull(), F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), "name"))
    return saved(joined.select("host", "segs", longer.alias("prefix"), "n", "lab", "blk"))


def judge(
    df: DataFrame,
    *,
    key: str = "page_id",
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    depth: int = DEPTH,
    support: int = SUPPORT,
    share: float = SHARE,
    z_split: float = Z_SPLIT,
    smooth: float = SMOOTH,
    reject: float = REJECT,
) -> DataFrame:
    """``key, host, path, rule, verdict, template, purity`` for every row.

    A url that is null or has no ``://`` has an empty host and path and is
    judged by the template of that host. Repeated rows are counted and
    returned each; other columns are not looked at; no rows give no rows.
    """
    host, path = host_and_path(F.col(url))
    rows = df.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "segs": segments(F.col("path"), depth)})
    counts = [F.count(F.lit(1)).alias("n"), F.count("ruled").alias("lab"), F.count_if(F.col("ruled") == "block").alias("blk")]
    leaves = saved(rows.groupBy("host", "segs").agg(*counts))
    totals = leaves.agg(F.sum("lab"), F.sum("blk")).first()
    overall = ((totals[1] or 0) + 1.0) / ((totals[0] or 0) + 2.0)
    tree = leaves.withColumn("prefix", F.lit(""))
    for d in range(depth + 1):
        tree = _level(tree, d, support, share, z_split)
    hosts = leaves.groupBy("host").agg(F.sum("lab").alias("host_lab"), F.sum("blk").alias("host_blk"))
    pooled = tree.groupBy("host", "prefix").agg(F.sum("lab").alias("lab"), F.sum("blk").alias("blk")).join(hosts, "host")
    of_host = _rate("host_blk", "host_lab", F.lit(overall), smooth)
    pooled = pooled.select("host", "prefix", F.round(_rate("blk", "lab", of_host, smooth), 12).alias("purity"))
    judged = tree.join(pooled, ["host", "prefix"]).select("host", "segs", F.col("prefix").alias("template"), "purity")
    out = rows.join(judged, ["host", "segs"])
    by_tree = F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(
        F.col("_key").alias(key), "host", "path", "rule", F.coalesce("ruled", by_tree).alias("verdict"), "template", "purity"
    )
