"""URL filter: rules first, then trust and distrust propagated over the host graph.

Hosts are linked by what their pages mention: the host of an absolute link, any other host name in the page that is the host of some
page, and the parent domain of each host (`m.a.example` to `a.example`), which ties the subdomains of a site together.
Trust is personalised PageRank from hosts whose pages the rules allow, along the edges; distrust is the same from hosts
whose pages the rules block, against the edges. Restarts, and the rank of hosts without edges, go back to the seeds. A
host is blocked when its distrust exceeds `ratio` times its trust and `floor` times the mean rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

#: The rules (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING, STEPS, RATIO, FLOOR = 0.85, 8, 1.0, 0.1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NAME = r"[A-Za-z0-9][A-Za-z0-9-]*(?:\\.[A-Za-z0-9][A-Za-z0-9-]*)+"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule (host and path together; ties: the first) that fits, as a struct (rule, verdict), or null."""
    out = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) between different hosts of `pages` (host, html)."""
    hosts = pages.where("host <> ''").select(F.col("host").alias("known")).distinct()
    named = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(F.expr(f"regexp_extract_all(html, '{NAME}', 0)"))).alias("dst"))
    named = named.withColumn("dst", F.translate("dst", _UPPER, _LOWER)).where("dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n"))
    named = named.join(hosts, F.col("dst") == F.col("known"), "left_semi")
    up = hosts.where(F.size(F.split("known", r"\.")) > 2).select(F.col("known").alias("src"), F.regexp_extract("known", r"^[^.]*\.(.*)$", 1).alias("dst"), F.lit(1).cast("bigint").alias("n"))
    return named.unionByName(up).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """(side, host, rank): trust (side t, along the edges) and distrust (side d, against them).

    `edges` is (src, dst, n), `seeds` (side, host, weight) with the weights of a side adding up to 1.
    """
    both = edges.select(F.lit("t").alias("side"), "src", "dst", "n").unionByName(edges.select(F.lit("d").alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out_n = both.groupBy("side", "src").agg(F.sum("n").alias("total"))
    graph = materialize(both.join(out_n, ["side", "src"]).select("side", "src", "dst", (F.col("n") / F.col("total")).alias("w")), "graph")
    seeds = materialize(seeds, "seeds")
    rank = seeds.select("side", "host", F.col("weight").alias("rank"))
    for _ in range(steps):
        moved = rank.join(graph, (rank["side"] == graph["side"]) & (rank["host"] == graph["src"])).select(graph["side"], F.col("dst").alias("host"), (F.col("rank") * F.col("w") * damping).alias("x"))
        got = moved.groupBy("side", "host").agg(F.sum("x").alias("x"))
        kept = got.groupBy("side").agg(F.sum("x").alias("sum"))  # two rows
        back = seeds.join(F.broadcast(kept), "side", "left").select("side", "host", (F.col("weight") * (1 - F.coalesce("sum", F.lit(0.0)))).alias("x"))
        rank = materialize(got.unionByName(back).groupBy("side", "host").agg(F.sum("x").alias("rank")), "rank")
    return rank


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, ratio: float = RATIO, floor: float = FLOOR, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each row of `pages` (page_id, url, html).

    A null url, or one without ://, has an empty host and path, fits no rule and is allowed with ranks of 0, as is any host that no seed reaches.
    Null html links to nothing; very long pages are read whole; repeated rows are judged alike; further columns are ignored; an empty table gives no rows.
    """
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    p = p.withColumn("fit", matched_rule(F.col("host"), F.col("path"), rules))
    judged = p.select("host", F.col("fit.verdict").alias("v")).where("host <> '' and v is not null").groupBy("host").agg(F.count_if(F.col("v") == "allow").alias("t"), F.count_if(F.col("v") == "block").alias("d"))
    judged = judged.select("host", F.inline(F.array(*(F.struct(F.lit(s).alias("side"), (F.col(s) / (F.col("t") + F.col("d"))).alias("x")) for s in "td")))).where("x > 0")
    judged = materialize(judged, "seeds")
    weight = judged.groupBy("side").agg(F.sum("x").alias("sum"))  # two rows
    seeds = judged.join(F.broadcast(weight), "side").select("side", "host", (F.col("x") / F.col("sum")).alias("weight"))
    rank = propagate(materialize(host_edges(p), "edges"), seeds, damping, steps)
    wide = rank.groupBy("host").agg(*(F.sum(F.when(F.col("side") == s, F.col("rank")).otherwise(0.0)).alias(n) for s, n in (("t", "trust"), ("d", "distrust"))))
    wide = materialize(wide, "hosts")
    mean = 1.0 / max(wide.count(), 1)
    bad = (F.col("distrust") > ratio * F.col("trust")) & (F.col("distrust") > floor * mean)
    wide = wide.select(F.col("host").alias("h"), "trust", "distrust", bad.alias("bad"))
    out = p.drop("html").join(wide, F.col("host") == F.col("h"), "left")
    verdict = F.coalesce("fit.verdict", F.when(F.col("bad"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
