"""Ranks and verdicts of hosts without a rule against plain propagation."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from tests.conftest import SMALL
from zonaris.llm import queries, urlrank


def plain_verdicts(pages, ratio=urlrank.RATIO, floor=urlrank.FLOOR, damping=urlrank.DAMPING, steps=urlrank.STEPS):
    """(page, host, path, rule, verdict, trust, distrust) of each page, by dictionaries."""
    lower = lambda s: s.translate({c: c + 32 for c in range(65, 91)})
    rows = []
    for page, url, html in pages:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), -k, h + p, v) for k, (v, h, p) in enumerate(urlrank.RULES) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rows.append((page, host, path, *(max(fits)[2:] if fits else (None, None)), html))
    hosts = {r[1] for r in rows if r[1]}
    edges = Counter()
    for _, host, _, _, _, html in rows:
        if host:
            for name in set(re.findall(urlrank.NAME.replace("\\\\", "\\"), html or "")):
                if lower(name) in hosts and lower(name) != host:
                    edges[host, lower(name)] += 1
    for h in hosts:
        if h.count(".") > 1:
            edges[h, h.split(".", 1)[1]] += 1
    judged = defaultdict(Counter)
    for _, host, _, _, verdict, _ in rows:
        if host and verdict:
            judged[host][verdict] += 1
    ranks = {}
    for side, want in (("t", "allow"), ("d", "block")):
        seeds = {h: c[want] / sum(c.values()) for h, c in judged.items() if c[want]}
        total = sum(seeds.values())
        seeds = {h: x / total for h, x in seeds.items()}
        links = {(a, b) if side == "t" else (b, a): n for (a, b), n in edges.items()}
        out = Counter()
        for (a, _), n in links.items():
            out[a] += n
        rank = dict(seeds)
        for _ in range(steps):
            got = defaultdict(float)
            for (a, b), n in links.items():
                got[b] += damping * rank.get(a, 0.0) * n / out[a]
            left = 1 - sum(got.values())
            for h, x in seeds.items():
                got[h] += x * left
            rank = got
        ranks[side] = rank
    mean = 1 / max(1, len(set(ranks["t"]) | set(ranks["d"])))
    result = []
    for page, host, path, rule, verdict, _ in rows:
        t, d = ranks["t"].get(host, 0.0), ranks["d"].get(host, 0.0)
        result.append((page, host, path, rule, verdict or ("block" if d > ratio * t and d > floor * mean else "allow"), t, d))
    return result


def check(spark, pages, got):
    got = {r["page_id"]: r for r in got}
    want = plain_verdicts(pages)
    sure = 0
    for page, host, path, rule, verdict, t, d in want:
        r = got[page]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["trust"] == pytest.approx(t, abs=1e-9) and r["distrust"] == pytest.approx(d, abs=1e-9)
        if abs(t - d) > 1e-9:
            assert r["verdict"] == verdict
            sure += rule is None and verdict == "block"
    return sure


def test_verdicts_of_the_given_pages(spark):
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    check(spark, pages, queries.QUERIES["op2_url_filters"](spark, SMALL).collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_verdicts_without_a_rule_are_those_of_plain_propagation(spark, seed):
    rnd = random.Random(seed)
    names = ["a.org", "b.org", "x.example.org", "y.example.org", "f.com", "g.com", *(f"h{k}.net" for k in range(12)), "sub.h1.net"]
    paths = ["/", "/es/1", "/en/1", "/fr/2", "/de/3", "/x?q#z"]
    pages = []
    for k in range(60):
        host = rnd.choice(names)
        links = " ".join(f'<a href="https://{rnd.choice(names)}/p">t</a>' for _ in range(rnd.randint(0, 4)))
        pages.append((k, f"https://{host.upper() if k % 7 == 0 else host}{rnd.choice(paths)}", links if k % 11 else None))
    pages += [(100, None, "h1.net"), (101, "no scheme", None)]
    got = urlrank.filter_urls(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()
    assert check(spark, pages, got) >= 1
