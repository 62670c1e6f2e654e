"""Decontamination against a plain version of the same rules, and copies that meet in one hash."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from math import floor

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from zonaris.llm import decontam
from zonaris.llm.textkit import _FOLD, _PLAIN

UNITS = set(decontam.UNITS.split())


def tokens_of(text):
    """(folded word, kind) of each word: the rules of a template, one word at a time."""
    found = list(_PLAIN.finditer(text or ""))
    capital = lambda c: "A" <= c <= "Z" or 0xC0 <= ord(c) <= 0xDE and ord(c) != 0xD7
    rows, end = [], 0
    for k, m in enumerate(found):
        w = m.group()
        opens = k == 0 or any(c in ".!?\n" for c in text[end : m.start()])
        rows.append((w.translate(_FOLD), w.isascii() and w.isdigit(), capital(w[0]), opens))
        end = m.end()
    inner = [r for r in rows if not r[3] and not r[1]]
    loud = sum(r[2] for r in inner) > 0.5 * max(1, len(inner))
    out = []
    for k, (w, number, cap, opens) in enumerate(rows):
        unit = k > 0 and rows[k - 1][1] and w in UNITS
        out.append((w, 1 if number else 2 if unit else 3 if cap and not opens and not loud else 0))
    return out


def windows_of(tokens, base):
    """(position, template, values that a slot takes in sorted order) of every window, templated and with names as words."""
    for p in range(len(tokens) - 4):
        part = tokens[p : p + 5]
        plain = [k for _, k in part].count(0)
        names = [k for _, k in part].count(3)
        if plain >= 2:
            yield p, tuple(w if k == 0 else k for w, k in part), [w for w, k in part if k], []
        if names and (plain >= 2 if base else plain + names >= 2):
            yield p, tuple(w if k in (0, 3) else k for w, k in part), [w for w, k in part if k in (1, 2)], [w for w, k in part if k == 3]


def plain_leaks(docs, items, threshold=0.8):
    found = {}
    table = defaultdict(set)
    of = {}
    for i, text in items:
        tokens = tokens_of(text)
        rows = list(windows_of(tokens, True))
        if rows:
            of[i] = len({r[0] for r in rows})
        for p, t, slots, names in rows:
            table["template", t].add((i, p, tuple(slots), tuple(names)))
        if not rows and tokens:
            m = min(5, len(tokens))
            of[i] = len(tokens) - m + 1
            for p in range(len(tokens) - m + 1):
                table["raw", tuple(w for w, _ in tokens[p : p + m])].add((i, p, (), ()))
    lengths = {len(t) for kind, t in table if kind == "raw"}
    for d, text in docs:
        tokens = tokens_of(text)
        rows = [(p, ("template", t), slots) for p, t, slots, _ in windows_of(tokens, False)]
        rows += [(p, ("raw", tuple(w for w, _ in tokens[p : p + m])), []) for m in lengths for p in range(len(tokens) - m + 1)]
        hits = defaultdict(set)
        for p, key, slots in rows:
            for i, q, own, names in table.get(key, ()):
                hits[i].add((q, p - q, tuple(sorted([*zip(own, slots, strict=True), *((n, n) for n in names)]))))
        for i, rows_ in hits.items():
            for width in (0, 1, 8, 32, 128):
                for phase in (0, 1) if width > 1 else (0,):
                    groups = defaultdict(set)
                    for q, shift, pairs in rows_:
                        groups[0 if width == 0 else shift if width == 1 else floor((2 * shift + phase * width) / (2 * width))].add((q, pairs))
                    for g in groups.values():
                        votes = Counter(x for _, pairs in g for x in pairs)
                        chosen = defaultdict(set)  # of equally frequent values any may be taken
                        for (a, b), n in votes.items():
                            if n == max(m for (x, _), m in votes.items() if x == a):
                                chosen[a].add(b)
                        sure = all(len(v) == 1 for v in chosen.values())
                        fits = [(q, pairs) for q, pairs in g if all(b in chosen[a] for a, b in pairs)]
                        share = len({q for q, _ in fits}) / of[i]
                        if share >= threshold:
                            best = (share, all(a == b for _, pairs in fits for a, b in pairs), sure)
                            found[d, i] = max(found.get((d, i), best), best)
    return found


NAMES, WORDS = ["Anna", "Boris", "Clara", "Doran"], [f"{a}{b}" for a in ("lo", "mi", "ta", "ren", "sul") for b in ("na", "ver", "dok", "pim", "est")]


def made(rnd):
    """Items with numbers, units and names; documents with copies: verbatim, reworded, with words put in or left out, in parts."""
    word = lambda: rnd.choice(WORDS)

    def item():
        parts = [rnd.choice([word(), word(), word(), str(rnd.randint(1, 40)), f"{rnd.randint(1, 9)} km", rnd.choice(NAMES)]) for _ in range(rnd.choice([2, 4, 9, 25, 40]))]
        return " ".join(["So", *parts]) + "."

    items = [(k, item()) for k in range(12)] + [(50, None), (51, "7"), (None, item())]
    docs = []
    for d in range(60):
        text = []
        for _ in range(rnd.randint(0, 3)):
            parts = (rnd.choice(items)[1] or "").split(" ")
            how = rnd.randrange(5)
            if how == 1:
                swap = {x: rnd.choice(NAMES) for x in NAMES} | {str(n): str(rnd.randint(50, 90)) for n in range(41)}
                parts = [swap.get(x, x) for x in parts]
            elif how == 2:
                parts.insert(rnd.randint(0, len(parts)), word())
            elif how == 3 and len(parts) > 3:
                del parts[rnd.randint(1, len(parts) - 1)]
            elif how == 4:
                parts = [x.lower() for x in parts]
            text += [word() for _ in range(rnd.randint(0, 30))] + ["."] + parts
        docs.append((d, " ".join(text)))
    return docs + [(70, None), (None, docs[3][1]), (71, "")], items


@pytest.mark.parametrize("seed", range(4))
def test_leaks_are_those_of_a_plain_version(spark, seed):
    docs, items = made(random.Random(seed))
    got = {(r["doc_id"], r["item_id"]): (r["coverage"], not r["reworded"]) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = plain_leaks(docs, items)
    sure = {k for k, v in want.items() if v[2]}  # no tie between values was to be broken
    assert len(sure) > 20 and sure <= got.keys() <= want.keys()
    exact = {k: (pytest.approx(want[k][0]), want[k][1]) for k in sure if want[k][0] == 1.0 and want[k][1]}
    assert len(exact) > 5 and {k: got[k] for k in exact} == exact
    assert all(got[k][0] <= want[k][0] + 1e-9 for k in got)


def test_leaks_of_the_given_tables_are_those_of_a_plain_version(spark):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    want = plain_leaks([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    assert got and {k for k, v in want.items() if v[2]} <= got <= want.keys()


def test_a_common_passage_is_settled_without_ranges(spark):
    """Many documents that share an item: what is laid out over ranges does not grow with them."""
    item = " ".join(WORDS) + " " + " ".join(reversed(WORDS))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("start "), F.col("id").cast("string"), F.lit(" . " + item + " . end")).alias("text"))
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    sizes, write = {}, decontam.materialize
    decontam.materialize = lambda df, name: sizes.setdefault(name, write(df, name))
    try:
        got = decontam.leaks(docs, bench).collect()
    finally:
        decontam.materialize = write
    assert {(r["coverage"], r["reworded"]) for r in got} == {(1.0, False)} and len(got) == 300
    assert sizes["hits"].count() >= 300 * 46 and sizes["aligned"].count() == 0
