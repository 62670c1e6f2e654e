"""Benchmark decontamination by template windows and slot consistency.

A text's words become a template: numbers, names and units turn into typed placeholders (slots), other words stay as they are.
Windows of `window` template words are hashed and joined with the benchmark's. A pair of document and item is kept when
windows that hold at least `threshold` of the item's windows match and fill the slots consistently: within one alignment,
each value of the item's slots must stand for one value of the document, the most frequent one. So a question that was given
other numbers or names is found, and text that only has the same shape is not.

The alignment of a matched window is its position in the document minus that in the item. Slots are judged at each single
alignment (a copy with as many words), within overlapping ranges of alignments (`RANGES`: words were put in or left out) and
over the whole document (parts far apart); the best counts. So copies in one document do not vote on each other's slots. A pair that has all its
windows at one alignment, with the item's own values, is settled at once; only the others are laid out over ranges.

Where capitals tell nothing (headlines, lower case), names cannot be told from other words. So a window that holds names
is hashed a second time with its names as literal words, in lower case, and an item's window may be found by either hash.

An item without a window of enough literal words (short, or mostly numbers) is looked for by raw windows: runs of its words
as they are, slots included, of the window's length or, if the item is shorter, of all its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import lists, row_function
from .scratch import materialize
from .textkit import Words, mix, salt, words

WINDOW, THRESHOLD, LITERALS = 5, 0.8, 2
#: The benchmark's window hashes are sent to all tasks as a filter while there are at most so many (8 bytes each).
FILTER_WINDOWS = 200_000
#: Widths of the ranges of alignments, in words; each is laid twice, shifted by half, so that no border parts a drift of half a width.
RANGES = (8, 32, 128)
#: Units of measure and currency words that follow a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons pound pounds ml l liter liters litre litres gallon gallons "
    "s sec min h hr hour hours minute minutes second seconds day days week weeks month months year years "
    "percent degree degrees c f k dollar dollars euro euros cent cents usd eur gbp w kw v a hz khz mhz"
)
_U = np.uint64
_SLOT = mix(np.array([101, 102, 103], _U))  # number, unit, name


def _hash_word(word: str) -> int:
    return int(words([word]).hash[0])


_unit_hashes: list[np.ndarray] = []


def template(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(template hash, slot kind) of each word; kind 0 is a literal word, 1 a number, 2 a unit, 3 a name.

    A unit is a unit word right after a number. A name is a capitalised word inside a sentence, except in a text where over half of
    such words are capitalised (headlines, capitals only).
    """
    if not _unit_hashes:
        _unit_hashes.append(np.sort(np.array([_hash_word(x) for x in UNITS.split()], _U)))
    kind = np.zeros(len(w.hash), np.int8)
    inner = ~w.opens & ~w.number
    loud = np.bincount(w.text, inner & w.capital, w.n_texts) > 0.5 * np.maximum(np.bincount(w.text, inner, w.n_texts), 1)
    kind[inner & w.capital & ~loud[w.text]] = 3
    kind[w.number] = 1
    if len(kind) > 1:
        after = np.zeros(len(kind), bool)
        after[1:] = w.number[:-1] & (w.text[1:] == w.text[:-1])
        kind[after & np.isin(w.hash, _unit_hashes[0])] = 2
    return np.where(kind > 0, _SLOT[np.maximum(kind, 1) - 1], w.hash), kind


def windows(texts: list[str | None], window: int = WINDOW, literals: int = LITERALS, base: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash, first word, plain, words, kinds) of all windows with at least `literals` literal words, and the words' hashes and kinds.

    A window with names is told twice, the second time (plain) with them as literal words; with `base` only if it has
    enough literal words besides. A text of fewer words than a window has none.
    """
    w = words(texts)
    t, kind = template(w)
    n = len(t)
    at = np.flatnonzero(w.text[window - 1 :] == w.text[: max(0, n - window + 1)]) if n >= window else np.zeros(0, np.int64)
    h, lit, names = np.zeros(len(at), _U), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for k in range(window):
        h += t[at + k] * _place(k)
        lit += kind[at + k] == 0
        names += kind[at + k] == 3
    ok = lit >= literals
    also = np.flatnonzero((names > 0) & (ok if base else lit + names >= literals))
    plain_at, g = at[also], h[also]
    for k in range(window):
        j = plain_at + k
        g += np.where(kind[j] == 3, w.hash[j] - t[j], _U(0)) * _place(k)
    at, h = np.concatenate((at[ok], plain_at)), mix(np.concatenate((h[ok], g)))
    plain = np.arange(len(at)) >= int(ok.sum())
    return w.text[at], at - w.starts()[w.text[at]], h, at, plain, w.hash, kind


def _place(k: int) -> np.uint64:
    return mix(np.array([201 + k], _U))[0]


def _rows(texts: list[str | None], window: int, literals: int, wanted: np.ndarray | None, base: bool = False) -> tuple[np.ndarray, dict]:
    """Text index and columns of the windows. `slots` are the values of the slots in their order; `names` those of a plain
    window's names, which stand for themselves."""
    text, pos, h, at, plain, value, kind = windows(texts, window, literals, base)
    if wanted is not None:
        i = np.minimum(np.searchsorted(wanted, h), max(0, len(wanted) - 1))
        hit = wanted[i] == h if len(wanted) else np.zeros(len(h), bool)
        text, pos, h, at, plain = text[hit], pos[hit], h[hit], at[hit], plain[hit]
    place = at[:, None] + np.arange(window)
    v, k = value[place].view(np.int64) if len(at) else np.zeros((0, window), np.int64), kind[place] if len(at) else np.zeros((0, window), np.int8)
    slots = (k > 0) & ((k < 3) | ~plain[:, None])
    names = (k == 3) & plain[:, None]
    return text, {"pos": pos.astype(np.int64), "key": h.view(np.int64), **{n: lists(np.concatenate(([0], np.cumsum(m.sum(1)))), v[m]) for n, m in (("slots", slots), ("names", names))}}


def raw_windows(w: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of all runs of `length` words, compared as they are."""
    n = len(w.hash)
    at = np.flatnonzero(w.text[length - 1 :] == w.text[: n - length + 1]) if n >= length else np.zeros(0, np.int64)
    h = np.full(len(at), salt(300 + length))
    for k in range(length):
        h += w.hash[at + k] * _place(k)
    return w.text[at], at - w.starts()[w.text[at]], mix(h)


def _raw_rows(texts: list[str | None], lengths: list[int], wanted: np.ndarray | None, window: int) -> Iterator[tuple[np.ndarray, dict]]:
    w = words(texts) if lengths else None
    for m in lengths:
        text, pos, h = raw_windows(w, m)
        if wanted is not None:
            hit = np.isin(h, wanted)
            text, pos, h = text[hit], pos[hit], h[hit]
        if m < window:  # all of an item: a text's first one tells everything
            first = np.sort(np.unique(np.stack((text.astype(_U), h)), axis=1, return_index=True)[1])
            text, pos, h = text[first], pos[first], h[first]
        none = lists(np.zeros(len(h) + 1, np.int64), np.zeros(0, np.int64))
        yield text, {"pos": pos.astype(np.int64), "key": h.view(np.int64), "slots": none, "names": none}


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, literals: int = LITERALS, filter_windows: int = FILTER_WINDOWS) -> DataFrame:
    """(doc_id, item_id, coverage, reworded) for each document and benchmark item that it contains.

    `docs` has doc_id and text, `benchmark` item_id and text; further columns are ignored. coverage is the share of the item's
    windows (with enough literal words) found with consistent slots; reworded tells that some slot has another value (of
    alignments with equal coverage, one without such a slot is told).
    Items without such windows are found by their words as they are. Texts without words, null texts and empty tables match nothing; very long texts are read whole; a null id is an id like any other. Repeated rows are judged as one document;
    texts that share a doc_id are judged apart and the best is told. Hashes of the benchmark are sent to tasks as a
    filter only while there are at most `filter_windows`; above that the windows are joined without it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()

    def of_items(texts: list[str | None]) -> Iterator[tuple[np.ndarray, dict]]:
        text, rows = _rows(texts, window, literals, None, base=True)
        yield text, {**rows, "raw": np.zeros(len(text), np.int32)}
        poor = np.setdiff1d(np.arange(len(texts)), text)
        size = np.diff(words([texts[i] for i in poor]).starts())
        for m in range(1, window + 1):
            part = poor[np.minimum(size, window) == m]
            for text, rows in _raw_rows([texts[i] for i in part], [m], None, window):
                yield part[text], {**rows, "raw": np.full(len(text), m, np.int32)}

    items = benchmark.select("item_id", "text").mapInArrow(row_function(of_items, ["item_id"]), f"item_id {item_kind}, pos bigint, key bigint, slots array<bigint>, names array<bigint>, raw int")
    items = materialize(items.dropDuplicates(["item_id", "pos", "key"]), "items")
    known = [r["key"] for r in items.select("key").distinct().limit(filter_windows + 1).collect()]
    wanted = None if len(known) > filter_windows else docs.sparkSession.sparkContext.broadcast(np.sort(np.array(known, np.int64).view(_U)))

    lengths = sorted(r["raw"] for r in items.where("raw > 0").select("raw").distinct().collect())  # at most `window` values

    def of_docs(texts: list[str | None]) -> Iterator[tuple[np.ndarray, dict]]:
        yield _rows(texts, window, literals, None if wanted is None else wanted.value)
        yield from _raw_rows(texts, lengths, None if wanted is None else wanted.value, window)

    d = docs.select("doc_id", "text").withColumn("node", F.xxhash64("text"))
    found = d.mapInArrow(row_function(of_docs, ["doc_id", "node"]), f"doc_id {kind}, node bigint, pos bigint, key bigint, slots array<bigint>, names array<bigint>").drop("names")
    found = materialize(found, "found")
    text = ["doc_id", "node"]
    # A text that holds `threshold` of an item's n windows holds one of any n - ceil(threshold * n) + 1 of them, so pairs come from the
    # windows of each item that the fewest texts and items have; a window that many have is met only inside such pairs.
    common = found.groupBy("key").agg(F.count("*").alias("hits")).join(items.groupBy("key").agg(F.count("*").alias("uses")), "key", "right")
    weight = items.join(common, "key").groupBy("item_id", "pos").agg(F.sum(F.coalesce("hits", F.lit(0)) * F.col("uses")).alias("weight"))
    of_item = Window.partitionBy("item_id")
    rare = weight.select("item_id", "pos", F.row_number().over(of_item.orderBy("weight", "pos")).alias("nth"), F.count("*").over(of_item).alias("of"))
    rare = rare.where(F.col("nth") <= F.col("of") - F.ceil(F.col("of") * threshold - 1e-9) + 1).select("item_id", "pos")
    key_of = _join(items.select("item_id", "pos", "key"), rare, ["item_id", "pos"]).select("item_id", "key").distinct()
    pairs = materialize(found.select(*text, "key").distinct().join(key_of, "key").select(*text, "item_id").distinct(), "pairs")
    side = items.select("item_id", F.col("pos").alias("item_pos"), "key", F.col("slots").alias("item_slots"), "names")
    zipped = F.concat(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")), F.arrays_zip(F.col("names").alias("a"), F.col("names").alias("b")))
    zipped = F.array_sort(zipped).alias("pairs")  # one order, so that a window found by both hashes counts once
    near = _join(pairs, found, text)
    hit = _join(near, side, ["item_id", "key"]).select("doc_id", "node", "item_id", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"), zipped)
    same = F.forall("pairs", lambda p: p["a"].eqNullSafe(p["b"])).alias("same")
    hit = materialize(hit.distinct().select("*", same), "hits")
    pair = ["doc_id", "node", "item_id"]
    whole = items.groupBy("item_id").agg(F.countDistinct("pos").alias("of"))
    # no choice of slots lifts a pair above the share of the item's windows that it hits at all
    per = hit.groupBy(*pair, "item_pos").agg(F.lit(1).alias("one")).groupBy(*pair).agg(F.count("*").alias("most"))
    may = _join(per, whole, ["item_id"]).where(F.col("most") / F.col("of") >= threshold)
    # Most pairs are settled here: one alignment has all that the pair hits, with the item's own values, so nothing can be better.
    own = hit.groupBy(*pair, "shift").agg(F.count_if("same").alias("n")).groupBy(*pair).agg(F.max("n").alias("n"))
    state = materialize(_join(may, own, pair).select(*pair, "of", "most", (F.col("n") == F.col("most")).alias("settled")), "state")
    settled = state.where("settled").select("doc_id", "item_id", (F.col("most") / F.col("of")).alias("coverage"), F.lit(False).alias("reworded"))
    hit = _join(hit, state.where("not settled").select(*pair, "of"), pair)
    laid = [(0, F.lit(0)), (1, F.col("shift")), *((w, F.floor((2 * F.col("shift") + k * w) / (2 * w)) * 2 + k) for w in RANGES for k in (0, 1))]
    at = [F.struct(F.lit(w).alias("width"), n.cast("bigint").alias("place")) for w, n in laid]
    place = [*pair, "width", "place"]
    # placements are counted by the places of windows alone; slots come to those that can reach the threshold
    light = hit.select(*pair, "of", "item_pos", F.inline(F.array(*at))).distinct()
    may = light.groupBy(*place).agg(F.count("*").alias("n"), F.max("of").alias("most")).where(F.col("n") / F.col("most") >= threshold)
    spread = hit.select(*pair, "of", "item_pos", "pairs", F.inline(F.array(*at)))
    hit = materialize(_join(spread, may.select(*place), place).distinct(), "aligned")
    votes = hit.select(*place, F.inline("pairs")).groupBy(*place, "a", "b").agg(F.count("*").alias("n"))
    chosen = votes.groupBy(*place, "a").agg(F.max(F.struct("n", "b"))["b"].alias("b"))
    agreed = chosen.groupBy(*place).agg(F.map_from_entries(F.collect_list(F.struct("a", "b"))).alias("agreed"))  # at most the slots of one item
    judged = _join(hit, agreed, place, "left")
    judged = judged.withColumn("fits", F.forall("pairs", lambda p: F.col("agreed")[p["a"]] == p["b"])).withColumn("changed", F.exists("pairs", lambda p: p["a"] != p["b"]))
    per = judged.where("fits").groupBy(*place).agg(F.countDistinct("item_pos").alias("n"), F.max("of").alias("of"), F.max("changed").alias("reworded"))
    out = per.withColumn("coverage", F.col("n") / F.col("of")).where(F.col("coverage") >= threshold).select("doc_id", "item_id", "coverage", "reworded").union(settled)
    best = F.max(F.struct("coverage", (~F.col("reworded")).alias("verbatim"))).alias("best")  # of equal ones, the copy without other values
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.coverage", (~F.col("best.verbatim")).alias("reworded"))


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """`left` with the further columns of `right`, joined on keys that may be null."""
    r = right.withColumnsRenamed({c: f"r_{c}" for c in keys})
    on = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in keys]
    return left.join(r, on, how).drop(*(f"r_{c}" for c in keys))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` whose doc_id holds no benchmark item; rows with a null doc_id stay.

    Null and empty texts hold nothing; columns may have any name; repeated rows stay or go together; an empty table of documents gives
    no rows, an empty benchmark keeps all.
    """
    bad = leaks(docs, benchmark, **options).select("doc_id").where("doc_id is not null").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*(f"`{c.replace('`', '``')}`" for c in docs.columns))
