"""Near-duplicate classes by BagMinHash over the multiset of five-word shingles.

A text is the multiset of its runs of five words (`textkit`; a shorter text is one run). Two texts are near copies when
their weighted Jaccard similarity, sum(min)/sum(max) of the counts, is at least `threshold`; classes are the connected
components of that relation.

Signatures are BagMinHash: every shingle owns a Poisson process over (arrival, level), with levels cut at the whole
counts. The levels are held as dyadic blocks [0,1), [1,2), [2,4), ...; a block's process is generated at the rate of its
width and each point is then placed at a level inside it, which is the chain of binary splits taken at once, so a
shingle of count w needs about log2(w) blocks. A point below the shingle's count competes for one of the `bands * rows`
registers; a process stops as soon as it has passed the largest register of its text. Equal registers have, for each
position, the probability of the weighted Jaccard similarity. A register keeps the integer name of its point, and names are
what is compared, so texts agree whatever the last bits of a logarithm are on the machine that made them.

Candidates share a band. They are not expanded into pairs: texts with the same multiset are one node; each node is first
verified against one hub of its buckets, then against the hubs of buckets that still hold several components, and at
last every pair of texts of such buckets that are still in two components and can be similar by an exact prefix filter
(`torn_pairs`) is verified. The hub is the text that shares the most buckets' members, so it is the centre of a group of near copies. A pair that is skipped is one whose ends are in one component already, so no link is lost to the order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import lists, struct, text_function
from .components import components
from .scratch import materialize
from .textkit import mix, salt, shingles, unit, words

THRESHOLD, BANDS, ROWS, SHINGLE = 0.8, 20, 5, 5
_U = np.uint64
_G = _U(0x9E3779B97F4A7C15)


def multisets(texts: list[str | None], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle, count), sorted by text and shingle."""
    text, h = shingles(words(texts), n)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.append(at, len(h)))


def bag_min_hash(text: np.ndarray, item: np.ndarray, count: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """Registers (n_texts, m): the name of the first point of each; 0 for texts without items."""
    reg, name = np.full(n_texts * m, np.inf), np.zeros(n_texts * m, _U)
    rows, seeds, lows, widths, tops = [], [], [], [], []
    lo, width = 0, 1
    while len(item):  # dyadic blocks of levels
        rows.append(text), seeds.append(mix(item + salt(lo + 1))), tops.append(count)
        lows.append(np.full(len(item), lo)), widths.append(np.full(len(item), width))
        lo, width = lo + width, lo + width
        more = count > lo
        text, item, count = text[more], item[more], count[more]
    if not rows:
        return name.reshape(n_texts, m)
    row, seed, low, rate, top = (np.concatenate(x) for x in (rows, seeds, lows, widths, tops))
    time, step = np.zeros(len(row)), 0
    while len(row):
        step += 1
        time = time - np.log(unit(mix(seed + salt(3 * step)))) / rate
        at = mix(seed + salt(3 * step + 1))
        place, point, when = row * m + (at % _U(m)).astype(np.int64), at, time
        if step == 1 or (rate > 1).any():
            ok = low + (unit(mix(at + _G)) * rate).astype(np.int64) < top
            place, point, when = place[ok], at[ok], time[ok]
        np.minimum.at(reg, place, when)
        first = when == reg[place]
        name[place[first]] = point[first]
        used = np.unique(row)
        most = np.zeros(n_texts)
        most[used] = reg.reshape(n_texts, m)[used].max(1)
        on = time < most[row]
        row, seed, low, rate, top, time = row[on], seed[on], low[on], rate[on], top[on], time[on]
    return name.reshape(n_texts, m)


def band_keys(reg: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each text."""
    coef = mix(np.arange(1, rows + 1, dtype=_U))
    return mix((mix(reg.reshape(len(reg), bands, rows)) * coef).sum(2, dtype=_U) + np.arange(1, bands + 1, dtype=_U) * _G)


def nodes_of(text: np.ndarray, item: np.ndarray, count: np.ndarray, n_texts: int) -> list[bytes | None]:
    """16 bytes that stand for the multiset; None for a text without words."""
    k = mix(item + mix(count.astype(_U)))
    both = np.zeros((n_texts, 2), _U)
    at = np.searchsorted(text, np.arange(n_texts + 1))
    for j, x in enumerate((k, mix(k + _G))):
        s = np.concatenate((np.zeros(1, _U), np.cumsum(x, dtype=_U)))
        both[:, j] = s[at[1:]] - s[at[:-1]]
    raw = both.tobytes()
    return [raw[16 * i : 16 * i + 16] if at[i + 1] > at[i] else None for i in range(n_texts)]


def _signatures(bands: int, rows: int, shingle: int):
    """node and band keys of each text."""

    def work(texts: list[str | None]) -> pa.Array:
        t, h, c = multisets(texts, shingle)
        keys = band_keys(bag_min_hash(t, h, c, len(texts), bands * rows), bands, rows).view(np.int64)
        return struct(node=pa.array(nodes_of(t, h, c, len(texts)), pa.binary()), keys=lists(np.arange(len(texts) + 1) * bands, keys.ravel()))

    return text_function(work, "node binary, keys array<bigint>")


def _expanded(shingle: int):
    """node of each text and its multiset as a sorted set: the k-th copy of a shingle is an element of its own."""

    def work(texts: list[str | None]) -> pa.Array:
        t, h, c = multisets(texts, shingle)
        copy = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        e = mix(np.repeat(h, c) + copy.astype(_U) * _G).view(np.int64)
        at = np.searchsorted(np.repeat(t, c), np.arange(len(texts) + 1))
        return struct(node=pa.array(nodes_of(t, h, c, len(texts)), pa.binary()), items=lists(at, e))

    return text_function(work, "node binary, items array<bigint>")


def torn_pairs(items: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (node, p) of different components that can be similar, without expanding buckets.

    Prefix filter: order items by how many of `nodes` have them, rare ones first. Two sets of sizes n with a similarity of at
    least t share one of the first n - ceil(t * n) + 1 items of each. An edit makes items that no other text has, so texts that were
    edited too much for any partner have only unique items there, and drop out. Of the others, those that share an item
    pair up, but only outside the item's largest component.
    """
    held = materialize(items.join(nodes, "node").select("node", "comp", F.size("items").alias("n"), F.explode("items").alias("item")), "torn_items")
    common = held.groupBy("item").agg(F.count("*").alias("df"))
    ranked = held.join(common, "item").groupBy("node", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("order"))
    first = F.expr(f"slice(order, 1, n - cast(ceil(n * {threshold} - 1e-9) as int) + 1)")
    prefix = ranked.select("node", "comp", "n", F.posexplode(first).alias("i", "x")).where("x.df > 1").select("node", "comp", F.col("x.item").alias("item"), (F.col("n") - F.col("i")).alias("left"), "n")
    prefix = materialize(prefix, "prefixes")
    per = prefix.groupBy("item", "comp").agg(F.count("*").alias("n"))
    top = per.groupBy("item").agg(F.max(F.struct("n", "comp"))["comp"].alias("top"), F.count("*").alias("comps")).where("comps > 1")
    rest = prefix.join(top, "item").where("comp <> top").select("item", F.col("node").alias("p"), F.col("comp").alias("p_comp"), F.col("left").alias("p_left"), F.col("n").alias("p_n"))
    # at their first common item, what is left of the smaller rest bounds the overlap; a similar pair passes there
    enough = F.least("left", "p_left") >= threshold / (1 + threshold) * (F.col("n") + F.col("p_n")) - 1e-9
    return prefix.join(rest, "item").where((F.col("comp") != F.col("p_comp")) & enough).select("node", "p")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """One row (doc_id, class_id, n_links) for every row of `docs` (doc_id, text; further columns are ignored).

    class_id is the least doc_id of the class; n_links counts the verified links of the row's text that were needed to
    join the class, 0 for a text that stands alone. Null texts, and texts without words, are near copies of nothing, so
    their class is their own doc_id; exact copies of a text with words share a class. Repeated rows are returned as often
    as they come. A null doc_id is kept, and its class is the least doc_id that is not null, or null. Very long texts are
    hashed whole, piece by piece, and compare by all their runs of words. An empty table gives no rows.
    """
    d = docs.select("doc_id", "text")
    sig = materialize(d.select("doc_id", _signatures(bands, rows, shingle)("text").alias("of")).select("doc_id", "of.*"), "signatures")
    node_key = sig.where("node is not null").select("node", F.explode("keys").alias("key")).distinct()
    bucket = node_key.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(node_key.join(bucket, "key"), "buckets")
    degree = shared.groupBy("node").agg(F.sum("n").alias("degree"))  # a text amid many near copies shares the most
    ranked = materialize(shared.select("key", "node").join(degree, "node"), "ranked")
    hub = ranked.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("hub"))
    member = materialize(ranked.join(hub, "key"), "members")

    ids = sig.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(member.select("node").distinct(), "node", "left_semi")
    texts = d.join(ids, d["doc_id"].eqNullSafe(ids["doc_id"])).select(F.col("node").alias("want"), "text")
    items = texts.select("want", _expanded(shingle)("text").alias("of")).select("want", "of.*").where("want = node")
    # a node's rows are equal; the copies that share its least doc_id are few, and one is kept without gathering them
    items = materialize(items.select("node", "items").dropDuplicates(["node"]), "items")

    def verified(pairs: DataFrame) -> DataFrame:
        one = items.select(F.col("node").alias("a"), F.col("items").alias("x"))
        two = items.select(F.col("node").alias("b"), F.col("items").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        alike = both / (F.size("x") + F.size("y") - both) >= threshold
        close = F.least(F.size("x"), F.size("y")) >= threshold * F.greatest(F.size("x"), F.size("y"))
        return pairs.join(one, "a").join(two, "b").where(close & alike).select("a", "b")

    pair = lambda p, q: (F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    first = member.groupBy("node").agg(F.max("hub")["node"].alias("hub")).where("hub <> node")
    links = materialize(verified(first.select(*pair("node", "hub")).distinct()), "links")
    for hub_of in (F.struct("degree", "node", "comp"), F.struct(F.xxhash64("node", "key"), "node", "comp"), None):
        comp = components(links)
        held = member.select("key", "node", "degree").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        torn = held.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("degree", "node", "comp") if hub_of is None else hub_of).alias("hub")).where("lo <> hi")
        held = materialize(held.join(torn.select("key", F.col("hub.node").alias("hub"), F.col("hub.comp").alias("hub_comp")), "key"), "torn")
        if hub_of is not None:
            tried = held.where("comp <> hub_comp").select(*pair("node", "hub")).distinct()
        else:
            tried = torn_pairs(items, held.select("node", "comp").distinct(), threshold).select(*pair("node", "p")).distinct()
        links = materialize(links.unionByName(verified(tried)).distinct(), "links")
    comp = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    least = sig.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    of_node = least.join(comp, "node", "left").join(degree, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of_node = materialize(of_node, "nodes")
    of_comp = of_node.groupBy("comp").agg(F.min("least").alias("class_id"))
    named = of_node.join(of_comp, "comp").select("node", "class_id", "n_links")
    return sig.select("doc_id", "node").join(named, "node", "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that stay when one document of each class does: the one with the least doc_id.

    Rows that share a doc_id are one document: they stay or go together. Rows without words, or with a null doc_id, are
    kept. Very long texts are compared whole; further columns, of any name, stay as they are; an empty table gives no rows.
    """
    classes = near_duplicates(docs, **options)
    gone = classes.where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
