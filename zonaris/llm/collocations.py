"""Phrases that stand together more often than their parts, by hierarchical pair naming.

A phrase of k words is a pair of neighbouring phrases of k - 1 words that share k - 2 of them. Level by level, frequent
phrases get a name (an id), the texts become sequences of names, and neighbouring names become the pairs of the next level.
A pair's name keeps the names of its two halves. These are parent pointers: along the left ones lie the phrase's first words, along
the right ones its last, so counts for every cut, the words themselves and the phrases inside a longer one come from joins of
names, and no text is ever looked up.

Texts are held as blocks: of one language, at most `BLOCK_WORDS` words (a piece without separators is kept whole), one row each. A block
has a sequence of local numbers and, for each of them, its global name. Words and pairs are counted inside a block first, so only
one row for each block and distinct pair is shuffled. The names come back to the blocks by a join; before it, pairs that have no name are mostly
left out by a filter of `FILTER_BITS` bits, whose size does not depend on the data (with more names it lets more pairs through
to the join, which decides). A block's row is the largest unit of work: tables of blocks are written in row groups of `GROUP_BLOCKS`, as Spark reads and
writes a whole row group at once, and the names of a block meet it by a sort, not in a map of arrays, so a task's memory does not grow with its blocks.

The last level needs no names in the blocks: its phrases are counted as three neighbouring names of the level two below, where the filter lets both
pairs through, and only the frequent ones are joined to the names of their halves (a frequent phrase has frequent halves, so none is lost).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import lists, setting, small_batches
from .scratch import discard, materialize
from .textkit import mix

BLOCK_WORDS = 1 << 20
FILTER_BITS = 1 << 26
GROUP_BLOCKS = 4
#: Rows of counts that go back to Spark at once.
PART_ROWS = 1 << 16
#: Buckets in which the best of a language are taken first, so that no task sees all of a language's phrases.
BUCKETS = 32
#: What ends a piece, what parts words, and capitals; all other bytes are parts of words.
_FOLD = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n" * 10 + b" abcdefghijklmnopqrstuvwxyz")


class _Block:
    """Words of one language: local numbers in order of appearance, -1 after each piece."""

    def __init__(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.seq: list[int] = []

    def row(self, block: int, lang: str) -> pa.RecordBatch:
        seq = np.array(self.seq, np.int32)
        count = np.bincount(seq[seq >= 0], minlength=len(self.number))
        one = lambda x: lists(np.array([0, len(x)]), x)
        words = pa.array(list(self.number), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([lang], pa.string()), one(words), one(count), one(seq)], names=["block", "lang", "words", "count", "seq"])


def _blocks(most: int):
    """A mapInArrow function: texts and languages to blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId() << 40
        held: dict[str, _Block] = {}
        size = done = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size, done
            for lang, block in held.items():
                yield block.row(own + done, lang)
                block.number.default_factory = None  # it refers to the numbers, which would stay until Python's collector ran
                done += 1
            held.clear()
            size = 0

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                lang = lang.as_py()
                for piece in (text.as_py() or b"").translate(_FOLD).split(b"\n"):
                    words = piece.split(b" ")
                    block = held.get(lang)
                    if block is None:
                        block = held[lang] = _Block()
                    number = block.number
                    block.seq.extend([number[w] for w in words if w])
                    block.seq.append(-1)
                    size += len(words)
                    if size >= most:
                        yield from flush()
        yield from flush()

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block: its row, the places where two neighbours have names, the pair there by its local number, and left and right name and count of each pair."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            seq, name = (row.column(c)[0].values.to_numpy(zero_copy_only=False) for c in ("seq", "name"))
            at = np.flatnonzero((seq[:-1] >= 0) & (seq[1:] >= 0))
            n = max(1, len(name))
            code, number, count = np.unique(seq[at].astype(np.int64) * n + seq[at + 1], return_inverse=True, return_counts=True)
            yield row, at, number, name[code // n], name[code % n], count.astype(np.int64)


def _parts(*columns: np.ndarray | pa.Array, names: list[str]) -> Iterator[pa.RecordBatch]:
    batch = pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names)
    for start in range(0, batch.num_rows, PART_ROWS):
        yield batch.slice(start, PART_ROWS)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A mapInArrow function: blocks to (left, right, count) of their pairs; names belong to one language, so it need not be told."""
    for _, _, _, left, right, count in _rows(batches):
        yield from _parts(left, right, count, names=["left", "right", "count"])


def _two_bits(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that a pair sets."""
    h = mix(mix(left.view(np.uint64)) + right.view(np.uint64))
    return h % np.uint64(FILTER_BITS), mix(h) % np.uint64(FILTER_BITS)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A mapInArrow function: (left, right) to (word, bits) of the filter."""
    for batch in batches:
        bit = np.concatenate(_two_bits(*(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("left", "right"))))
        word, at = np.unique(bit >> np.uint64(6), return_inverse=True)
        bits = np.zeros(len(word), np.uint64)
        np.bitwise_or.at(bits, at, np.uint64(1) << (bit & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])


def _passing(bits: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether each pair passes the filter."""
    one, two = (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63)) for bit in _two_bits(left, right))
    return (one & two & np.uint64(1)).astype(bool)


def _tripled(bits):
    """A mapInArrow function: blocks to (first, middle, last, count) of three neighbouring names whose two pairs pass the filter; `bits` is its broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, at, number, left, right, _ in _rows(batches):
            on = _passing(bits.value, left, right)[number]
            next_to = np.flatnonzero(on[:-1] & on[1:] & (at[1:] == at[:-1] + 1))
            n = max(1, len(left))
            code, count = np.unique(number[next_to].astype(np.int64) * n + number[next_to + 1], return_counts=True)
            one, two = code // n, code % n
            yield from _parts(left[one], right[one], right[two], count.astype(np.int64), names=["first", "middle", "last", "count"])

    return run


def _located(bits):
    """A mapInArrow function: blocks to (block, number, left, right) of the pairs that pass the filter; `bits` is its broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, _, left, right, _ in _rows(batches):
            on = np.flatnonzero(_passing(bits.value, left, right))
            yield from _parts(pa.repeat(row.column("block")[0], len(on)), on, left[on], right[on], names=["block", "number", "left", "right"])

    return run


def _renamed(row: pa.RecordBatch, known: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
    """The block of pairs of a block: a pair stands at its left half's place, -1 where none has a name. `known` are the numbers of those that have one."""
    _, at, number, left, _, _ = next(_rows([row]))
    rank = np.full(len(left), -1, np.int32)
    rank[known] = np.arange(len(known))
    out = np.full(len(row.column("seq")[0].values), -1, np.int32)
    out[at] = rank[number]
    return _block_row(row, out, name)


def _named(row: pa.RecordBatch, known: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
    """The block whose numbers are those of the named words."""
    seq = row.column("seq")[0].values.to_numpy(zero_copy_only=False)
    rank = np.full(int(seq.max(initial=-1)) + 2, -1, np.int32)  # the last is for -1
    rank[known] = np.arange(len(known))
    return _block_row(row, rank[seq], name)


def _block_row(row: pa.RecordBatch, seq: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
    one = lambda x: lists(np.array([0, len(x)]), x)
    return pa.RecordBatch.from_arrays([row.column("block"), row.column("lang"), one(seq), one(name)], names=["block", "lang", "seq", "name"])


_BLOCK = "block bigint, lang string, seq array<int>, name array<bigint>"
_BLOCK_ARROW = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("seq", pa.list_(pa.int32())), ("name", pa.list_(pa.int64()))])


def _given(work):
    """A function of one block and its (block, number, id): the block that `work` makes with them; a block without a name is left out."""

    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        if not (block.num_rows and known.num_rows):
            return _BLOCK_ARROW.empty_table()
        number, name = (known.column(c).to_numpy() for c in ("number", "id"))
        return pa.Table.from_batches([work(block.combine_chunks().to_batches()[0], number, name)])

    return run


def _write_blocks(blocks: DataFrame, name: str) -> DataFrame:
    with setting(blocks.sparkSession, "parquet.block.row.count.limit", str(GROUP_BLOCKS)):
        return materialize(blocks, name)


def _with_names(blocks: DataFrame, located: DataFrame, work, level: int) -> DataFrame:
    """The blocks that `work` makes of each block and its (block, number, id) in `located`, at most its distinct ones. Those are written first, so that the
    shuffles before them are gone when the sequences move."""
    known = materialize(located.select("block", "number", "id"), f"known{level}")
    out = _write_blocks(blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_given(work), _BLOCK), f"named{level}")
    discard(blocks)
    discard(known)
    return out


def _filter_of(names: DataFrame):
    """The filter of the pairs that have names, as a broadcast: at most FILTER_BITS / 64 rows come to the driver."""
    words = names.select("left", "right").mapInArrow(_bits, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return names.sparkSession.sparkContext.broadcast(bits)


def phrase_names(docs: DataFrame, most_words: int, least: int, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """(words of each language, names of each level).

    Level 1 has (id, lang, word, f), the others (id, left, right, f): all phrases of as many words with f >= least occurrences; left and
    right are ids of the level below. Ids are unique within a level.
    """

    with small_batches(docs.sparkSession):
        return _phrase_names(docs, most_words, least, block_words)


def _phrase_names(docs: DataFrame, most_words: int, least: int, block_words: int) -> tuple[DataFrame, list[DataFrame]]:
    def named(counts: DataFrame, keys: list[str], level: int) -> DataFrame:
        names = counts.groupBy(*keys).agg(F.sum("count").alias("f")).where(F.col("f") >= least)
        return materialize(names.select(F.monotonically_increasing_id().alias("id"), *keys, "f"), f"names{level}")

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    raw = _write_blocks(texts.mapInArrow(_blocks(block_words), "block bigint, lang string, words array<string>, count array<bigint>, seq array<int>"), "blocks")
    total = materialize(raw.groupBy("lang").agg(F.sum(F.aggregate("count", F.lit(0).cast("bigint"), lambda a, b: a + b)).alias("n")), "words")
    words = raw.select("block", "lang", F.posexplode(F.arrays_zip(F.col("words").alias("word"), "count")).alias("number", "x")).select("block", "lang", "number", "x.*")
    levels = [named(words, ["lang", "word"], 1)]
    located = words.select("block", "lang", "number", "word").join(levels[0], ["lang", "word"]).select("block", "number", "id")
    blocks = _with_names(raw.select("block", "lang", "seq"), located, _named, 1)
    for level in range(2, most_words + 1):
        if level == most_words > 2:
            counts = blocks.mapInArrow(_tripled(bits), "first bigint, middle bigint, last bigint, count bigint").groupBy("first", "middle", "last").agg(F.sum("count").alias("f")).where(F.col("f") >= least)
            left = levels[-1].select(F.col("id").alias("left"), F.col("left").alias("first"), F.col("right").alias("middle"))
            right = levels[-1].select(F.col("id").alias("right"), F.col("left").alias("middle"), F.col("right").alias("last"))
            names = counts.join(left, ["first", "middle"]).join(right, ["middle", "last"])
            names = materialize(names.select(F.monotonically_increasing_id().alias("id"), "left", "right", "f"), f"names{level}")
        else:
            names = named(blocks.mapInArrow(_counted, "left bigint, right bigint, count bigint"), ["left", "right"], level)
        levels.append(names)
        if level < most_words:
            bits = _filter_of(names)
        if level < most_words - 1:
            found = blocks.mapInArrow(_located(bits), "block bigint, number bigint, left bigint, right bigint")
            blocks = _with_names(blocks, found.join(names.select("id", "left", "right"), ["left", "right"]), _renamed, level)
    discard(blocks)
    return total, levels


def _counts(levels: list[DataFrame]) -> list[DataFrame]:
    """Of each level from 2 on the counts of all beginnings (heads) and ends (tails) of its phrases: (id, lang, left, right, f, heads, tails)."""
    f = F.col("f")
    below = levels[0].select("id", "lang", F.array(f).alias("heads"), F.array(f).alias("tails"))
    out = []
    for names in levels[1:]:
        left = below.select(F.col("id").alias("left"), "lang", "heads")
        right = below.select(F.col("id").alias("right"), "tails")
        both = names.join(left, "left").join(right, "right")
        below = both.select("id", "lang", "left", "right", "f", F.concat("heads", F.array(f)).alias("heads"), F.concat("tails", F.array(f)).alias("tails"))
        if names is not levels[-1]:
            below = materialize(below, "counts")
        out.append(below)
    return out


def _with_words(chosen: DataFrame, levels: list[DataFrame], level: int) -> DataFrame:
    """`chosen` (with left and right) of a level and the array of each phrase's words, along the pointers: the last word, then the last of what stands before, and so on."""
    d = chosen.withColumns({"at": F.col("left"), "last": F.col("right"), "words": F.array().cast("array<string>")})
    for depth in range(level - 1, 0, -1):  # `at` and `last` are names of this level: the phrase without its last word, and the part that ends with that word
        for down in range(depth - 1, 0, -1):
            up = levels[down].select(F.col("id").alias("last"), F.col("right").alias("end"))
            d = d.join(up, "last").drop("last").withColumnRenamed("end", "last")
        one = levels[0].select(F.col("id").alias("last"), "word")
        d = d.join(one, "last").withColumn("words", F.concat(F.array("word"), "words")).drop("last", "word")
        if depth > 1:
            up = levels[depth - 1].select(F.col("id").alias("at"), F.col("left").alias("before"), F.col("right").alias("last"))
            d = d.join(up, "at").drop("at").withColumnRenamed("before", "at")
    first = levels[0].select(F.col("id").alias("at"), "word")
    return d.join(first, "at").withColumn("words", F.concat(F.array("word"), "words")).drop("at", "word")


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, inside: int = 50, best: int = 2000, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `best` phrases of 2 to `most_words` words of each language.

    `docs` has text and lang; further columns, of any name, are ignored. A-Z are lower-cased; pieces end at `.,;:!?` and line ends, words at
    blanks and tabs. a is a phrase's count within pieces (overlaps included), at least `least`; l and r are the counts of its parts at the cut
    with the lowest score (of equal ones the first), score = floor(1000000 a a / (l r)) in decimals of 38 digits; n are all words of the
    language. A phrase goes if a longer one that holds it has at least `inside` per cent of its count. (The longer one by a single word decides: a phrase inside
    a still longer one is inside that, too, which is as frequent.) Order: score and a descending, phrase ascending by bytes.

    Phrases are scored by names and counts alone. Only those that can be among the best (their score and count are not below those of the `best`-th) get
    their words, which then settle ties.

    A null lang is `und`, a null text empty; repeated rows count each time; very long texts are counted whole, piece by piece over as many blocks as
    needed; languages without such a phrase, and empty tables, give no rows.
    """
    total, levels = phrase_names(docs, most_words, least, block_words)
    scored = []
    for level, phrases in enumerate(_counts(levels), start=2):
        if level < most_words:
            up = levels[level]
            longest = up.select(F.col("left").alias("id"), "f").union(up.select(F.col("right").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("longer"))
            phrases = phrases.join(longest, "id", "left").where(F.col("longer").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("longer") < F.lit(inside) * F.col("f")))
        cut = f"struct(cast(1000000 as decimal(38,0)) * f * f div (cast(heads[k - 1] as decimal(19,0)) * tails[{level} - k - 1]) as score, k, heads[k - 1] as l, tails[{level} - k - 1] as r)"
        worst = F.array_min(F.expr(f"transform(sequence(1, {level} - 1), k -> {cut})")).alias("cut")
        scored.append(phrases.select(F.lit(level).alias("level"), "left", "right", "lang", F.col("f").alias("a"), worst).select("level", "left", "right", "lang", "a", "cut.l", "cut.r", "cut.score"))
    found = materialize(reduce(DataFrame.union, scored), "scored")
    # the `best`-th score and count of each language, ties counted together: one row for each different pair of them meets in a language's window
    steps = found.groupBy("lang", "score", "a").agg(F.count("*").alias("n"))
    near = Window.partitionBy("lang", F.pmod(F.hash("score", "a"), F.lit(BUCKETS))).orderBy(F.desc("score"), F.desc("a"))
    steps = steps.withColumn("before", F.sum("n").over(near.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).where(F.col("before") < best)
    steps = steps.withColumn("before", F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    last = steps.where(F.col("before") < best).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("last"))
    found = materialize(found.join(last, "lang").where(F.struct("score", "a") >= F.col("last")).drop("last"), "chosen")
    parts = [_with_words(found.where(F.col("level") == level), levels, level) for level in range(2, most_words + 1)]
    found = reduce(DataFrame.union, [p.select("lang", F.array_join("words", " ").alias("phrase"), "a", "l", "r", "score") for p in parts])
    order = (F.desc("score"), F.desc("a"), "phrase")
    near = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= best).drop("rank")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= best)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
