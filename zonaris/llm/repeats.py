"""Removal of long byte strings that occur more than once, by prefix-free parsing.

Each text is parsed at rolling-hash triggers: in every run of `length` bytes, the position where the hash of the next
`core` bytes is least (the leftmost of equals). A trigger depends on those bytes alone, so two equal strings of `length`
bytes have it at the same place. All strings that share a trigger form one phrase, `lo` to `hi + length`; phrases
overlap, so no string lies across a border, which is what makes the parse prefix-free. The dictionary is the set of
distinct phrases, the parse their sequence; only they are shuffled, about one for 76 bytes.

Full suffix order is not needed to find strings of one given length: what counts is which dictionary suffixes agree on
their first `length` bytes. So the ranks of suffix arrays are replaced by hash classes, refined step by step:

1. A core that occurs once has only unique strings.
2. A phrase that occurs twice has only repeated ones; a phrase that occurs once and whose core is shared is torn.
3. Torn phrases (and one copy of the others of their core) are cut into blocks of `BLOCK` starts, aligned to the trigger. The bytes common to
   all strings of a block are its inner part: if it occurs once, all strings are unique. All bytes of a block are its
   outer part: if it occurs twice, all strings are repeated.
4. What is left, blocks with a shared inner and different outer parts, is compared string by string, one copy of each.

Classes are at least 128 bits (core with phrase, inner with outer, core with string; 64 bits each, modulo 2**64).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize
from .textkit import _VALUE, mix, powers

LENGTH, CORE, BLOCK = 200, 50, 16
PART = 1 << 19  # bytes of a text parsed at once
_U = np.uint64


def phrases(raw: bytes, length: int, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(core hash, phrase hash, place) of the phrases of a text; a long text is parsed in parts, which cuts phrases at
    the borders of parts but loses no string."""
    out = []
    for at in range(0, max(1, len(raw) - length + 1), PART):
        part = raw[at : at + PART + length - 1]
        if len(part) >= length:
            f, c, lo, q, hi = _phrases(part, length, core)
            out.append((f, c, _pack(lo + at, q + at, hi + at)))
    if not out:
        z = np.zeros(0, _U)
        return z, z, np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _prefix(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(raw, np.uint8)
    up, down = powers(len(b) + 1)
    return np.concatenate((np.zeros(1, _U), np.cumsum(_VALUE[b] * up[: len(b)], dtype=_U))), down


def _phrases(raw: bytes, length: int, core: int):
    n, span = len(raw), length - core + 1
    s, down = _prefix(raw)
    h = mix((s[core:] - s[:-core]) * down[: n - core + 1])
    rows = -(-len(h) // span)
    bits = max(1, (span - 1).bit_length())
    key = np.full(rows * span, np.iinfo(np.uint64).max, _U)
    key[: len(h)] = h >> _U(bits) << _U(bits)
    key = key.reshape(rows, span) | np.arange(span, dtype=_U)
    before = np.minimum.accumulate(key, axis=1).ravel()
    after = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    p = np.arange(n - length + 1)
    a, b = after[p], before[p + span - 1]
    left = a >> _U(bits) <= b >> _U(bits)
    low = _U((1 << bits) - 1)
    q = np.where(left, p // span * span + (a & low).astype(np.int64), (p + span - 1) // span * span + (b & low).astype(np.int64))
    lo = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
    hi = np.append(lo[1:], len(q)) - 1
    q = q[lo]
    whole = mix((s[hi + length] - s[lo]) * down[lo] + mix((q - lo) * 65536 + (hi - lo)))
    return h[q], whole, lo, q, hi


def _pack(lo: np.ndarray, q: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return lo << 20 | (q - lo) << 10 | (hi - lo)


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo = at >> 20
    return lo, lo + (at >> 10 & 1023), lo + (at & 1023)


def _hashes(raw: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of substrings of a text, `start` ascending; long texts one part at a time."""
    out = np.empty(len(start), _U)
    most = int(size.max()) if len(size) else 0
    for at in range(0, len(raw), PART):
        here = slice(*np.searchsorted(start, (at, at + PART)))
        if here.start < here.stop:
            s, down = _prefix(raw[at : at + PART + most])
            x = start[here] - at
            out[here] = (s[x + size[here]] - s[x]) * down[x] + size[here].astype(_U)
    return mix(out)


def _mapped(work, *names: str, most: int = 50_000):
    """A mapInArrow function: `work` gives (row, columns) for texts of a batch; rows go out about `most` at a time."""

    def rows(batch: pa.RecordBatch, held: list) -> pa.RecordBatch:
        row = pa.array(np.repeat([r for r, _ in held], [len(c[0]) for _, c in held]))
        cols = [pa.array(np.concatenate(x)) for x in zip(*(c for _, c in held), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("node").take(row), *cols], names=["doc_id", "node", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            for row, cols in work(batch):
                if len(cols[0]):
                    held.append((row, cols))
                    n += len(cols[0])
                if n >= most:
                    yield rows(batch, held)
                    held, n = [], 0
            if held:
                yield rows(batch, held)

    return run


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for x in batch.column("text").cast(pa.binary()):
        yield x.as_py() or b""


def _listed(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[np.ndarray]]]:
    """Row, bytes, and the columns of the row's list in order of the first; a null list is empty."""
    lists = batch.column("rows")
    ends, cols = lists.offsets.to_numpy(), [c.to_numpy(zero_copy_only=False) for c in lists.values.flatten()]
    for row, raw in enumerate(_texts(batch)):
        part = [c[ends[row] : ends[row + 1]] for c in cols]
        order = np.argsort(part[0], kind="stable")
        yield row, raw, [c[order] for c in part]


def _parsed(length: int, core: int):
    def work(batch: pa.RecordBatch):
        for row, raw in enumerate(_texts(batch)):
            f, c, at = phrases(raw, length, core)
            yield row, (f.view(np.int64), c.view(np.int64), at)

    return _mapped(work, "core", "phrase", "at")


def _blocks(length: int, step: int = 10_000):
    """Blocks of the listed phrases (at, core), `step` phrases at once: inner and outer hash, the starts `at` to `at + n - 1`."""

    def blocks(raw: bytes, at: np.ndarray, core: np.ndarray):
        lo, q, hi = _unpack(at)
        first, last = (lo - q) // BLOCK, (hi - q) // BLOCK
        n = last - first + 1
        i = np.repeat(np.arange(len(lo)), n)
        k = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin = q[i] + k * BLOCK
        a, b = np.maximum(begin, lo[i]), np.minimum(begin + BLOCK - 1, hi[i])
        order = np.argsort(begin, kind="stable")
        i, k, begin, a, b = i[order], k[order], begin[order], a[order], b[order]
        inner = _hashes(raw, begin + BLOCK - 1, np.full(len(begin), length - BLOCK + 1))
        again = np.argsort(a, kind="stable")
        outer = np.empty(len(a), _U)
        outer[again] = _hashes(raw, a[again], (b - a + length)[again])
        inner = mix(inner ^ core[i].view(_U) ^ mix(k.view(_U)))
        outer = mix(outer ^ mix((a - begin) * BLOCK + b - begin))
        return inner.view(np.int64), outer.view(np.int64), a, b - a + 1

    def work(batch: pa.RecordBatch):
        for row, raw, (at, core) in _listed(batch):
            for x in range(0, len(at), step):
                yield row, blocks(raw, at[x : x + step], core[x : x + step])

    return _mapped(work, "inner", "outer", "at", "n")


def _strings(length: int, step: int = 10_000):
    """The strings of the listed blocks (at, n, inner), `step` blocks at once: inner, string, and where it starts."""

    def strings(raw: bytes, at: np.ndarray, n: np.ndarray, inner: np.ndarray):
        p = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        order = np.argsort(p, kind="stable")
        p, inner = p[order], np.repeat(inner, n)[order]
        return inner, _hashes(raw, p, np.full(len(p), length)).view(np.int64), p

    def work(batch: pa.RecordBatch):
        for row, raw, (at, n, inner) in _listed(batch):
            for x in range(0, len(at), step):
                yield row, strings(raw, at[x : x + step], n[x : x + step], inner[x : x + step])

    return _mapped(work, "inner", "string", "at")


def cover(lo: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans, `lo` ascending, as disjoint spans that do not touch."""
    if not len(lo):
        return lo, to
    reach = np.maximum.accumulate(to)
    first = np.flatnonzero(np.concatenate(([True], lo[1:] > reach[:-1])))
    return lo[first], reach[np.append(first[1:], len(lo)) - 1]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of it: texts that share a doc_id are told apart."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("node"))


def _with_lists(d: DataFrame, rows: DataFrame, *cols: str) -> DataFrame:
    """The texts of `d` that have `rows` (doc_id, node, cols), once each, with a list of them (no more than the text has bytes)."""
    lists = rows.groupBy("doc_id", "node").agg(F.collect_list(F.struct(*cols)).alias("rows")).withColumnsRenamed({"doc_id": "_d", "node": "_n"})
    return d.join(lists, d["doc_id"].eqNullSafe(F.col("_d")) & (d["node"] == F.col("_n"))).select("doc_id", "node", "text", "rows")


def _classes(rows: DataFrame, outer: str, inner: str, *place: str) -> DataFrame:
    """For each class (inner, outer) of an inner class with several rows: n rows, the place of any one of them, and
    whether the inner class is torn into several outer ones."""
    whole = rows.groupBy(inner, outer).agg(F.count("*").alias("rows"), *(F.first(c).alias(c) for c in ("doc_id", "node", *place)))
    shared = whole.groupBy(inner).agg(F.sum("rows").alias("all"), F.count("*").alias("kinds")).where("all > 1").select(inner, (F.col("kinds") > 1).alias("torn"))
    return materialize(whole.join(shared, inner), "classes")


def repeated_spans(docs: DataFrame, length: int = LENGTH, core: int = CORE) -> DataFrame:
    """(doc_id, node, rows): for each text that has any, the byte spans covered by repeated strings."""
    d = _keyed(docs)
    kind = d.schema["doc_id"].dataType.simpleString()
    parse = d.where(F.octet_length("text") >= length).mapInArrow(_parsed(length, core), f"doc_id {kind}, node bigint, core bigint, phrase bigint, at bigint")
    parse = materialize(parse, "parse")
    phrase = _classes(parse, "phrase", "core", "at")
    lo = F.expr("shiftright(at, 20)")
    span = ("doc_id", "node", lo.alias("lo"), (lo + F.expr("at & 1023") + length).alias("to"))
    whole = materialize(parse.join(phrase.where("rows > 1").select("core", "phrase"), ["core", "phrase"]).select(*span), "whole")
    discard(parse)

    torn = phrase.where("torn").select("core", "doc_id", "node", "at")
    blocks = _with_lists(d, torn, "at", "core").mapInArrow(_blocks(length), f"doc_id {kind}, node bigint, inner bigint, outer bigint, at bigint, n bigint")
    blocks = materialize(blocks, "blocks")
    block = _classes(blocks, "outer", "inner", "at", "n")
    part = blocks.join(block.where("rows > 1").select("inner", "outer"), ["inner", "outer"]).select("doc_id", "node", F.col("at").alias("lo"), (F.col("at") + F.col("n") - 1 + length).alias("to"))
    part = materialize(part, "part")
    discard(blocks)

    mixed = block.where("torn").select("inner", "doc_id", "node", "at", "n")
    strings = _with_lists(d, mixed, "at", "n", "inner").mapInArrow(_strings(length), f"doc_id {kind}, node bigint, inner bigint, string bigint, at bigint")
    strings = materialize(strings, "strings")
    twice = strings.groupBy("inner", "string").agg(F.count("*").alias("n")).where("n > 1").select("inner", "string")
    single = strings.join(twice, ["inner", "string"]).select("doc_id", "node", F.col("at").alias("lo"), (F.col("at") + length).alias("to"))
    return whole.unionByName(part).unionByName(single).groupBy("doc_id", "node").agg(F.collect_set(F.struct("lo", "to")).alias("rows"))


def _cut(batches: Iterator[pa.RecordBatch], most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def rows(ids: pa.Array, held: list) -> pa.RecordBatch:
        size, gone, a, b, kept = zip(*held, strict=True)
        ends = np.concatenate(([0], np.cumsum([len(x) for x in a])))
        spans = pa.StructArray.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], fields=list(span))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)
        return pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(gone, pa.int64()), lists, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    for batch in batches:
        held, n, at = [], 0, 0
        for row, raw, (lo, to) in _listed(batch):
            a, b = cover(lo, to)
            keep = zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True)
            held.append((len(raw), int((b - a).sum()), a, b, b"".join(raw[x:y] for x, y in keep)))
            n += len(raw)
            if n >= most:
                yield rows(batch.column("doc_id").slice(at, len(held)), held)
                held, n, at = [], 0, row + 1
        if held:
            yield rows(batch.column("doc_id").slice(at, len(held)), held)


def remove_repeats(docs: DataFrame, length: int = LENGTH, core: int = CORE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) for each row of `docs` (doc_id, text; further columns are ignored).

    A byte goes when a string of `length` bytes that covers it also starts at another place of any text, the same text
    included. Strings are judged on the input and never cross texts. `spans` are the removed runs as byte offsets, `kept`
    the remaining bytes, which may cut a character. A null text is empty; texts shorter than `length` are untouched; a
    repeated row is a repetition like any other; null doc_ids are kept; an empty table gives no rows.
    """
    d = _keyed(docs)
    kind = d.schema["doc_id"].dataType.simpleString()
    spans = materialize(repeated_spans(docs, length, core), "spans").withColumnsRenamed({"doc_id": "_d", "node": "_n"})
    joined = d.join(spans, d["doc_id"].eqNullSafe(F.col("_d")) & (d["node"] == F.col("_n")), "left").select("doc_id", "text", "rows")
    return joined.mapInArrow(_cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
