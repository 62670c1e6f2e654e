"""Fill-in-the-middle: texts cut at two places and told as prefix, suffix and middle.

Cuts are counted in code points, texts are bytes. While the code points of a text are counted, a sparse index keeps the
byte and code-point offset of a checkpoint every `UNIT` bytes. A cut is found by binary search among the checkpoints and a scan
of the one unit after it, so no table of all offsets is made.

Two hashes of the document's id give the cuts, a third tells whether the text stays plain, a fourth the order of the parts.
The parts are marked by sentinels, and a text that holds a sentinel stays plain, so `restore` gets the text back from the
output and its form alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .arrow import BATCH_BYTES, sizes_of
from .textkit import chunks

UNIT = 4096  # bytes from one checkpoint to the next
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100: ids that stay plain, and of the others those with the suffix first
#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class Checkpoints:
    """Byte and code-point offsets of a UTF-8 text at every `unit` bytes."""

    def __init__(self, raw: bytes, unit: int = UNIT):
        self.raw = np.frombuffer(raw, np.uint8)
        self.at = np.arange(0, len(raw) + unit, unit)
        firsts = [int(np.count_nonzero(self.raw[i : i + unit] & 0xC0 != 0x80)) for i in self.at[:-1]]
        self.before = np.concatenate(([0], np.cumsum(firsts, dtype=np.int64)))  # code points that begin before each checkpoint
        self.unit, self.n = unit, int(self.before[-1])

    def byte_of(self, point: int) -> int:
        """Byte at which code point `point` begins; that of the end for `n`."""
        if point >= self.n:
            return len(self.raw)
        k = int(np.searchsorted(self.before, point, "right")) - 1
        scan = np.flatnonzero(self.raw[self.at[k] : self.at[k] + self.unit] & 0xC0 != 0x80)
        return int(self.at[k] + scan[point - self.before[k]])


def infill(raw: bytes, h1: int, h2: int, plain: bool, spm: bool, unit: int = UNIT) -> tuple[int, str, int | None, int | None, bytes]:
    """(code points, form, code points of prefix and middle, output) of one text."""
    index = Checkpoints(raw, unit)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if plain or not raw or p in raw or s in raw or m in raw:
        return index.n, "plain", None, None, raw
    first, last = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    i, j = index.byte_of(first), index.byte_of(last)
    parts = (s, raw[j:], p, raw[:i], m, raw[i:j]) if spm else (p, raw[:i], s, raw[j:], m, raw[i:j])
    return index.n, "spm" if spm else "psm", first, last - first, b"".join(parts)


def _hash(k: int) -> Column:
    """The k-th group of 8 hexadecimal digits of the id's hash as a number; a null id is hashed as the empty string."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("bigint")


_MADE = T.StructType([T.StructField(n, k) for n, k in (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.BinaryType()))])


@F.arrow_udf(_MADE)
def _infill(text: pa.Array, h1: pa.Array, h2: pa.Array, plain: pa.Array, spm: pa.Array) -> pa.Array:
    out = []
    for s in chunks(sizes_of(text), BATCH_BYTES):
        rows = zip(*(x[s].to_pylist() for x in (text, h1, h2, plain, spm)), strict=True)
        made = [dict(zip(_MADE.names, infill(t or b"", *rest), strict=True)) for t, *rest in rows]
        out.append(pa.array(made, to_arrow_type(_MADE)))
    return pa.concat_arrays(out) if out else pa.array([], to_arrow_type(_MADE))


def fill_in_middle(docs: DataFrame, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of `docs` (doc_id, text; further columns, of any name, are ignored).

    form is plain (output is the text), psm (prefix, suffix, middle) or spm (suffix, prefix, middle); prefix_chars and middle_chars are code
    points, null for plain. A null text is empty, and an empty one plain; whole texts are cut, however long, in one pass with one number for
    each `UNIT` bytes. Rows that share a doc_id are cut at places drawn from the same hash; a null doc_id is hashed as an empty string and stays
    null. An empty table gives no rows. Nothing is shuffled, and doc_id never enters Python.
    """
    text = F.col("text").cast("binary")
    made = docs.select("doc_id", _infill(text, _hash(1), _hash(2), _hash(3) % 100 >= plain_from, _hash(4) % 100 < spm_below).alias("made"))
    return made.select("doc_id", *(f"made.{c}" for c in ("n", "form", "prefix_chars", "middle_chars")), F.col("made.output").cast("string").alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text from an output and its form, in the JVM: no part holds a sentinel, so the first ones are the marks."""
    parts = F.split(F.substring(output, 4, 2**31 - 1), f"{PREFIX}|{SUFFIX}|{MIDDLE}", 3)
    psm = F.concat(parts[0], parts[2], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", F.concat(parts[1], parts[2], parts[0])).otherwise(output)
