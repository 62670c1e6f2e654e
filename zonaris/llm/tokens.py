"""Token counts by batch encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import text_function
from .textkit import chunks

BATCH_BYTES, PIECE_CHARS = 1 << 20, 1 << 16
_loaded: dict[tuple, object] = {}


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about `most` characters, cut only before white space that follows something else.

    Byte-level BPE here never joins white space to what stands before it and looks ahead only from inside white space, so the pieces'
    tokens are the text's. A text without such a place stays whole.
    """
    at = 0
    while len(text) - at > most:
        cut = at + most
        while cut < len(text) and not (text[cut].isspace() and not text[cut - 1].isspace()):
            cut += 1
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


def byte_bpe(ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...]):
    """An encoder for a file of base64 ranks; loaded once for each worker."""
    key = (ranks_path, pattern, special)
    if key not in _loaded:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[key] = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))
    return _loaded[key]


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...] = (), limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of `docs` (doc_id, text; further columns are ignored).

    `ranks_path` is a file of `base64-token rank` lines, `pattern` its pre-tokeniser, `special` the strings that are one
    token wherever they stand in a text. A null text is empty and has 0 tokens; nothing is truncated or padded. Texts are encoded in
    batches of about `BATCH_BYTES` UTF-8 bytes, long ones in pieces, so a worker holds one batch's tokens at a time. Repeated rows and null doc_ids are kept; an
    empty table gives no rows.
    """
    names = {s for s, _ in special}

    def work(texts: list[str | None]) -> pa.Array:
        enc = byte_bpe(ranks_path, pattern, special)
        n = np.zeros(len(texts), np.int64)
        parts = [(i, p) for i, t in enumerate(texts) for p in pieces(t or "")]
        for s in chunks([len(p.encode("utf-8", "surrogatepass")) for _, p in parts], BATCH_BYTES):
            coded = enc.encode_batch([p for _, p in parts[s]], num_threads=1, allowed_special=names, disallowed_special=())
            np.add.at(n, [i for i, _ in parts[s]], [len(x) for x in coded])
        return pa.array(n)

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    out = docs.select("doc_id", n_bytes.alias("n_bytes"), text_function(work, "bigint", BATCH_BYTES)("text").alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
