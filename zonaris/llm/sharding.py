"""Contiguous shards of nearly equal bytes, from global prefix sums of sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import ranked
from .scratch import materialize

SHARDS, ROW_BYTES = 24, 8


def row_size() -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + ROW_BYTES


def shard_rows(rows: DataFrame, order: Sequence[Column], size: Column, shards: int = SHARDS) -> DataFrame:
    """(row, shard, slot): the columns of `rows` as one struct, and where the row goes.

    `size` is a bigint of at least 1. The row whose first byte is byte b of a total of T goes to shard b * shards // T, so
    shards are runs of the order and differ from T / shards by less than the largest row. `slot` numbers a shard's rows
    from 0 without gaps. Fewer bytes than shards leave shards empty; an empty table gives no rows. Rows equal in `order` are
    interchangeable. Names of `rows` may be any.
    """
    sized = rows.select(F.struct("*").alias("row"), size.alias("size"), *(c.alias(f"o{i}") for i, c in enumerate(order)))
    placed = ranked(sized, [F.col(f"o{i}") for i in range(len(order))], F.col("size"))
    at = materialize(placed.select("row.row", "row.size", "before_rows", "before_size"), "placed")
    total = at.agg(F.max(F.col("before_size") + F.col("size"))).first()[0] or 1
    cut = at.withColumn("shard", F.expr(f"cast((cast(before_size as decimal(30,0)) * {shards}) div {total} as int)"))
    first = cut.groupBy("shard").agg(F.min("before_rows").alias("first"))  # as many rows as shards
    return cut.join(F.broadcast(first), "shard").select("row", "shard", (F.col("before_rows") - F.col("first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, order: Sequence[Column] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of `docs`; further columns are ignored.

    `order` are columns of `docs`, ascending with nulls first. The default order is doc_id, then the text's CRC-32, so the
    result does not depend on how rows are stored. A null text has no bytes (its size is 8 and its CRC-32 is 0); repeated rows
    are placed one after the other. The law is `bytes`, so grown_shard is null. An empty table gives no rows.
    """
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    order = order or [F.col("doc_id"), crc]
    d = docs.select("doc_id", row_size().alias("size"), crc.alias("text_crc32"), *(c.alias(f"o{i}") for i, c in enumerate(order)))
    out = shard_rows(d, [F.col(f"o{i}") for i in range(len(order))], F.col("size"), shards)
    return out.select("row.doc_id", "row.size", "row.text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
