"""Interleaving of sources to target weights by Pfair scheduling.

Each source is cut into blocks of `block_rows` rows in doc_id order. With integer weights e(s) that sum to the cycle Q,
block j of source s may not run before floor(j * Q / e(s)) and must run before ceil((j + 1) * Q / e(s)); in every slot the
released block with the earliest deadline runs (ties: the source's name). All weights together fill every slot, so each
block meets its window, and after t slots a source has run less than one block more or less than t * e(s) / Q.

The pattern of one cycle depends on the weights alone (Q rows, at most `MOST_SLOTS`); block j of a source has the slot of block j mod e(s), moved by
j div e(s) cycles. When a source has no blocks left its slots are left out; the others go on in their own proportion,
and every row is kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence
from functools import reduce
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import ranked
from .scratch import materialize

BLOCK_ROWS = 16
#: Target weights: a source that is not listed has weight 1.
WEIGHTS = {"src0": 4, "src1": 2, "src2": 2}
#: Bound of the plan: slots of one cycle, which are at least as many as the sources. A cycle of at most `SENT_SLOTS` is sent to all tasks.
MOST_SLOTS, SENT_SLOTS = 1_000_000, 20_000


def pattern(weights: Mapping[str, int]) -> list[str]:
    """The source that runs in each slot of one cycle."""
    q = sum(weights.values())
    waiting = [(0, s, 0) for s in weights if weights[s] > 0]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []  # deadline, source, block
    out = []
    for t in range(q):
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * q // weights[s]), s, j))
        _, s, j = heapq.heappop(ready)
        out.append(s)
        if j + 1 < weights[s]:
            heapq.heappush(waiting, ((j + 1) * q // weights[s], s, j + 1))
    return out


def mix_sources(docs: DataFrame, weights: Mapping[str, int] | None = None, block_rows: int = BLOCK_ROWS, default: int = 1, order: Sequence[str] = ()) -> DataFrame:
    """`docs` with `mix_source`, `mix_slot` (cycle slot of the row's block, with gaps) and `mix_position` (0, 1, 2, ... over all rows).

    `docs` needs doc_id and source; further columns, of any name, are passed through, those of the three names are replaced. A null
    source is a source of its own, named ''. Rows with equal source and doc_id are ordered by the columns of `order`, by default by their text's CRC-32 if
    there is a text, else freely. Weights are positive whole numbers. An empty table gives no rows. The driver holds the names of the sources and one
    row for each slot of a cycle (the sum of the weights over their greatest common divisor); above `MOST_SLOTS` it raises ValueError.
    """
    weights = dict(WEIGHTS if weights is None else weights)
    if min([default, *weights.values()]) < 1:
        raise ValueError("weights are positive whole numbers")
    spark, own = docs.sparkSession, ("mix_source", "mix_slot", "mix_position")
    tie = [F.col(c) for c in order] or [F.crc32(F.coalesce("text", F.lit("")).cast("binary"))] * ("text" in docs.columns)
    d = materialize(ranked(docs, [F.col("doc_id"), *tie], F.lit(0), F.coalesce("source", F.lit(""))).drop("before_size"), "ranked")
    found = [r["group"] for r in d.select("group").distinct().limit(MOST_SLOTS + 1).collect()]
    use = {s: weights.get(s, default) for s in found}
    part = reduce(gcd, use.values(), 0) or 1
    use = {s: e // part for s, e in use.items()}
    slots = sum(use.values())
    if slots > MOST_SLOTS:
        raise ValueError(f"a cycle of {slots} slots for {len(use)} sources; at most {MOST_SLOTS} are planned")
    seen = dict.fromkeys(use, 0)
    rows = []
    for t, s in enumerate(pattern(use)):
        rows.append((s, seen[s], t, use[s]))
        seen[s] += 1
    plan = spark.createDataFrame(rows, "source string, turn bigint, slot bigint, weight bigint")
    share = plan.groupBy("source").agg(F.max("weight").alias("weight"))
    if slots <= SENT_SLOTS:
        plan, share = F.broadcast(plan.drop("weight")), F.broadcast(share)
    else:
        plan = plan.drop("weight")
    block = F.expr(f"before_rows div {block_rows}")
    d = d.join(share, d["group"] == share["source"]).drop("source").select("*", F.floor(block / F.col("weight")).cast("bigint").alias("cycle"), (block % F.col("weight")).alias("at"))
    placed = d.join(plan, (d["group"] == plan["source"]) & (d["at"] == plan["turn"])).withColumn("mix_slot", F.col("cycle") * slots + F.col("slot"))
    out = ranked(placed.select("row", "group", "mix_slot", "before_rows"), [F.col("mix_slot"), F.col("before_rows")], F.lit(0))
    kept = [F.col(f"row.row.`{c.replace('`', '``')}`").alias(c) for c in docs.columns if c not in own]
    return out.select(*kept, F.col("row.group").alias("mix_source"), "row.mix_slot", F.col("before_rows").alias("mix_position"))


def in_mix_order(docs: DataFrame, **options) -> DataFrame:
    """`docs`, its rows stored in mix order: partitions are ranges of the mix position and sorted by it.

    Only doc_id, source and a CRC-32 are scheduled; texts move twice, to meet their position and to be sorted. Written as files,
    the order is that of part numbers and of the rows inside them. Columns may have any name; null ids, sources and texts and repeated rows
    are kept; an empty table gives no rows.
    """
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    key = ["doc_id", "source", "crc"]
    at = mix_sources(docs.select("doc_id", "source", crc.alias("crc")), order=["crc"], **options).groupBy(*key).agg(F.min("mix_position").alias("at"))
    at = materialize(at, "positions")
    d = docs.select(F.struct("*").alias("row"), crc.alias("row_crc"))
    same = d["row_crc"].eqNullSafe(at["crc"]) & F.col("row.doc_id").eqNullSafe(at["doc_id"]) & F.col("row.source").eqNullSafe(at["source"])
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return d.join(at, same).select("row", "at").repartitionByRange(n, "at").sortWithinPartitions("at").select("row.*")
