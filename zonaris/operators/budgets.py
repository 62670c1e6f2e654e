"""Budgets that refuse: reservations are admitted in order, and what no longer fits is turned away."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 10_000  # amounts are whole ten-thousandths


class Budget:
    """What is spent and held of one budget. A reservation is held until it is settled, released, or its time is over."""

    def __init__(self, limit: int):
        self.limit, self.spent, self.held = limit, 0, 0
        self.open: dict[str, tuple[int, int]] = {}  # amount and end
        self.ends: list[tuple[int, str]] = []

    def take(self, at: int, kind: str, ref: str, amount: int, ttl: int) -> str:
        while self.ends and self.ends[0][0] <= at:
            end, gone = heapq.heappop(self.ends)
            if self.open.get(gone, (0, None))[1] == end:  # not settled meanwhile, nor reserved anew
                self.held -= self.open.pop(gone)[0]
        if kind == "reserve":
            if ref in self.open:
                return "already_reserved"
            if amount < 0 or self.spent + self.held + amount > self.limit:
                return "refused"
            self.open[ref] = amount, at + ttl
            self.held += amount
            heapq.heappush(self.ends, (at + ttl, ref))
            return "admitted"
        known = ref in self.open
        if kind not in ("settle", "release"):
            return "unknown_kind"
        self.held -= self.open.pop(ref, (0, 0))[0]
        if kind == "release":
            return "released" if known else "nothing_reserved"
        self.spent += max(0, amount)  # what was used is charged, even if it came late or cost more
        return "settled" if known else "settled_late"


def admitted(entries: DataFrame, budgets: DataFrame, ttl: int) -> DataFrame:
    """(budget, entry, outcome, spent, held): each entry judged in order of its time and id; spent and held are those after it.

    `entries` has budget, entry (unique id), at (whole seconds), kind (`reserve`, `settle`, `release`), ref (the reservation) and amount; `budgets` has budget and amount_limit (at
    most four digits after the point count). A reservation that does not fit is `refused`, and later ones are still judged; after `ttl` seconds it is freed. An entry that
    comes again (same id) is taken once, so replays change nothing. A budget without a limit has 0; a null amount is 0.

    Admission depends on all that came before, so a budget's entries are judged one after another by one task, as a sorted stream: what is in memory are the open
    reservations of one budget, not its entries.
    """
    once = entries.groupBy("budget", "entry").agg(F.min(F.struct("at", "kind", "ref", "amount")).alias("e")).select("budget", "entry", "e.*")
    units = lambda c: F.coalesce(F.round(F.col(c).cast("decimal(30,4)") * UNIT).cast("decimal(38,0)"), F.lit(0))
    limits = budgets.groupBy("budget").agg(F.max("amount_limit").alias("amount_limit")).withColumnRenamed("budget", "l_budget")
    d = once.join(limits, F.col("budget").eqNullSafe(F.col("l_budget")), "left").select("budget", "entry", F.col("at").cast("bigint"), "kind", "ref", units("amount").cast("bigint").alias("amount"), units("amount_limit").cast("bigint").alias("amount_limit"))
    kinds = {c: d.schema[c].dataType.simpleString() for c in ("budget", "entry")}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = object(), None
        for batch in batches:
            out = []
            for r in batch.select(["budget", "at", "kind", "ref", "amount", "amount_limit"]).to_pylist():
                if state is None or r["budget"] != name:
                    name, state = r["budget"], Budget(r["amount_limit"])
                out.append((state.take(r["at"] or 0, r["kind"], r["ref"], r["amount"], ttl), state.spent, state.held))
            outcome, spent, held = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("budget"), batch.column("entry"), pa.array(outcome, pa.string()), pa.array(spent, pa.int64()), pa.array(held, pa.int64())], names=["budget", "entry", "outcome", "spent", "held"])

    judged = d.repartition("budget").sortWithinPartitions("budget", "at", "entry").mapInArrow(judge, f"budget {kinds['budget']}, entry {kinds['entry']}, outcome string, spent bigint, held bigint")
    money = lambda c: (F.col(c).cast("decimal(20,0)") / UNIT).cast("decimal(20,4)").alias(c)
    return judged.select("budget", "entry", "outcome", money("spent"), money("held"))
