"""Tables with state: conditional upserts, clones, scoped packages, entries that open, close and roll back.

Tables are Spark tables without in-place change: every operation returns the new content.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_where(base: DataFrame, updates: DataFrame, key: str, replace: Column) -> DataFrame:
    """`base` with the updates; a row that is there already gives way only where `replace` (of its own columns) holds. One update a key."""
    new = updates.withColumnsRenamed({c: f"n_{c}" for c in updates.columns})
    d = base.withColumn("there", F.lit(True)).join(new, F.col(key) == F.col(f"n_{key}"), "full")
    take = F.col(f"n_{key}").isNotNull() & (F.col("there").isNull() | F.coalesce(replace, F.lit(True)))
    return d.select(*(F.when(take, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in base.columns))


def replayed(base: DataFrame, updates: DataFrame, key: str, version: str, content: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(table, log) after late or repeated input: an older version never replaces a newer one, equal content changes nothing.

    Of several updates of a key the newest counts, ties by content hash. The log has (key, action): inserted, updated, unchanged, stale.
    """
    h = lambda cols: F.sha2(F.to_json(F.struct(*cols)), 256)
    up = updates.withColumn("h", h(content))
    rest = [c for c in base.columns if c != key]
    newest = up.groupBy(key).agg(F.max(F.struct(version, "h", *(c for c in rest if c != version))).alias("n"))
    d = base.withColumns({"there": F.lit(True), "old_h": h(content)}).join(newest, key, "full")
    action = (
        F.when(F.col("n").isNull(), None).when(F.col("there").isNull(), "inserted").when(F.col(f"n.{version}") < F.col(version), "stale")
        .when(F.col("n.h") == F.col("old_h"), "unchanged").otherwise("updated")
    )
    d = d.withColumn("action", action)
    take = F.col("action").isin("inserted", "updated")
    table = d.select(key, *(F.when(take, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in rest))
    return table.select(*base.columns), d.where("action is not null").select(key, "action")


def cloned(rows: DataFrame, key: str, release: str, source: int, target: int) -> DataFrame:
    """`rows` and a copy of one release under another number, its keys derived from the old ones."""
    copy = rows.where(F.col(release) == source).withColumn(release, F.lit(target).cast(rows.schema[release].dataType)).withColumn(key, F.xxhash64(F.lit(target), key))
    return rows.unionByName(copy)


def packages_applied(base: DataFrame, packages: DataFrame, key: str, scope: str, number: str, action: str) -> DataFrame:
    """`base` after incremental packages in the order of `number`.

    `packages` has base's columns, `number` and `action`: `put` sets a row, `drop` deletes it, `clear` deletes its whole scope before the
    other rows of the same package are put. One pass: a row counts if no later drop of its key and no clear of its scope at or after it
    (a put of the clearing package stays) overrides it, and the latest put of a key wins.
    """
    first = base.select("*", F.lit(-1).cast("bigint").alias("at"))
    puts = first.unionByName(packages.where(F.col(action) == "put").select(*base.columns, F.col(number).cast("bigint").alias("at")))
    last = puts.groupBy(key).agg(F.max_by(F.struct(*base.columns), "at").alias("row"), F.max("at").alias("at"))
    dropped = packages.where(F.col(action) == "drop").groupBy(F.col(key).alias("d_key")).agg(F.max(F.col(number).cast("bigint")).alias("dropped"))
    cleared = packages.where(F.col(action) == "clear").groupBy(F.col(scope).alias("c_scope")).agg(F.max(F.col(number).cast("bigint")).alias("cleared"))
    d = last.join(dropped, last[key] == dropped["d_key"], "left").join(cleared, F.col(f"row.{scope}") == F.col("c_scope"), "left")
    return d.where((F.col("dropped").isNull() | (F.col("dropped") < F.col("at"))) & (F.col("cleared").isNull() | (F.col("cleared") <= F.col("at")))).select("row.*")


def entries_of(changes: DataFrame, key: str, state: str, version: str) -> DataFrame:
    """(key, version, state_from, state_to, end_reason): intervals of a registry from its log of changes.

    `changes` has (key, state, kind, version): `open` begins an entry and closes the one before it (replaced), `close` ends it
    (withdrawn), `rollback` ends it (rolled_back) and shows the newest version older than the shown one anew, after a `close` the newest of
    all. Versions are as old as their `open`. A rollback with no older version is refused and changes nothing. States are whole numbers; one
    change of a key a state.

    Where rollbacks lead is counted, not folded: the n-th version is shown after n opens, and each rollback since the last open or close
    goes one back. So nothing but running counts and one join by (key, number) is needed, whatever the length of a history.
    """
    w = Window.partitionBy(key).orderBy(state)
    kind = F.col("kind")
    turn = kind.isin("open", "close")
    d = changes.select(key, state, "kind", version, F.count_if(kind == "open").over(w).alias("n"), F.count_if(turn).over(w).alias("turn"), F.last(F.when(turn, kind), True).over(w).alias("after"))
    back = F.count_if(kind == "rollback").over(Window.partitionBy(key, "turn").orderBy(state))
    d = d.withColumn("number", F.when(kind == "open", F.col("n")).when(kind == "rollback", F.col("n") + (F.col("after") == "close").cast("int") - back))
    d = d.where((kind != "rollback") | (F.col("number") > 0)).withColumn("state_to", F.lead(state).over(w)).withColumn("next", F.lead("kind").over(w))
    opened = d.where(kind == "open").select(F.col(key).alias("o_key"), F.col("n").alias("o_n"), F.col(version).alias("shown"))
    d = d.where("number is not null").drop(version).join(opened, (F.col(key) == F.col("o_key")) & (F.col("number") == F.col("o_n")))
    reason = F.when(F.col("next") == "open", "replaced").when(F.col("next") == "close", "withdrawn").when(F.col("next") == "rollback", "rolled_back")
    return d.select(key, F.col("shown").alias(version), F.col(state).alias("state_from"), "state_to", reason.alias("end_reason"))


def updated_from(target: DataFrame, source: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """`target` whose listed columns take the source's values where the source has the key."""
    s = source.select(F.col(key).alias("s_key"), *(F.col(c).alias(f"s_{c}") for c in columns), F.lit(True).alias("found"))
    d = target.join(s, F.col(key) == F.col("s_key"), "left")
    return d.select(*(F.when(F.col("found"), F.col(f"s_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns))


#: The review states of an asset and the events that move between them.
REVIEW = {("draft", "submit"): "in_review", ("in_review", "verify"): "verified", ("in_review", "reject"): "rejected", ("rejected", "submit"): "in_review", ("verified", "revoke"): "draft"}


def reviewed(events: DataFrame, key: str, order: str, event: str) -> DataFrame:
    """(key, status, refused, servable): each asset's status after its events in order; an event that does not fit is refused and counted.

    An asset's events are few (a review history), so they are folded in one row.
    """
    d = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, event)))[event].alias("events"))
    start = F.struct(F.lit("draft").alias("status"), F.lit(0).cast("bigint").alias("refused"))

    def move(acc, e):
        to = F.lit(None).cast("string")
        for (status, name), after in REVIEW.items():
            to = F.when((acc["status"] == status) & (e == name), after).otherwise(to)
        return F.struct(F.coalesce(to, acc["status"]).alias("status"), (acc["refused"] + to.isNull().cast("bigint")).alias("refused"))

    d = d.withColumn("end", F.aggregate("events", start, move))
    return d.select(key, "end.status", "end.refused", (F.col("end.status") == "verified").alias("servable"))


def ledger(entries: DataFrame, budget: str, order: str, kind: str, amount: str, limit: float) -> DataFrame:
    """(budget, reserved, spent, left): reserve, settle and release entries of budgets, in decimals.

    A settle frees its reservation (`reserved_amount`) and spends `amount`; a release only frees.
    """
    dec = lambda c: F.col(c).cast("decimal(38,4)")
    held = F.when(F.col(kind) == "reserve", dec(amount)).otherwise(-dec("reserved_amount"))
    spent = F.when(F.col(kind) == "settle", dec(amount)).otherwise(F.lit(0))
    d = entries.groupBy(budget).agg(F.sum(held).alias("reserved"), F.sum(spent).alias("spent"))
    return d.withColumn("left", F.lit(limit).cast("decimal(38,4)") - F.col("reserved") - F.col("spent"))
