"""Versioned tables: as-of reads, registry states, snapshot diffs and histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_at(t: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """The half-open interval [start, end) holds t; a null end is open."""
    return (F.col(start) <= t) & (F.col(end).isNull() | (F.col(end) > t))


def with_intervals(changes: DataFrame, owner: str, at: str, tie: str) -> DataFrame:
    """`changes` with valid_from and valid_to: each version holds until the owner's next one."""
    return changes.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(Window.partitionBy(owner).orderBy(at, tie)))


def version_as_of(versions: DataFrame, owner: str, t: Column, tie: str) -> DataFrame:
    """The owner's latest version that is valid at t; the interval is a pushed-down filter, then one partial maximum."""
    rest = [c for c in versions.columns if c not in (owner, "valid_from", tie)]
    best = F.max(F.struct("valid_from", tie, *rest)).alias("v")
    return versions.where(valid_at(t)).groupBy(owner).agg(best).select(owner, "v.*")


def state_as_of(summaries: DataFrame, owner: str, state: str, pinned: int, count: str) -> DataFrame:
    """The latest row with state <= pinned for each owner; a tombstone (count 0) hides what is older."""
    rest = [c for c in summaries.columns if c not in (owner, state)]
    return summaries.where(F.col(state) <= pinned).groupBy(owner).agg(F.max(F.struct(state, *rest)).alias("v")).select(owner, "v.*").where(F.col(count) > 0)


def latest_per_key(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each key in `order`."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): new, changed, unchanged or missing, by comparison of content hashes."""
    a, b = old.select(key, F.col(content).alias("_old")), new.select(key, F.col(content).alias("_new"))
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "missing").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, change.alias("change"))


def history(events: DataFrame, key: str, at: str, content: str, tie: str) -> DataFrame:
    """A slowly changing history: one row for each run of equal content, [valid_from, valid_to), the last one open.

    A repeated hash is no change, so nothing is rewritten for it.
    """
    by = Window.partitionBy(key).orderBy(at, tie)
    new = events.withColumn("_before", F.lag(content).over(by)).where(F.col("_before").isNull() | (F.col("_before") != F.col(content)))
    return new.select(key, content, F.col(at).alias("valid_from"), F.lead(at).over(by).alias("valid_to"))


def upsert(old: DataFrame, new: DataFrame, key: str, recency: Sequence[Column]) -> DataFrame:
    """Rows of both, the most recent of each key: what a merge would leave."""
    return latest_per_key(old.unionByName(new), key, recency)


def apply_changes(log: DataFrame, key: str, order: Sequence[Column], operation: str, delete: str) -> DataFrame:
    """The state after a change log: the last operation of each key wins, deleted keys go."""
    return latest_per_key(log, key, order).where(F.col(operation) != delete)


def listing_complete(rows: DataFrame, declared: DataFrame, group: str, item: str, total: str) -> DataFrame:
    """(group, declared, n_rows, n_items, complete): no item twice, and as many rows as declared."""
    got = rows.groupBy(group).agg(F.count("*").alias("n_rows"), F.countDistinct(item).alias("n_items"))
    out = declared.select(group, F.col(total).alias("declared")).join(got, group, "left").na.fill(0, ["n_rows", "n_items"])
    return out.withColumn("complete", (F.col("n_rows") == F.col("declared")) & (F.col("n_rows") == F.col("n_items")))


def withdrawals(registry: DataFrame, listing: DataFrame, key: str, scope: str, least: int = 5, fraction: float = 0.1) -> DataFrame:
    """(scope, n_registered, n_missing, blocked): how many registered rows the listing lacks; more than
    max(least, floor(fraction * registered)) blocks the withdrawal of that scope."""
    gone = registry.join(listing.select(key).distinct(), key, "left_anti").groupBy(scope).agg(F.count("*").alias("n_missing"))
    out = registry.groupBy(scope).agg(F.count("*").alias("n_registered")).join(gone, scope, "left").na.fill(0, ["n_missing"])
    return out.withColumn("blocked", F.col("n_missing") > F.greatest(F.lit(least), F.floor(F.col("n_registered") * fraction)))
