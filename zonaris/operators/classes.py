"""Rows of equal values worked once: classes of rows, work on their distinct values, and results given back to every row.

Joins and functions of shapes cost much a shape or a pair and depend on nothing else, so they run on distinct values; a row gets its
result by an equi join. Where all values differ this costs one more shuffle, nothing more; no row is left out or merged.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonaris.sources.shared import written

#: names of the numbers of values: of queries, of operators and of pairs, so that one can be used inside the other
SAME, OWN, PAIR = "same_as", "shape_as", "pair_as"


def wide(df: DataFrame, *by: str) -> DataFrame:
    """`df` dealt to as many tasks as a shuffle has, also where few rows would be put together: for rows that cost much each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def classed(df: DataFrame, by: Sequence[str], name: str = SAME) -> tuple[DataFrame, DataFrame]:
    """(values, members): the distinct values of `by` with a number `name`, written to the shared folder, and `df` with the number of its value."""
    values = written(wide(df.select(*by).distinct(), *by).withColumn(name, F.monotonically_increasing_id()), "values")
    of = values.withColumnsRenamed({c: f"of_{c}" for c in by})
    equal = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by))
    return values, df.join(of, equal).drop(*(f"of_{c}" for c in by))


def spread(found: DataFrame, members: DataFrame, at: str = SAME, how: str = "inner") -> DataFrame:
    """`members` with the rows that their value (number `at` in both) has in `found`; columns of `members` stand before equal names of `found`."""
    return members.join(found.drop(*(c for c in members.columns if c != at)), at, how).drop(at)


def spread_in_runs(found: DataFrame, members: DataFrame, at: str = SAME) -> DataFrame:
    """`spread` for values that have many rows in `found` and many members, whose result grows with their product: each row of `found` comes with all its
    members one after the other, so that a written result holds its columns as long runs. The members of one value are held by a task."""
    more = [c for c in found.columns if c not in members.columns]
    return found.select(at, *more).hint("merge").join(members, at).select(*(c for c in members.columns if c != at), *more)


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns})


def each(df: DataFrame, by: Sequence[str], work: Callable[[DataFrame], DataFrame], how: str = "inner", name: str = SAME) -> DataFrame:
    """`df` with what `work` gives for the distinct values of `by`; `work` gets the values with their number `name` and keeps it."""
    values, members = classed(df, by, name)
    return spread(work(values), members, name, how)


def paired(left: DataFrame, right: DataFrame, by_left: Sequence[str], by_right: Sequence[str], find: Callable[[DataFrame, DataFrame], DataFrame], runs: bool = False) -> DataFrame:
    """All pairs (l_*, r_*) of rows whose values `find` pairs, with the further columns that it gives. `find` gets the distinct values of both
    sides and returns pairs with the numbers l_pair_as and r_pair_as. With `runs` each right row comes with all its left ones one after the other (see
    `spread_in_runs`)."""
    (a, one), (b, two) = classed(left, by_left, PAIR), classed(right, by_right, PAIR)
    pair = find(a, b).drop(*(f"l_{c}" for c in by_left), *(f"r_{c}" for c in by_right))
    both, two = prefixed(one, "l_").join(pair, f"l_{PAIR}"), prefixed(two, "r_")
    both = two.hint("merge").join(both, f"r_{PAIR}") if runs else both.join(two, f"r_{PAIR}")
    more = [c for c in pair.columns if c not in (f"l_{PAIR}", f"r_{PAIR}")]
    return both.select(*(f"l_{c}" for c in left.columns), *(f"r_{c}" for c in right.columns), *more)
