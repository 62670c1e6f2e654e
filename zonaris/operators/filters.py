"""Filters and projections with parameters: optional conditions, code prefixes, JSON paths, validators with a reason."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_zoom(df: DataFrame, zoom: int, least: Mapping[str, int]) -> DataFrame:
    """`df` with each listed column null below its least zoom; the others as they are."""
    return df.select(*((F.col(c) if zoom >= least.get(c, zoom) else F.lit(None).cast(t)).alias(c) for c, t in df.dtypes))


def optional(df: DataFrame, **wanted: Sequence | None) -> DataFrame:
    """The rows whose columns have one of the wanted values; an argument of None sets no condition, an empty list fits nothing."""
    given = {c: v for c, v in wanted.items() if v is not None}
    return reduce(lambda d, c: d.where(F.col(c).isin(list(given[c]))), given, df)


def in_scope(df: DataFrame, code: str, scopes: DataFrame, scope: str) -> DataFrame:
    """The rows whose hierarchical code lies under a scope, or above one: one of the two is a prefix of the other.

    One equi join for each length of a scope, so no pair of code and scope is tried by comparison.
    """
    lengths = [r["n"] for r in scopes.select(F.length(scope).alias("n")).where("n > 0").distinct().collect()]  # the levels of the code
    fits = F.lit(False)
    out = df
    for n in sorted(lengths):
        of = scopes.where(F.length(scope) == n).select(F.col(scope).alias(f"scope{n}"))
        out = out.join(of.distinct(), F.substring(code, 1, n) == F.col(f"scope{n}"), "left")
        fits = fits | F.col(f"scope{n}").isNotNull()
    above = scopes.select(F.explode(F.transform(F.sequence(F.lit(1), F.length(scope)), lambda k: F.substring(F.col(scope), F.lit(1), k))).alias("above")).distinct()
    out = out.join(above, F.col(code) == F.col("above"), "left")
    return out.where(fits | F.col("above").isNotNull()).select(*df.columns)


def keys_kept(props: Column, keys: Sequence[str]) -> Column:
    """A JSON object with only the given keys, compared without case, and their values as they are, as JSON text; null if none is left.

    Keys whose value is null go; text that is no JSON object is null.
    """
    wanted = [x.lower() for x in keys]
    whole = F.from_json(props, "map<string,variant>")
    kept = F.map_filter(whole, lambda k, v: F.lower(k).isin(wanted) & v.isNotNull() & ~F.is_variant_null(v))
    return F.when(F.size(kept) > 0, F.to_json(kept))


def all_tokens(label: Column, query: Column) -> Column:
    """Whether a label holds every token of a query, without case; a query without tokens fits nothing."""
    tokens = F.filter(F.split(F.lower(query), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.instr(F.lower(label), t) > 0)


def in_bounds(x: Column, y: Column, bounds: Sequence[float]) -> Column:
    """Why a coordinate pair is refused (`missing`, `not_finite`, `out_of_bounds`), or null."""
    x0, y0, x1, y1 = bounds
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(x.isNull() | y.isNull(), "missing").when(bad(x) | bad(y), "not_finite").when(~x.between(x0, x1) | ~y.between(y0, y1), "out_of_bounds")


def constraint_reason(rows: DataFrame, rules: DataFrame, parameter: str, operator: str, value: str) -> DataFrame:
    """`rows` with `reason`: why a planning value is refused by its parameter's rule, or null.

    `rules` has (parameter, operators, least, most). Reasons in this order: unknown_parameter, missing_value, negative_value, bad_operator, below_range, above_range.
    """
    r = F.broadcast(rules.select(F.col("parameter").alias("r_p"), F.col("operators").alias("r_o"), "least", "most"))  # one row for each parameter
    v = F.col(value)
    reason = (
        F.when(F.col("r_p").isNull(), "unknown_parameter").when(v.isNull() | F.isnan(v), "missing_value").when(v < 0, "negative_value")
        .when(~F.array_contains("r_o", F.col(operator)), "bad_operator").when(v < F.col("least"), "below_range").when(v > F.col("most"), "above_range")
    )
    return rows.join(r, F.col(parameter) == F.col("r_p"), "left").withColumn("reason", reason).drop("r_p", "r_o", "least", "most")


def url_reason(url: Column, hosts: Sequence[str] = ()) -> Column:
    """Why a link is not safe to follow, or null: not_https, no_host, user_info, local_host, address_literal, other_port, host_not_listed."""
    of = lambda part: F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:@]*)(?::(\d+))?(?:[/?#]|$)", part)
    host, port = F.lower(of(2)), of(3)
    listed = reduce(lambda a, h: a | (host == h) | host.endswith("." + h), hosts, F.lit(not hosts))
    return (
        F.when(url.isNull() | ~F.lower(url).startswith("https://"), "not_https").when(host == "", "no_host").when(of(1) != "", "user_info")
        .when((host == "localhost") | host.endswith(".local") | host.endswith(".internal"), "local_host").when(host.rlike(r"^\[|^\d+(\.\d+){3}$"), "address_literal")
        .when((port != "") & (port != "443"), "other_port").when(~listed, "host_not_listed")
    )


def redistribution(artifacts: DataFrame, policies: DataFrame, source: str, raw: str) -> DataFrame:
    """`artifacts` with `decision` (include, redact, omit) and `why`; the raw field is null unless included.

    `policies` has (policy_source, allowed, attribution); a source without a policy is omitted.
    """
    d = artifacts.join(F.broadcast(policies), F.col(source) == F.col("policy_source"), "left")  # one row for each source of data
    decision = F.when(F.col("policy_source").isNull(), "omit").when(F.col("allowed"), "include").when(F.col("attribution"), "redact").otherwise("omit")
    why = F.when(F.col("policy_source").isNull(), "no_policy").when(F.col("allowed"), "open").when(F.col("attribution"), "raw_not_open").otherwise("not_open")
    return d.withColumns({"decision": decision, "why": why}).withColumn(raw, F.when(F.col("decision") == "include", F.col(raw))).drop("policy_source", "allowed", "attribution")


def limited(df: DataFrame, most: int, what: str = "rows") -> DataFrame:
    """`df`, or ValueError if it has more than `most` rows: one more row than allowed is asked for, never all of them."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")
    return df
