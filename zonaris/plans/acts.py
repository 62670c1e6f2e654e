"""Queries of planning acts: quantities, scopes, findings, checked candidates, confidence and the whole parse. They join `catalog.QUERIES`.

There are no acts among the tables. One is written for each supplier, its values taken from the key, with traps (dates, laws, references, shares of
something else) and a whole text of `documents` as a paragraph of its own, in which nothing may be found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonaris.operators import acts as A
from zonaris.plans.catalog import query, table


def acts(spark, sf_dir) -> DataFrame:
    """(s_suppkey, text): an act of each supplier."""
    k = F.col("s_suppkey")
    noise = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), "text")
    s = table(spark, sf_dir, "supplier").join(noise, k == F.col("d"), "left")
    n = lambda x: x.cast("string")
    parts = [
        F.lit("§ 1. Uchwała nr XII/"), n(k), F.lit("/2019 z dnia 5 maja 2019 r., art. 15 ust. 2 (Dz. U. z 2020 r. poz. "), n(k), F.lit(").\n"),
        F.lit("§ 2. Dla terenów oznaczonych symbolami 1MN, 2MN–"), n(k % 3 + 2), F.lit("MN ustala się:\n1) maksymalna wysokość zabudowy – "), n(k % 20 + 5), F.lit(",5 m;\n"),
        F.lit("2) powierzchnia biologicznie czynna:\na) nie mniejsza niż "), n(k % 50 + 20), F.lit("% powierzchni działki,\nb) w terenie 1MN – minimum 0,"), n(k % 5 + 2), F.lit(";\n"),
        F.lit("3) nachylenie połaci dachowych od "), n(k % 10 + 10), F.lit(" do 45°;\n4) zakaz lokalizacji garaży blaszanych"), F.when(k % 2 == 0, F.lit(" z wyjątkiem strefy A")).otherwise(F.lit("")), F.lit(";\n"),
        F.lit("§ 3. Teren 7U: dopuszcza się budowę ogrodzeń o wysokości do 2 m. Minimum "), n(k % 4 + 1), F.lit(" miejsca postojowe.\n§ 4. "), F.coalesce("text", F.lit("")),
    ]
    return s.select("s_suppkey", F.concat(*parts).alias("text"))


_SYMBOLS = "(select unnest(case s_suppkey%3 when 0 then ['1MN','2MN'] when 1 then ['1MN','2MN','3MN'] else ['1MN','2MN','3MN','4MN'] end))"
_FOUND = """found as (select s_suppkey, 'height' as family, 'max' as operator, null::double as low, s_suppkey%20+5.5 as high, null as own from supplier union all select s_suppkey, 'bio', 'min', s_suppkey%50+20, null, null from supplier
union all select s_suppkey, 'bio', 'min', (s_suppkey%5+2)*10, null, '1MN' from supplier union all select s_suppkey, 'roof', 'range', s_suppkey%10+10, 45, null from supplier union all select s_suppkey, 'parking', 'min', s_suppkey%4+1, null, '7U' from supplier)"""
_HELD = "case when own is not null then [own] else case s_suppkey%3 when 0 then ['1MN','2MN'] when 1 then ['1MN','2MN','3MN'] else ['1MN','2MN','3MN','4MN'] end end"


@query(f"with {_FOUND} select s_suppkey, family, operator, cast(low as double) as low, cast(high as double) as high, array_to_string({_HELD},' ') as symbols from found")
def act_quantities(spark, sf_dir):
    """Quantities of acts: masks, clauses that inherit, nearest parameter, limits, ranges, units, symbols."""
    d = A.quantities_of(acts(spark, sf_dir), "s_suppkey", "text")
    return d.select("s_suppkey", "family", "operator", "low", "high", F.concat_ws(" ", "symbols").alias("symbols"))


@query("select s_suppkey, '' as law, case s_suppkey%3 when 0 then '1MN 2MN' when 1 then '1MN 2MN 3MN' else '1MN 2MN 3MN 4MN' end as height, '1MN' as part, '7U' as parking from supplier")
def act_scopes(spark, sf_dir):
    """The symbols that the innermost clause around a place holds for, from the clauses around it where it has none."""
    d = acts(spark, sf_dir)
    at = F.array(*((F.instr("text", w) - 1).cast("bigint") for w in ("Uchwa", "wysokość zabudowy", "minimum 0,", "postojowe")))
    d = d.select("s_suppkey", A.scopes("text", at).alias("s"))
    return d.select("s_suppkey", *(F.concat_ws(" ", F.col("s")[i]).alias(n) for i, n in enumerate(("law", "height", "part", "parking"))))


@query("select s_suppkey, 'forbidden' as modality, 'is:forbidden|what:garaż blaszan'||case when s_suppkey%2=0 then '|except:A stref' else '' end as condition from supplier union all select s_suppkey, 'allowed', 'is:allowed|what:ogrodze' from supplier")
def act_findings(spark, sf_dir):
    """Prohibitions and permissions with the key of their subject, exceptions and places."""
    return A.findings_of(acts(spark, sf_dir), "s_suppkey", "text").select("s_suppkey", "modality", "condition")


_CASES = ("null", "'parameter_unknown'", "'operator_not_allowed'", "'quote_empty'", "'quote_not_found'", "'raw_empty'", "'raw_not_in_quote'", "'raw_truncated'", "'value_underivable'", "'value_mismatch'", "'symbol_out_of_scope'", "'duplicate'", "'document_missing'")


@query(f"select s_suppkey, i as n, case i {' '.join(f'when {i} then {c}' for i, c in enumerate(_CASES))} end as reason, case when i in (0,11) then s_suppkey%20+5.5 end as derived from supplier, range(0,13) t(i)")
def act_candidates(spark, sf_dir):
    """Candidates for each act, one good and one for each gate that it fails."""
    d = acts(spark, sf_dir)
    k = F.col("s_suppkey")
    c = table(spark, sf_dir, "supplier").select(k, F.explode(F.sequence(F.lit(0), F.lit(12))).alias("n"))
    n = F.col("n")
    value, raw = (k % 20).cast("double") + 5.5, F.concat((k % 20 + 5).cast("string"), F.lit(",5 m"))
    quote = F.concat(F.lit("maksymalna  wysokość zabudowy – "), raw)
    at = lambda i, x, y: F.when(n == i, x).otherwise(y)
    c = c.select(
        at(12, -k - 1, k).alias("s_suppkey"), (k * 100 + n).alias("candidate"), "n", at(10, F.lit("7U"), F.lit("1MN")).alias("symbol"), at(1, F.lit("volume"), F.lit("height")).alias("family"),
        at(2, F.lit("min"), F.lit("max")).alias("operator"), at(9, value + 1, value).alias("value"),
        F.when(n == 5, " ").when(n == 6, F.lit("99 m")).when(n == 7, F.concat((k % 20 + 5).cast("string"), F.lit(""))).when(n == 8, F.lit("wysokość")).otherwise(raw).alias("raw"),
        F.when(n == 3, "").when(n == 4, F.lit("wysokość zabudowy 3 m")).otherwise(quote).alias("quote"),
    )
    got = A.verified(c.drop("n"), d, "s_suppkey", "text")
    return got.select(F.expr("candidate div 100").alias("s_suppkey"), F.expr("cast(candidate % 100 as int)").alias("n"), "reason", F.when(F.col("reason").isNull() | (F.col("reason") == "duplicate"), F.col("derived")).alias("derived"))


_P = "round(1/(1+exp(-(3.0-0.7*ocr-0.1*(case when family='bio' then 1 else 0 end)-0.3*converted-0.5*several-1.0*conflict))),6)"


@query(f"""with {_FOUND}, each as (select s_suppkey, family, operator, low, high, unnest({_HELD}) as symbol, own is not null as own from found),
f as (select s_suppkey, symbol, family, operator, low, count(*) over (partition by s_suppkey, symbol, family) as n, case when s_suppkey%7=0 then 1 else 0 end as ocr, case when family='bio' and own then 1 else 0 end as converted
 from (select distinct on (s_suppkey, symbol, family, operator, low, high) * from each order by s_suppkey, symbol, family, operator, low, high, own))
select s_suppkey, symbol, family, n>1 as conflict, min(p) as least, max(case when p>=0.9 then 'high' when p>=0.7 then 'medium' else 'low' end) as band from (select *, {_P} as p from (select *, least(1,ln(n)/ln(4)) as several, case when n>1 then 1 else 0 end as conflict from f)) group by all""".replace("max(case when p>=0.9 then 'high' when p>=0.7 then 'medium' else 'low' end) as band", "case when min(p)>=0.9 then 'high' when min(p)>=0.7 then 'medium' else 'low' end as band"))
def act_confidence(spark, sf_dir):
    """The whole parse of acts, a row for each symbol and value, with probability and band; here the least sure value of each parameter."""
    d = acts(spark, sf_dir)
    v = A.parsed(d, "s_suppkey", "text", ocr=F.col("s_suppkey") % 7 == 0)
    g = v.groupBy("s_suppkey", "symbol", "family").agg((F.max("value_kind") == "conflict").alias("a"), F.count_if(F.col("value_kind") == "conflict").alias("c"), F.min("probability").alias("least"), F.min_by("band", "probability").alias("band"))
    return g.select("s_suppkey", "symbol", "family", (F.col("c") > 0).alias("conflict"), "least", "band")


@query("select s_suppkey, case when s_suppkey%50+20=(s_suppkey%5+2)*10 then case when s_suppkey%7=0 then 'ok' else 'ok' end else 'review' end as status, case when s_suppkey%50+20=(s_suppkey%5+2)*10 then 0 else 2 end as conflicts from supplier")
def act_validation(spark, sf_dir):
    """What becomes of each act: empty, ok, or to be looked at because values of a symbol differ."""
    d = acts(spark, sf_dir)
    v = A.validated(d, A.parsed(d, "s_suppkey", "text"), "s_suppkey")
    return v.select("s_suppkey", "status", "conflicts")
