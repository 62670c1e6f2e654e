"""Tables from planning acts: quantities, findings, checked candidates, confidence, and the whole parse as one plan.

A text is the unit of work; texts are spread as the scan deals them, and every table is one row for each thing found.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonaris.functions import acts as A
from zonaris.functions import legal as T

_s, _l, _d = pa.string(), pa.int64(), pa.float64()
QUANTITY = "family string, operator string, low double, high double, flags array<string>, start bigint, end bigint, noun_start bigint, noun_end bigint, symbols array<string>, clause bigint"
_QUANTITY = pa.list_(pa.struct([("family", _s), ("operator", _s), ("low", _d), ("high", _d), ("flags", pa.list_(_s)), ("start", _l), ("end", _l), ("noun_start", _l), ("noun_end", _l), ("symbols", pa.list_(_s)), ("clause", _l)]))
quantities = T.arrow(lambda text: [vars(q) for q in A.quantities(text or "")], f"array<struct<{QUANTITY.replace(' ', ':').replace(',:', ',')}>>", _QUANTITY)
_FINDING = pa.list_(pa.struct([("modality", _s), ("key", _s), ("symbols", pa.list_(_s)), ("start", _l), ("end", _l)]))
findings = T.arrow(lambda text: A.findings(text or ""), "array<struct<modality:string,key:string,symbols:array<string>,start:bigint,end:bigint>>", _FINDING)
#: the symbols that the clause around each of an array of places holds for
scopes = T.arrow(lambda text, places: A.scope_of(text or "", [p if p is not None else -1 for p in places or []]), "array<array<string>>", pa.list_(pa.list_(_s)))
condition_key = T.arrow(lambda text: A.condition_key(text), "string", _s)


def quantities_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, family, operator, low, high, flags, start, end, noun_start, noun_end, symbols, clause): the quantities of each text in order.

    start and end are places of the value, noun_start and noun_end of the word that names its parameter, in characters. A text that is null or empty, or
    without any, gives no rows; further columns are ignored.
    """
    return docs.select(key, F.posexplode(quantities(text)).alias("n", "q")).select(key, "n", "q.*")


def findings_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, modality, condition, symbols, start, end): prohibitions, permissions and duties of each text."""
    return docs.select(key, F.posexplode(findings(text)).alias("n", "f")).select(key, "n", "f.modality", F.col("f.key").alias("condition"), "f.symbols", "f.start", "f.end")


#: Which limits a parameter may have.
OPERATORS = {"height": ("max", "exact", "range"), "storeys": ("max", "exact", "range"), "coverage": ("max", "exact"), "bio": ("min", "exact"), "intensity": ("max", "min", "range", "exact"), "roof": ("max", "min", "range", "exact"), "setback": ("min", "exact"), "parking": ("min", "exact"), "plot": ("min", "exact")}
GATES = ("parameter_unknown", "operator_not_allowed", "quote_empty", "quote_not_found", "raw_empty", "raw_not_in_quote", "raw_truncated", "value_underivable", "value_mismatch", "symbol_out_of_scope")
NEAR_SHARE, NEAR_LEAST = 0.05, 20


def derived(family: str, raw: str) -> float | None:
    """The value of a raw spelling such as `0,35 (35%)`, `12 m` or `trzy kondygnacje`, in the family's unit; null if it has none."""
    t = A.tokens(raw)
    for i, k in enumerate(t):
        value = k.value if k.kind == "num" else A.NUMBERS.get(k.text) if k.kind == "word" else None
        if value is None:
            continue
        unit, after = A._unit(t, i + 1)
        brackets = t[after + 1].value if unit == "none" and after + 2 < len(t) and t[after].kind == "(" and t[after + 2].text == "%" else None
        got = A.normal(family, value, unit, k.text, brackets)
        return got[0] if got else None
    return None


def gate(text: str, candidates: Sequence[dict], ocr: bool) -> list[dict]:
    """Of each candidate (symbol, family, operator, value, raw, quote) the first gate that it fails, or null with the place of its quote.

    Quotes are looked for as they are but for white space; in a scanned text a quote of at least `NEAR_LEAST` characters may differ by a
    twentieth of them, digits excepted. The value is derived from the text's own spelling, never taken from the candidate.
    """
    text = text or ""
    out = []
    c: list | None = None
    for row in candidates:
        start = end = value = edits = None
        family, quote, raw = row["family"], row["quote"] or "", row["raw"] or ""

        def judge() -> str | None:
            nonlocal start, end, value, edits, c
            if family not in OPERATORS:
                return GATES[0]
            if row["operator"] not in OPERATORS[family]:
                return GATES[1]
            if not quote.strip():
                return GATES[2]
            place = T._quote(text, quote)
            if place is None and ocr and len(quote) >= NEAR_LEAST:
                place = T._near(text, quote, int(len(quote) * NEAR_SHARE))
            if place is None:
                return GATES[3]
            start, end, edits = place["start"], place["end"], place.get("edits", 0)
            if not raw.strip():
                return GATES[4]
            inner = T._quote(text[start:end], raw)
            if inner is None:
                return GATES[5]
            a, b = start + inner["start"], start + inner["end"]
            if a and text[a - 1].isdigit() and text[a].isdigit() or b < len(text) and (text[b].isdigit() and text[b - 1].isdigit() or text[b] in ",." and text[b - 1].isdigit() and text[b + 1 : b + 2].isdigit()):
                return GATES[6]
            value = derived(family, text[a:b])
            if value is None:
                return GATES[7]
            if row["value"] is not None and not math.isclose(value, row["value"], rel_tol=1e-6, abs_tol=1e-6):
                return GATES[8]
            if row["symbol"] is not None:
                if c is None:
                    c = A.scoped(A.tokens(text), len(text))
                held = c[A.innermost([(x.start, x.end) for x in c], [start])[0]].symbols
                if held and row["symbol"] not in held:
                    return GATES[9]
            return None

        reason = judge()
        out.append({"reason": reason, "start": start, "end": end, "edits": edits, "derived": value})
    return out


_gate = T.arrow(gate, "array<struct<reason:string,start:bigint,end:bigint,edits:bigint,derived:double>>", pa.list_(pa.struct([("reason", _s), ("start", _l), ("end", _l), ("edits", _l), ("derived", _d)])))


def verified(candidates: DataFrame, docs: DataFrame, key: str, text: str, ocr: Column | None = None) -> DataFrame:
    """`candidates` with start, end, edits, derived and reason: null, or the first gate failed.

    Candidates have a unique `candidate`, `key`, symbol, family, operator, value, raw and quote. After `GATES`, which look at one candidate: `pair_conflict` where
    a symbol's least value of a parameter is above its greatest, and `duplicate` for a value told before (by `candidate`). `document_missing`: no text has the key.
    A document's candidates meet its text once; they are at most what a document was asked for.
    """
    fields = ("candidate", "symbol", "family", "operator", "value", "raw", "quote")
    per = candidates.groupBy(F.col(key).alias("c_key")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))
    d = docs.select(F.col(key).alias("d_key"), F.col(text).alias("d_text"), (F.lit(False) if ocr is None else ocr).alias("d_ocr"))
    met = per.join(d, per["c_key"].eqNullSafe(d["d_key"]), "left")
    missing = F.transform("rows", lambda r: F.struct(F.lit("document_missing").alias("reason"), *(F.lit(None).cast("bigint").alias(c) for c in ("start", "end", "edits")), F.lit(None).cast("double").alias("derived")))
    judged = F.when(F.col("d_text").isNull(), missing).otherwise(_gate("d_text", "rows", "d_ocr"))
    one = met.select("c_key", F.explode(F.arrays_zip("rows", judged.alias("judged"))).alias("x")).select(F.col("c_key").alias(key), "x.rows.*", "x.judged.*")
    good = F.col("reason").isNull()
    of = Window.partitionBy(key, "symbol", "family")
    least = F.max(F.when(good & F.col("operator").isin("min"), F.col("derived"))).over(of)
    most = F.min(F.when(good & F.col("operator").isin("max"), F.col("derived"))).over(of)
    first = F.row_number().over(Window.partitionBy(key, "symbol", "family", "operator", "derived", good).orderBy("candidate"))
    d = one.withColumns({"_least": least, "_most": most, "_n": first})
    late = F.when(F.col("operator").isin("min", "max") & (F.col("_least") > F.col("_most")), "pair_conflict").when(F.col("_n") > 1, "duplicate")
    return d.withColumn("reason", F.when(good, late).otherwise(F.col("reason"))).drop("_least", "_most", "_n")


#: The features of a value in the order of the weights.
FEATURES = ("ocr", "near_quote", "general_scope", "inherited", "number_word", "converted", "implied", "mismatch", "several", "conflict", "exact")


def features(ocr: Column, edits: Column, symbols: Column, flags: Column, operator: Column, values: Column) -> Column:
    """The features of a value as doubles from 0 to 1; `values` is how many different ones its symbol and parameter have."""
    has = lambda *names: F.exists(flags, lambda f: f.isin(*names)).cast("double")
    several = F.least(F.lit(1.0), F.log(F.greatest(values, F.lit(1)).cast("double")) / math.log(4))
    made = (ocr.cast("double"), (F.coalesce(edits, F.lit(0)) > 0).cast("double"), (F.size(symbols) == 0).cast("double"), has("inherited"), has("number_word"), has("ratio_to_percent", "percent_to_ratio", "hectare_to_m2"), has("unit_implied", "implicit_percent", "degree_artifact"), has("double_notation_mismatch"), several, (values > 1).cast("double"), (operator == "exact").cast("double"))
    return F.array(*(F.coalesce(m, F.lit(0.0)) for m in made))


def weights_artifact(version: str, intercept: float, weights: Sequence[float], bands: Sequence[tuple[str, float]]) -> str:
    """Weights, bands (name, least probability; from the highest down) and version as canonical JSON; ValueError if they do not fit together."""
    if len(weights) != len(FEATURES):
        raise ValueError(f"{len(FEATURES)} weights are needed")
    if [b for _, b in bands] != sorted((b for _, b in bands), reverse=True) or not bands or bands[-1][1] != 0:
        raise ValueError("bands must fall and end at 0")
    return json.dumps({"version": version, "features": FEATURES, "intercept": intercept, "weights": list(weights), "bands": [list(b) for b in bands]}, sort_keys=True, ensure_ascii=False)


def scored(values: DataFrame, artifact: str, vector: str = "features") -> DataFrame:
    """`values` with probability (logistic, 6 digits), band, score (0 to 100) and the artifact's version; ValueError if it was made for other features."""
    a = json.loads(artifact)
    if tuple(a["features"]) != FEATURES:
        raise ValueError("the artifact was made for other features")
    z = F.aggregate(F.zip_with(F.col(vector), F.array(*(F.lit(float(w)) for w in a["weights"])), lambda x, w: x * w), F.lit(float(a["intercept"])), lambda s, x: s + x)
    p = F.round(1 / (1 + F.exp(-z)), 6)
    band = F.lit(a["bands"][-1][0])
    for name, least in reversed(a["bands"][:-1]):
        band = F.when(p >= least, name).otherwise(band)
    return values.withColumns({"probability": p, "band": band, "score": F.round(100 * p, 0).cast("int"), "weights_version": F.lit(a["version"])})


#: Log odds of a plain value, and what each feature takes from them, until a fit (`studies.logistic_fit`) replaces them.
PRIOR = weights_artifact("prior-1", 3.0, [-0.7, -2.0, -0.7, -0.1, -0.2, -0.3, -0.5, -1.0, -0.5, -1.0, -0.4], [("high", 0.9), ("medium", 0.7), ("low", 0.0)])


def parsed(docs: DataFrame, key: str, text: str, artifact: str = PRIOR, ocr: Column | None = None) -> DataFrame:
    """(key, symbol, family, operator, low, high, value_kind, quote, start, end, flags, probability, band, score, weights_version): the whole parse.

    One row for each quantity and symbol that it holds for (null: all zones). value_kind: `conflict` where the symbol has the parameter with the same limit and
    another value, `conditional` where the clause tells a place or an exception, else `unconditional`. Values that repeat are kept once, the first place.
    """
    d = docs.select(F.col(key), F.col(text).alias("_text"), (F.lit(False) if ocr is None else ocr).alias("_ocr"))
    q = d.select(key, "_text", "_ocr", F.posexplode(quantities("_text")).alias("n", "q")).select(key, "_text", "_ocr", "n", "q.*")
    start = F.least("start", "noun_start")
    quote = F.expr("substring(_text, cast(least(start, noun_start) as int) + 1, cast(greatest(end, noun_end) - least(start, noun_start) as int))")
    after = F.regexp_extract(F.expr("substring(_text, cast(greatest(end, noun_end) as int) + 1, 120)"), r"^[^;.\n]*", 0)
    q = q.withColumns({"quote": quote, "condition": condition_key(after), "at": start, "symbol": F.explode_outer("symbols")})
    same = Window.partitionBy(key, "symbol", "family", "operator", "low", "high").orderBy("n")
    q = q.withColumn("_n", F.row_number().over(same)).where("_n = 1")
    of = Window.partitionBy(key, "symbol", "family", "operator")
    q = q.withColumn("_values", F.count("*").over(of))
    conditional = F.col("condition").contains("where:") | F.col("condition").contains("except:")
    kind = F.when(F.col("_values") > 1, "conflict").when(conditional, "conditional").otherwise("unconditional")
    q = q.withColumns({"value_kind": kind, "features": features(F.col("_ocr"), F.lit(0), F.col("symbols"), F.col("flags"), F.col("operator"), F.col("_values"))})
    out = scored(q, artifact)
    return out.select(key, "symbol", "family", "operator", "low", "high", "value_kind", "quote", F.col("at").alias("start"), F.greatest("end", "noun_end").alias("end"), "flags", "probability", "band", "score", "weights_version")


def validated(docs: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """(key, status, values, symbols, conflicts, doubtful): `empty` without a value, `review` with a conflict or a value of the lowest band, else `ok`."""
    low = F.col("band") == "low"
    per = values.groupBy(F.col(key).alias("v_key")).agg(F.count("*").alias("values"), F.countDistinct("symbol").alias("symbols"), F.count_if(F.col("value_kind") == "conflict").alias("conflicts"), F.count_if(low).alias("doubtful"))
    d = docs.select(key).join(per, F.col(key).eqNullSafe(F.col("v_key")), "left").fillna(0, ["values", "symbols", "conflicts", "doubtful"])
    status = F.when(F.col("values") == 0, "empty").when((F.col("conflicts") > 0) | (F.col("doubtful") > 0), "review").otherwise("ok")
    return d.select(key, status.alias("status"), "values", "symbols", "conflicts", "doubtful")
