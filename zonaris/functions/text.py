"""Text functions: HTML records, quantities with units, segments, symbol mentions and approximate quotes.

What columns can express stays in columns; offset-keeping work runs in Arrow batches.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonaris.functions.legal import arrow

#: Unit spellings and the unit that they stand for.
UNIT_NAMES = {"m": "m", "metrów": "m", "km": "km", "cm": "cm", "m2": "m2", "m²": "m2", "ha": "ha", "%": "percent", "°": "degree", "stopni": "degree"}
_QUANTITY = r"(\d+(?:[  ]\d{3})*(?:[.,]\d+)?)\s*(m2|m²|km|cm|ha|metrów|stopni|m|%|°)?"


def html_records(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, lang, n_links, n_paragraphs); null html gives nulls and zeros."""
    c = F.col(html)
    count = lambda p: F.coalesce(F.size(F.expr(f"regexp_extract_all({html}, '{p}', 0)")), F.lit(0))
    text = F.nullif(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))
    return pages.select(key, text.alias("title"), F.nullif(F.regexp_extract(c, r'(?i)<html[^>]*\blang="([^"]*)"', 1), F.lit("")).alias("lang"), F.when(c.isNull(), 0).otherwise(count("(?i)<a\\\\b")).alias("n_links"), F.when(c.isNull(), 0).otherwise(count("(?i)<p\\\\b")).alias("n_paragraphs"))


def locale_number(raw: Column) -> Column:
    """`1 234,5` as 1234.5; anything else is null."""
    plain = F.regexp_replace(F.regexp_replace(raw, "[  ]", ""), ",", ".")
    return F.when(plain.rlike(r"^-?\d+(\.\d+)?$"), plain.cast("double"))


def quantities(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, raw, value, unit): numbers, with the unit right behind them if there is one, in order of place. The key stays in the JVM."""
    pattern = re.compile(_QUANTITY)

    def found(t: str | None) -> list[dict]:
        return [{"start": m.start(), "raw": m[0].strip(), "value": float(re.sub(r"[  ]", "", m[1]).replace(",", ".")), "unit": UNIT_NAMES.get(m[2] or "")} for m in pattern.finditer(t or "")]

    typ = pa.list_(pa.struct([("start", pa.int64()), ("raw", pa.string()), ("value", pa.float64()), ("unit", pa.string())]))
    return docs.select(key, F.explode(arrow(found, "array<struct<start:bigint,raw:string,value:double,unit:string>>", typ)(text)).alias("q")).select(key, "q.*")


def segments(docs: DataFrame, key: str, text: str, most: int = 2000) -> DataFrame:
    """(key, index, start, end): half-open spans that tile each text, cut at the last line end, sentence end or space
    before `most` characters, else there. An empty text has no span."""

    def tiles(t: str | None) -> list[dict]:
        out, at, t = [], 0, t or ""
        while at < len(t):
            end = min(len(t), at + most)
            if end < len(t):
                cut = max(t.rfind("\n", at, end), t.rfind(". ", at, end))
                cut = cut if cut > at else t.rfind(" ", at, end)
                end = cut + 1 if cut > at else end
            out.append({"start": at, "end": end})
            at = end
        return out

    typ = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return docs.select(key, F.posexplode(arrow(tiles, "array<struct<start:bigint,end:bigint>>", typ)(text)).alias("index", "s")).select(key, "index", "s.*")


def canonical_symbol(c: Column) -> Column:
    """A zone symbol in capitals, with dots, spaces and slashes unified."""
    return F.regexp_replace(F.upper(F.trim(c)), r"[\s._]+", "")


def find_quote(text: str, quote: str, most: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best approximate occurrence with at most `most` edits, the leftmost of equals.

    Dynamic programming over the text with a free start (Sellers), one column at a time.
    """
    n = len(quote)
    cost, start = list(range(n + 1)), [0] * (n + 1)
    best = None
    for j, c in enumerate(text, 1):
        new, begin = [0] * (n + 1), [j] * (n + 1)
        for i in range(1, n + 1):
            options = ((cost[i - 1] + (quote[i - 1] != c), start[i - 1]), (cost[i] + 1, start[i]), (new[i - 1] + 1, begin[i - 1]))
            new[i], begin[i] = min(options)
        cost, start = new, begin
        if cost[n] <= most and (best is None or cost[n] < best[2]):
            best = (start[n], j, cost[n])
    return best
