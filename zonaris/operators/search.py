"""Folding, tokens, trigram similarity and ranking of labels, all as columns."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Polish letters and what they fold to, one for one, so that offsets stay.
FROM, TO = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "acelnoszzACELNOSZZ"
SALTS = 32


def fold(c: Column) -> Column:
    """Lower case without diacritics, of the same length."""
    return F.lower(F.translate(c, FROM, TO))


def tokens(c: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.filter(F.split(fold(c), "[^a-z0-9]+"), lambda x: x != "")


def trigrams(c: Column) -> Column:
    """Distinct trigrams of each word, padded by two spaces before and one after."""
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(tokens(c), of_word)))


def _shared(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, similarity) from (a, t) and (b, t) arrays: counts of shared trigrams by an equi join, not by pairs."""
    x = left.select("a", F.size("t").alias("na"), F.explode("t").alias("g"))
    y = right.select("b", F.size("t").alias("nb"), F.explode("t").alias("g"))
    n = x.join(y, "g").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("n"))
    return n.select("a", "b", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("similarity"))


def trigram_join(df: DataFrame, key: str, label: str) -> DataFrame:
    """(a, b, similarity) with a < b for all rows whose labels share a trigram."""
    d = df.select(F.col(key).alias("a"), trigrams(F.col(label)).alias("t"))
    return _shared(d, d.withColumnRenamed("a", "b")).where("a < b")


def trigram_top_k(queries: DataFrame, query_key: str, query: str, labels: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """The k labels most like each query, ties by key."""
    q = queries.select(F.col(query_key).alias("a"), trigrams(F.col(query)).alias("t"))
    d = labels.select(F.col(key).alias("b"), trigrams(F.col(label)).alias("t"))
    s = _shared(q, d).withColumn("similarity", F.round("similarity", 8))
    by = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return s.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).withColumnsRenamed({"a": query_key, "b": key})


def text_score(label: Column, query: Column) -> Column:
    """3 if the label holds the query, plus 2 times the share of query tokens (of two characters or more) found in it."""
    words = F.filter(tokens(query), lambda w: F.length(w) >= 2)
    hit = F.size(F.filter(words, lambda w: fold(label).contains(w)))
    return 3.0 * fold(label).contains(fold(query)).cast("int") + 2.0 * F.coalesce(F.try_divide(hit, F.size(words)), F.lit(0.0))


def rank_addresses(candidates: DataFrame, key: str, kind: str, distance: Column, in_box: Column, limit: int, query_key: str = "query") -> DataFrame:
    """Re-ranked candidates (label, query and `kind`): text score, confidence of the kind, distance and box; ties by key."""
    #: Confidence by kind, and the weights of box and distance here and of text in `text_score`.
    confidence = F.when(F.col(kind) == "city", 1.0).when(F.col(kind) == "street", 0.98).when(F.col(kind) == "house_number", 0.96).otherwise(0.0)
    bias = F.coalesce(1.0 / (1.0 + distance), F.lit(0.0))
    box = F.when(in_box, 0.5).when(~in_box, -1.0).otherwise(0.0)
    scored = candidates.withColumn("score", F.round(text_score(F.col("label"), F.col("query")) + confidence + bias + box, 8))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))).where(F.col("rank") <= limit)


def stable_id(*parts: str | Column, length: int = 16) -> Column:
    """A prefix of the MD5 of the parts, joined by |."""
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, length)


def canonical_hash(*columns: str) -> Column:
    """SHA-256 of a JSON object of the columns, its keys in order and without spaces; null values are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def match_ranges(label: Column, query: Column) -> Column:
    """Half-open ranges of `label` (array of start, end) that tokens of the query of two characters or more cover; touching ones are one."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def ranges(folded: pa.Array, words: pa.Array) -> pa.Array:
        out = []
        for text, tokens_ in zip(folded.to_pylist(), words.to_pylist(), strict=True):
            found: list[dict[str, int]] = []
            for m in sorted((m.start(), m.start() + len(w)) for w in tokens_ or () for m in re.finditer(f"(?={re.escape(w)})", text or "")):
                if found and m[0] <= found[-1]["end"]:
                    found[-1]["end"] = max(found[-1]["end"], m[1])
                else:
                    found.append({"start": m[0], "end": m[1]})
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return ranges(fold(label), F.filter(tokens(query), lambda w: F.length(w) >= 2))


def search(queries: DataFrame, query_key: str, labels: DataFrame, key: str, limit: int, kind: str, distance: Column, in_box: Column) -> DataFrame:
    """The `limit` best labels of each query (column `query`): candidates share a token with it, at most min(100, max(6 * limit, 30)) of them by the
    number of shared tokens and key, then `rank_addresses`. Labels need `label`; tokens meet in an equi join."""
    most = min(100, max(6 * limit, 30))
    q = queries.select(query_key, "query", F.explode(F.array_distinct(F.filter(tokens(F.col("query")), lambda w: F.length(w) >= 2))).alias("token"))
    d = labels.select(key, F.explode(F.array_distinct(tokens(F.col("label")))).alias("token"))
    # a word that very many labels have is dealt to SALTS tasks, so each query's words come once for each of them
    q, d = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), d.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    shared = q.join(d, ["token", "salt"]).groupBy(query_key, "query", key).agg(F.count("*").alias("n"))
    first = shared.withColumn("rn", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("n"), key))).where(F.col("rn") <= most)
    ranked = rank_addresses(first.join(labels, key), key, kind, distance, in_box, limit, query_key)
    return ranked
