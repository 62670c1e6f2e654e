"""One query for each operator, over its whole table with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontam, infill, langid, media, minhash, mixing, pieces, quality, repeats, sharding, tokens, urlrank

Query = Callable[[SparkSession, str], DataFrame]
_CRC_ID = "crc32(cast(cast(doc_id as string) as binary))"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page URLs."""
    return urlrank.filter_urls(_table(spark, sf_dir, "pages"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    texts = langid.train_texts(docs.where(f"doc_id is not null and {_CRC_ID} % 5 <> 0"))
    out = langid.identify(docs, texts)
    return out.select("doc_id", F.expr(f"coalesce({_CRC_ID} % 5 = 0, false)").alias("held_out"), "lang_pred", "score")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings removed from all documents."""
    out = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 contiguous shards of nearly equal bytes."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from those that are not held out."""
    out = quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), f"{_CRC_ID} % 3 <> 1")
    return out.select("doc_id", F.expr(f"coalesce({_CRC_ID} % 3 = 1, false)").alias("held_out"), "score", "predicted")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under the byte-level BPE with 50,257 ids (the .tiktoken file has the .json's vocabulary)."""
    import public_tokenizers

    return tokens.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which all documents are read when sources are mixed to the target weights."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs).select("doc_id", "mix_source", "mix_slot", "mix_position")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents contain."""
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as audio samples, sniffed, read back and digested."""
    return media.text_digests(_table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the byte-fallback merge model with 32,000 pieces, with begin and end ids, and decoded."""
    import public_tokenizers

    out = pieces.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of 2 to 3 words of each language, over all documents."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut and told for filling in the middle, and their texts restored from that."""
    out = infill.fill_in_middle(_table(spark, sf_dir, "documents"))
    back = infill.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of `corpus_pipeline.py`."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_minhash_near_dedup": op1,
    "op2_url_filters": op2,
    "op3_language_id": op3,
    "op4_suffix_dedup": op4,
    "op5_sharding": op5,
    "op6_quality_classifier": op6,
    "op7_token_counts": op7,
    "op8_source_mixing": op8,
    "op9_benchmark_decontamination": op9,
    "op10_media_columns": op10,
    "op11_sentencepiece": op11,
    "op12_collocations": op12,
    "op13_fill_in_middle": op13,
    "pipeline": pipeline,
}

#: crc32 (op5) has no DuckDB form; op1 to op4, op6, op7, op9 to op11 and the pipeline are tested against brute force, held-out accuracy and round trips.
ORACLE_SQL: dict[str, str] = {
    "op8_source_mixing": """
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(source, '') AS s, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id NULLS FIRST) - 1 AS r FROM documents
        ), src AS (
            SELECT s, CAST(CASE s WHEN 'src0' THEN 4 WHEN 'src1' THEN 2 WHEN 'src2' THEN 2 ELSE 1 END AS BIGINT) AS e FROM d GROUP BY s
        ), names AS (
            SELECT list(s ORDER BY s) AS ns, list(e ORDER BY s) AS es, CAST(sum(e) AS BIGINT) AS q FROM src
        ), step(t, done, pick) AS (
            SELECT CAST(0 AS BIGINT), list_transform(es, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM names
            UNION ALL
            SELECT t + 1, list_transform(range(1, len(done) + 1), lambda i: done[i] + CAST(i = p AS BIGINT)), p FROM (
                SELECT t, done, list_min(list_transform(
                    list_filter(range(1, len(done) + 1), lambda i: done[i] < es[i] AND done[i] * q // es[i] <= t),
                    lambda i: ((done[i] + 1) * q + es[i] - 1) // es[i] * 1000000 + i)) % 1000000 AS p
                FROM step, names WHERE t < q) AS x
        ), slots AS (
            SELECT t - 1 AS slot, ns[pick] AS s, done[pick] - 1 AS turn FROM step, names WHERE t > 0
        ), placed AS (
            SELECT doc_id, d.s, r, (r // 16 // e) * q + slot AS mix_slot
            FROM d JOIN src ON d.s = src.s JOIN slots ON slots.s = d.s AND slots.turn = (r // 16) % e, names
        )
        SELECT doc_id, s AS mix_source, mix_slot, row_number() OVER (ORDER BY mix_slot, r) - 1 AS mix_position FROM placed""",
    "op12_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), runs AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
        ), places AS (
            SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM runs
        ), f AS (
            SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
            FROM places, (VALUES (1), (2), (3)) AS ks(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
        ), n AS (
            SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
        ), parts AS (
            SELECT lang, k, phrase, f AS a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10
        ), cuts AS (
            SELECT p.lang, p.k, p.phrase, p.a, p.cut, x.f AS l, y.f AS r,
                CAST(CAST(1000000 AS HUGEINT) * p.a * p.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
            FROM parts AS p
            JOIN f AS x ON x.lang = p.lang AND x.phrase = array_to_string(p.w[1:p.cut], ' ') AND x.k = p.cut
            JOIN f AS y ON y.lang = p.lang AND y.phrase = array_to_string(p.w[p.cut + 1:], ' ') AND y.k = p.k - p.cut
        ), worst AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
        ), inside AS (
            SELECT DISTINCT s.lang, s.phrase FROM worst AS s JOIN worst AS t
            ON s.lang = t.lang AND s.k = 2 AND t.k = 3 AND 100 * t.a >= 50 * s.a
            AND s.phrase IN (array_to_string(string_split(t.phrase, ' ')[1:2], ' '), array_to_string(string_split(t.phrase, ' ')[2:3], ' '))
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
        FROM worst JOIN n USING (lang) ANTI JOIN inside USING (lang, phrase)
        QUALIFY rank <= 2000""",
    "op13_fill_in_middle": """
        WITH hashed AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
        ), drawn AS (
            SELECT doc_id, t, length(t) AS n, CAST('0x' || h[1:8] AS BIGINT) % (length(t) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (length(t) + 1) AS c2,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
                    WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM hashed
        ), cut AS (
            SELECT *, least(c1, c2) AS i, greatest(c1, c2) AS j FROM drawn
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t
                WHEN 'psm' THEN '<P>' || substring(t, 1, i) || '<S>' || substring(t, j + 1) || '<M>' || substring(t, i + 1, j - i)
                ELSE '<S>' || substring(t, j + 1) || '<P>' || substring(t, 1, i) || '<M>' || substring(t, i + 1, j - i) END) AS output_sha256,
            sha256(t) AS restored_sha256
        FROM cut""",
}
