"""Ids and further columns keep their values beside null ids, whatever their names; measured cases of files and texts."""

from __future__ import annotations

import datetime as dt
import gzip
import io
import time
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import OPERATORS, brute_cover
from zonaris.llm import decontam, langid, media, minhash, mixing, quality, repeats, sharding

BIG = [None, 9007199254740993, 9007199254740995, -9007199254740993]
SAME = " ".join(f"word{i}" for i in range(60))
TEXTS = ["a text of the null id", SAME, SAME, None]
NAMES = "_size _group _part _rn _p _g _block _before_rows _weight _cycle _turn p_slot p_source _crc _at _doc_id _order_x row group tie k0 at".split()


def docs_of(spark):
    rows = [(i, t, "en", "s", None if k else 2**60 + 1, (2**60 + k, "n"), dt.timedelta(days=k), [k, None], *[f"v{k}"] * len(NAMES)) for k, (i, t) in enumerate(zip(BIG, TEXTS, strict=True))]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, nested struct<a:bigint,b:string>, took interval day to second, many array<int>"
    return spark.createDataFrame(rows, kind + "".join(f", `{n}` string" for n in NAMES))


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(9007199254740993, 1), (9007199254740995, 1), (None, 0)], "doc_id bigint, quality int")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_large_ids_beside_a_null_id(spark, name):
    got = [r["doc_id"] for r in OPERATORS[name](spark, docs_of(spark)).collect()]
    assert sorted(got, key=str) == sorted(BIG, key=str)


def test_op1_keeps_the_link_of_large_ids(spark):
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs_of(spark)).collect()}
    assert got == {None: None, BIG[1]: BIG[1], BIG[2]: BIG[1], BIG[3]: BIG[3]}


def test_op9_large_ids(spark):
    bench = spark.createDataFrame([(9007199254740997, SAME), (None, "x")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs_of(spark), bench).collect()}
    assert got == {(BIG[1], 9007199254740997), (BIG[2], 9007199254740997)}


def test_further_columns_pass_whatever_their_names_and_types(spark, labels):
    docs = docs_of(spark)
    want = sorted(map(repr, docs.collect()))
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == [*docs.columns, "mix_source", "mix_slot", "mix_position"]
    bench = spark.createDataFrame([(1, "words that no document has at all")], "item_id bigint, text string")
    for out in (mixed.select(docs.columns), mixing.in_mix_order(docs), quality.keep_good(docs, labels, 0.0), decontam.drop_leaks(docs, bench)):
        assert sorted(map(repr, out.collect())) == want
    kept = minhash.drop_near_duplicates(docs).collect()
    assert sorted(map(repr, kept)) == sorted(map(repr, docs.where(f"doc_id is null or doc_id <> {BIG[2]}").collect()))
    assert {(r["doc_id"], r["size"]) for r in sharding.shard_documents(docs).collect()} == {(i, len(t or "") + 8) for i, t in zip(BIG, TEXTS, strict=True)}


def test_equal_rows_are_spread_over_shards(spark):
    rows = spark.createDataFrame([(None, "the same text")] * 240, "doc_id bigint, text string")
    got = sharding.shard_documents(rows).collect()
    assert {r["shard"] for r in got} == set(range(24)) and all(r["slot"] < 10 for r in got)


def test_op3_parse_is_greedy_over_whole_texts():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(1, 7))) for _ in range(400)]
    src = " ".join(rng.choice(words, 4000))
    texts = {"a": src[:9000], "b": "x" * 50 + " " + src[-5000:]}
    model = langid.Model(texts)
    seqs = [" ".join(rng.choice(words, n)) for n in (3, 300, 1500)] + ["x" * 3000, "xa" * 1500, "", "abc" * 500 + "z" * 700]
    got = model.parse([model.code[langid.letters(t)] for t in seqs])
    for k, name in enumerate(model.langs):
        source = "".join(map(chr, langid.letters(texts[name])))
        for i, t in enumerate(seqs):
            t, n, at = "".join(map(chr, langid.letters(t))), 0, 0
            while at < len(t):
                size = 1
                while at + size < len(t) and t[at : at + size + 1] in source:
                    size += 1
                n, at = n + 1, at + size
            assert got[i, k] == n


def test_op3_sample_takes_whole_documents(spark):
    rows = [(i, f"text {i} " + "abc " * (i % 50), "en" if i % 3 else "de") for i in range(500)]
    whole = {t for _, t, _ in rows}
    got = langid.train_texts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), 100, 3000)
    assert set(got) == {"en", "de"} and all(len(t) <= 3000 + 100 and set(t.split("\n")) <= whole for t in got.values())


def test_op4_across_the_border_of_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("ab"), repeats.PART + 3000))
    again = text[repeats.PART - 300 : repeats.PART + 300]
    rows = [(1, text), (2, again), (3, text[: 250])]
    want = brute_cover({i: t.encode() for i, t in rows}, 200)
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want


def test_op8_bounds_its_plan(spark):
    with pytest.raises(ValueError):
        mixing.mix_sources(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, source string"), {"a": 1_000_003, "b": 1_000_000})
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 700).alias("source"))
    got = sorted(r["mix_position"] for r in mixing.mix_sources(many, {}, 2).collect())
    assert got == list(range(3000))


def test_op10_zip_members_and_saved_again_pdfs_are_linear():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(4000):
            z.writestr(f"member{i}", b"some bytes " * 180)
    raw, start = out.getvalue(), time.perf_counter()
    assert ("application/zip", 0, len(raw)) in media.sniff(raw) and time.perf_counter() - start < 3
    pdf = b"%PDF-1.4 one %%EOF more %%EOF"
    assert media.sniff(pdf + b"junk") == [("application/pdf", 0, len(pdf))]
    assert media.sniff(pdf + pdf) == [("application/pdf", 0, len(pdf)), ("application/pdf", len(pdf), len(pdf))]
    start = time.perf_counter()
    media.sniff(b"%PDF-" * 400_000)
    assert time.perf_counter() - start < 10
    packed = gzip.compress(b"abc" * 100)
    assert media.sniff(b"x" + raw + packed)[0] == ("application/zip", 1, len(raw))


def test_op10_one_pass_is_the_three_operators(spark):
    docs = spark.createDataFrame(list(zip(BIG, TEXTS, strict=True)), "doc_id bigint, text string")
    one, three = media.text_digests(docs), media.digest_media(media.sniff_media(media.store_texts(docs)))
    assert one.columns == three.columns and sorted(map(repr, one.collect())) == sorted(map(repr, three.collect()))
    assert all(r["tail_crc32"] == zlib.crc32(b"\xff" * 32) for r in one.collect())
