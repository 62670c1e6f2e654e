"""The ten operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import io
import math
import re
import wave
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.oracle import compare, connect
from zonaris.llm import decontam, langid, media, minhash, mixing, prefix, quality, queries, repeats, sharding, tokens, urlrank
from zonaris.llm.textkit import plain_words

LARGER = "/root/testdata/sf0.01"


def texts_of(sf_dir: str = SMALL) -> dict[int, str | None]:
    return dict(duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall())


def brute_classes(texts: dict[int, str | None], threshold: float = 0.8) -> dict[int, int]:
    bags = {}
    for i, t in texts.items():
        w = plain_words(t)
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    of = {i: i for i in texts}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    ids = sorted(i for i in texts if bags[i])
    size = {i: sum(bags[i].values()) for i in ids}
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if min(size[a], size[b]) >= threshold * max(size[a], size[b]):
                both = sum((bags[a] & bags[b]).values())
                if both / (size[a] + size[b] - both) >= threshold:
                    p, q = sorted((root(a), root(b)))
                    of[q] = p
    return {i: root(i) for i in texts}


def test_op1_classes_are_those_of_all_pairs(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_minhash_near_dedup"](spark, SMALL).collect()}
    want = brute_classes(texts_of())
    assert {i: r["class_id"] for i, r in got.items()} == want
    alone = Counter(want.values())
    assert all(r["n_links"] == 0 for i, r in got.items() if alone[want[i]] == 1)


def test_op1_estimates_the_weighted_similarity():
    a = " ".join(f"w{i % 40}" for i in range(400))
    b = " ".join(f"w{i % 40}" for i in range(250)) + " " + " ".join(f"v{i}" for i in range(150))
    t, h, c = minhash.multisets([a, b])
    reg = minhash.bag_min_hash(t, h, c, 2, 4096)
    x, y = (dict(zip(h[t == k].tolist(), c[t == k].tolist(), strict=True)) for k in (0, 1))
    both = sum(min(n, y.get(k, 0)) for k, n in x.items())
    assert abs((reg[0] == reg[1]).mean() - both / (sum(x.values()) + sum(y.values()) - both)) < 0.03


def test_op1_a_chain_of_copies_and_copies_of_a_copy(spark):
    words = [f"word{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:198], "x", "y"])), (3, " ".join(words)), (4, "a b"), (5, "A b."), (6, None), (7, "")]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}
    kept = {r["doc_id"] for r in minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {1, 4, 6, 7}


def test_op2_contract_and_ranks_against_dense_iteration(spark):
    pages = duckdb.sql(f"select page_id, url, html from '{SMALL}/pages.parquet'").fetchall()
    got = {r["page_id"]: r for r in queries.QUERIES["op2_url_filters"](spark, SMALL).collect()}
    assert len(got) == len(pages)
    import re

    def parse(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]

    def rule(host, path):
        fit = [(len(h) + len(p), h + p, v) for v, h, p in urlrank.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1:] if fit else None

    hosts = {parse(u)[0] for _, u, _ in pages} - {""}
    name = re.compile(urlrank.NAME.replace("\\\\", "\\"))
    edge, votes = Counter(), defaultdict(Counter)
    for i, url, html in pages:
        host, path = parse(url)
        r = rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, r and r[0])
        if r:
            assert got[i]["verdict"] == r[1]
            if host:
                votes[host][r[1]] += 1
        if host:
            for d in {x.translate(str.maketrans(urlrank._UPPER, urlrank._LOWER)) for x in set(name.findall(html or ""))} - {host}:
                if d in hosts:
                    edge[host, d] += sum(1 for x in set(name.findall(html)) if x.lower() == d)
    for h in hosts:
        if h.count(".") > 1:
            edge[h, h.split(".", 1)[1]] += 1
    nodes = sorted(hosts | {b for _, b in edge})
    at = {h: k for k, h in enumerate(nodes)}
    ranks = {}
    for side in ("allow", "block"):
        seed, w = np.zeros(len(nodes)), np.zeros((len(nodes), len(nodes)))
        for h, v in votes.items():
            seed[at[h]] = v[side] / sum(v.values())
        seed /= max(seed.sum(), 1e-300)
        for (a, b), n in edge.items():
            a, b = (a, b) if side == "allow" else (b, a)
            w[at[b], at[a]] += n
        w /= np.maximum(w.sum(0), 1e-300)
        x = seed
        for _ in range(urlrank.STEPS):
            y = urlrank.DAMPING * (w @ x)
            x = y + seed * (1 - y.sum())
        ranks[side] = x
    for i, url, _ in pages:
        host = parse(url)[0]
        if host:
            assert got[i]["trust"] == pytest.approx(ranks["allow"][at[host]], abs=1e-9)
            assert got[i]["distrust"] == pytest.approx(ranks["block"][at[host]], abs=1e-9)


def test_op3_held_out_accuracy_and_blindness(spark):
    lang = dict(duckdb.sql(f"select doc_id, lang from '{LARGER}/documents.parquet'").fetchall())
    got = queries.QUERIES["op3_language_id"](spark, LARGER).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r["held_out"] and lang[r["doc_id"]] is not None and r["lang_pred"] != "und"]
    assert {r["doc_id"] for r in got if r["held_out"]} == {i for i in lang if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_op3_phrases_are_greedy_longest_matches():
    model = langid.Model({"x": "abcab", "y": "zz"})
    src = " abcab "

    def greedy(t):
        n, at = 0, 0
        while at < len(t):
            k = 1
            while at + k < len(t) + 1 and t[at : at + k] in src and k <= len(t) - at:
                k += 1
            at += max(1, k - 1)
            n += 1
        return n

    for t in ("abcab", "cabx", "zzab", "bca abc"):
        codes = model.code[langid.letters(t)]
        assert model.phrases(codes[:, None])[0, 0] == greedy(f" {t} ".replace("  ", " "))


def test_op3_every_letter_of_a_large_alphabet_counts():
    rng = np.random.default_rng(5)
    one, two = (["".join(chr(c) for c in rng.integers(0x4E00 + k, 0x4E00 + k + 3000, 3)) for _ in range(1500)] for k in (0, 1500))
    texts = {"one": " ".join(rng.choice(one, 6000)), "two": " ".join(rng.choice(two, 4000)), "latin": "some words in plain letters " * 100}
    model = langid.Model(texts)
    tests = [(k, " ".join(rng.choice(w, 4))) for k, w in (("one", one), ("two", two)) for _ in range(100)]
    got = model.predict([t for _, t in tests])
    assert sum(k == g for (k, _), (g, _) in zip(tests, got, strict=True)) >= 198
    src = langid.letters(texts["one"]).astype("<u4").tobytes().decode("utf-32-le")
    t = "".join(src[a : a + 7] for a in range(0, 500, 50)) + "".join(map(chr, range(0x3041, 0x3050)))
    n, at, t = 0, 0, langid.letters(t).astype("<u4").tobytes().decode("utf-32-le")
    while at < len(t):
        size = next((k for k in range(len(t) - at, 0, -1) if t[at : at + k] in src), 1)
        n, at = n + 1, at + size
    assert model.phrases(model.code[langid.letters(t)][:, None])[0, model.langs.index("one")] == n


def brute_cover(texts: dict[int, bytes], length: int) -> dict[int, list[tuple[int, int]]]:
    seen = Counter(hash(b[k : k + length]) for b in texts.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in texts.items():
        gone = bytearray(len(b) + 1)
        for k in range(len(b) - length + 1):
            if seen[hash(b[k : k + length])] > 1:
                gone[k : k + length] = b"\1" * length
        out[i] = [m.span() for m in re.finditer(b"\1+", gone)]
    return out


def test_op4_removes_what_brute_force_removes(spark):
    raw = {i: (t or "").encode() for i, t in texts_of().items()}
    want = brute_cover(raw, 200)
    for r in queries.QUERIES["op4_suffix_dedup"](spark, SMALL).collect():
        b, spans = raw[r["doc_id"]], want[r["doc_id"]]
        kept = b"".join(b[p:q] for p, q in zip([0, *(x[1] for x in spans)], [*(x[0] for x in spans), len(b)], strict=True))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(b), sum(y - x for x, y in spans), len(spans))
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_op4_small_alphabets_runs_and_shifts(spark, seed):
    rng = np.random.default_rng(seed)
    base = "".join(rng.choice(list("abc"), 3000))
    rows = [(1, base[:700] + "é" * 150), (2, "x" * 450), (3, base[100:420] + base[1000:1230]), (4, base[1000:1199]), (5, base[999:1200] + "ab" * 300), (6, "x" * 199)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    raw = {i: t.encode() for i, t in rows}
    want = brute_cover(raw, 200)
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in repeats.remove_repeats(docs).collect()}
    assert got == want


def test_op5_shards_are_the_cuts_of_the_byte_order(spark):
    got = sorted(queries.QUERIES["op5_sharding"](spark, LARGER).collect(), key=lambda r: r["doc_id"])
    texts = texts_of(LARGER)
    size = {i: len((t or "").encode()) + 8 for i, t in texts.items()}
    total, before, slots = sum(size.values()), 0, Counter()
    for r in got:
        s = before * 24 // total
        assert (r["size"], r["shard"], r["slot"], r["law"], r["grown_shard"]) == (size[r["doc_id"]], s, slots[s], "bytes", None)
        assert r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode())
        slots[s] += 1
        before += size[r["doc_id"]]
    assert before == total and len(got) == len(texts)


def test_op6_held_out_accuracy(spark):
    label = dict(duckdb.sql(f"select doc_id, quality from '{LARGER}/labels.parquet'").fetchall())
    got = queries.QUERIES["op6_quality_classifier"](spark, LARGER).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and label.get(r["doc_id"]) is not None]
    share = sum(r["predicted"] == label[r["doc_id"]] for r in held) / len(held)
    most = max(Counter(label[r["doc_id"]] for r in held).values()) / len(held)
    assert share >= 0.9 and share >= most


def test_op6_isotonic_is_the_least_squares_monotone_fit():
    y, w = np.array([0.1, 0.5, 0.2, 0.2, 0.9, 0.8]), np.array([1.0, 2, 1, 1, 3, 1])
    assert quality.isotonic(y, w) == pytest.approx([0.1, 0.35, 0.35, 0.35, 0.875, 0.875])


def test_op7_counts_are_the_tokenizers_library_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*texts_of().items(), (-1, "a<|endoftext|>b <|endoftext|> "), (-2, " " * 70_000 + "a\r\n\n b"), (-3, "x 　y " * 20_000), (-4, "I'll don't 'S １２3")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),)).collect()}
    for i, t in rows:
        n = len(tk.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 512)


def test_op8_is_its_sql(spark):
    assert compare(queries.QUERIES["op8_source_mixing"](spark, LARGER), queries.ORACLE_SQL["op8_source_mixing"], connect(LARGER)) == ""


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 3, "b": 2, "c": 1}, {"a": 7, "b": 5, "c": 5, "d": 1, "e": 9}])
def test_op8_deviates_by_less_than_a_block(weights):
    cycle, q = mixing.pattern(weights), sum(weights.values())
    done = Counter()
    for t, s in enumerate(cycle * 3, 1):
        done[s] += 1
        assert all(abs(done[x] - t * w / q) < 1 for x, w in weights.items())


def test_op8_mix_order_is_what_is_stored(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    at = {r["doc_id"]: r["mix_position"] for r in mixing.mix_sources(docs).collect()}
    assert sorted(at.values()) == list(range(len(at)))
    mixing.in_mix_order(docs).write.parquet(str(tmp_path / "mixed"))
    stored = spark.read.parquet(str(tmp_path / "mixed")).select("*", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()
    assert [r["doc_id"] for r in stored] == sorted(at, key=at.get)


def test_op9_finds_planted_and_reworded_items_only(spark):
    item = "In the long walk problem Anna buys 12 apples for 3 dollars each and gives 5 apples to Boris before noon. How many apples are left now?"
    other = item.replace("Anna", "Clara").replace("12", "40").replace("5 apples", "9 apples")
    mixed = "In the long walk problem Anna buys 12 apples. Later on she went home and never gave a single one of them to anybody else at all."
    filler = "Some clean words stand here without any link to the question. " * 30
    docs = spark.createDataFrame([(1, filler + item + filler), (2, filler + other), (3, filler), (4, mixed), (5, None), (6, ""), (None, item)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, "short")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["reworded"] for r in decontam.leaks(docs, bench).collect()}
    assert got == {(1, 10): False, (2, 10): True, (None, 10): False}
    assert {r["doc_id"] for r in decontam.drop_leaks(docs, bench).collect()} == {3, 4, 5, 6, None}
    every = {(r["doc_id"], r["item_id"]): r["reworded"] for r in decontam.leaks(docs, bench, filter_windows=0).collect()}
    assert every == got


QUESTION = "In the long walk problem Anna buys 12 apples for 3 dollars each and gives 5 apples to Boris before noon. How many apples are left now?"


def leaks_of(spark, texts: dict[int, str], items: dict[int, str] | None = None) -> dict[tuple[int, int], tuple[float, bool]]:
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id bigint, text string")
    bench = spark.createDataFrame(sorted((items or {10: QUESTION}).items()), "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]): (r["coverage"], r["reworded"]) for r in decontam.leaks(docs, bench).collect()}


def test_op9_judges_each_copy_by_itself(spark):
    one = QUESTION.replace("Anna", "Clara").replace("12", "40").replace("5 apples", "9 apples").replace("3 dollars", "8 dollars")
    two = QUESTION.replace("Boris", "David").replace("12", "77").replace("5 apples", "6 apples").replace("3 dollars", "2 dollars")
    longer = one.replace("buys 40", "now gladly buys 40")
    outvoting = " ".join(f"In the long walk problem Anna buys {k} apples for {k} dollars each and leaves again." for k in [90] * 3 + list(range(100, 120)))
    spread = " ".join(f"Then she gives {k} apples to Emil before noon." for k in range(20))
    texts = {1: f"{one} {two}", 2: f"{QUESTION} {one} {two}", 3: f"{outvoting} {spread} {QUESTION} {spread}", 4: f"{two} {longer}", 5: f"{outvoting} {spread}"}
    got = leaks_of(spark, texts)
    assert {d: r for (d, _), (_, r) in got.items()} == {1: True, 2: False, 3: False, 4: True}
    assert [got[d, 10][0] for d in (1, 2, 3)] == [1.0] * 3


def test_op9_finds_named_items_whatever_the_capitals_around(spark):
    filler = "Some clean words stand here without any link to the question. " * 5
    changed = QUESTION.replace("12", "40").replace("5 apples", "9 apples")
    texts = {1: f"{filler.title()} {QUESTION} {filler.title()}", 2: f"{filler.upper()} {QUESTION}", 3: QUESTION.lower(), 4: QUESTION.upper(), 5: f"{filler} {changed.lower()}", 6: QUESTION, 7: filler.title()}
    got = leaks_of(spark, texts)
    assert got == {(d, 10): (1.0, d == 5) for d in range(1, 7)}
    assert leaks_of(spark, {1: f"{filler} {QUESTION}"}, {10: QUESTION.title()}) == {(1, 10): (1.0, False)}


def test_op9_finds_short_items_and_items_of_numbers(spark):
    items = {10: "Boris", 11: "How many apples?", 12: "12 + 17 = 29", 13: "12 17 29 41 53 67 71 83 97 10", 14: "Is 7 9 11 13 15 17 19", 15: "Who was Ada?", 16: "... !"}
    filler = "Some clean words stand here without any link to the question. " * 5
    texts = {i: f"{filler} so {x} {filler}" for i, x in items.items()}
    texts |= {20: "how apples many", 21: "17 12 29 53 41 67 83 71", 22: "", 23: "WHO WAS ADA", 24: f"{filler} 12 17 29 {filler} 12 17 29", 25: "is 7 9 11 13 15 17 20"}
    got = leaks_of(spark, texts, items)
    assert got == {x: (1.0, False) for x in [*((i, i) for i in range(10, 16)), (23, 15), (24, 12), (13, 12)]}


def test_op9_finds_every_verbatim_item(spark):
    items = dict(duckdb.sql(f"select item_id, text from '{SMALL}/benchmark.parquet'").fetchall())
    want = {(d, i) for d, t in texts_of().items() for i, x in items.items() if x and len(plain_words(x)) >= 8 and x in (t or "")}
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op9_benchmark_decontamination"](spark, SMALL).collect()}
    assert want and want <= got


def test_op10_round_trip(spark):
    texts = texts_of()
    for r in queries.QUERIES["op10_media_columns"](spark, SMALL).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000), w.writeframes(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-32:]), len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())
        assert r["feature"].startswith("audio/wav;")


def test_op10_sniffs_corrects_and_carves(spark):
    import gzip
    import struct

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gz = gzip.compress(b"abc" * 100)
    bad = png[:-6] + b"\0" * 6
    rows = [(1, png, "image/gif"), (2, b"junk" + png + b"--" + gz + b"tail", "text/plain"), (3, bad, "image/png"), (4, None, "x"), (5, b"", "y")]
    got = {r["id"]: r for r in media.sniff_media(spark.createDataFrame(rows, "id bigint, media binary, declared string"), carve=True).collect()}
    assert (got[1]["type"], got[1]["corrected"]) == ("image/png", True)
    assert [(x["type"], bytes(x["data"])) for x in got[2]["embedded"]] == [("image/png", png), ("application/gzip", gz)]
    assert not got[3]["corrected"] and not got[3]["embedded"] and got[4]["type"] == "x" and got[5]["type"] == "y"


def test_prefix_sums_by_group(spark):
    rows = [(i % 3, i, i * i) for i in range(500)]
    got = prefix.prefix_sums(spark.createDataFrame(rows, "g int, k int, s bigint"), [F.col("k")], F.col("s"), F.col("g")).collect()
    for r in got:
        before = [x for x in rows if x[0] == r["g"] and x[1] < r["k"]]
        assert (r["_before_rows"], r["_before_size"]) == (len(before), sum(x[2] for x in before))


EDGE = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, key string, item string, n int, comp string, size string, shard string, rows string, spans string, rank string, html string, quality string"
LONG = " ".join(f"w{i % 977}" for i in range(120_000))
ROWS = [(None, None), (None, "tie of a null id"), (1, ""), (2, "twice the same row here"), (2, "twice the same row here"), (3, LONG), (4, "tie of a null id"), (5, "...!?\n\n"), (6, "日本語 テキスト"), (7, "x" * 100_000), (2, "another text of a used id")]


def edge_docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, None, None if i == 1 else "s", None, *[""] * 3, 1, *[""] * 8) for i, t in rows], EDGE)


def labels_of(spark):
    return spark.createDataFrame([(3, 1, 0), (3, 0, 0), (1, 0, None), (None, 1, 0), (7, None, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")


def bench_of(spark):
    return spark.createDataFrame([(1, None), (None, "w1 w2 w3 w4 w5 w6 w7 w8"), (2, "")], "item_id bigint, text string")


OPERATORS = {
    "op1": lambda s, d: minhash.near_duplicates(d),
    "op3": lambda s, d: langid.identify(d, langid.train_texts(d.withColumn("lang", F.lit("en")))),
    "op4": lambda s, d: repeats.remove_repeats(d),
    "op5": lambda s, d: sharding.shard_documents(d),
    "op6": lambda s, d: quality.score_documents(d, labels_of(s)),
    "op7": lambda s, d: tokens.count_tokens(d, __import__("public_tokenizers").path("byte_bpe_50k.tiktoken"), __import__("public_tokenizers").PATTERN),
    "op8": lambda s, d: mixing.mix_sources(d),
    "op10": lambda s, d: media.digest_media(media.sniff_media(media.store_texts(d))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edges_one_row_for_each_row(spark, name):
    got = OPERATORS[name](spark, edge_docs(spark)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables_give_no_rows(spark, name):
    assert OPERATORS[name](spark, edge_docs(spark, [])).collect() == []


def test_op2_op9_edges(spark):
    pages = spark.createDataFrame([(1, None, None, ""), (2, "no scheme", "", ""), (3, "http://", "x", ""), (3, "http://", "x", ""), (None, "https://A.Example.ORG/es/x?y#z", None, "")], "page_id bigint, url string, html string, host string")
    got = {r["page_id"]: r for r in urlrank.filter_urls(pages).collect()}
    assert (got[None]["host"], got[None]["path"], got[None]["rule"], got[None]["verdict"]) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert all((got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == ("", "", None, "allow") for i in (1, 2, 3))
    assert urlrank.filter_urls(pages).count() == 5 and urlrank.filter_urls(pages.limit(0)).collect() == []
    docs = edge_docs(spark)
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench_of(spark)).collect()} == {(3, None)}
    assert decontam.leaks(docs, bench_of(spark).limit(0)).collect() == [] and decontam.leaks(docs.limit(0), bench_of(spark)).collect() == []


@pytest.mark.parametrize("rows", [ROWS, []])
def test_pipeline_stages_take_edges(spark, rows, tmp_path):
    import corpus_pipeline

    labels_of(spark).write.parquet(str(tmp_path / "labels.parquet"))
    bench_of(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    edge_docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sharding":
            assert out.columns == docs.columns
        assert out.count() <= docs.count()


def test_pipeline_against_its_stages_by_brute_force(spark):
    import corpus_pipeline

    texts = texts_of()
    label = spark.read.parquet(f"{SMALL}/labels.parquet")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = {r["doc_id"] for r in quality.score_documents(docs, label).collect() if r["score"] >= 0.5}
    classes = brute_classes({i: texts[i] for i in good})
    kept = {i for i, c in classes.items() if i == c}
    bad = {r["doc_id"] for r in decontam.leaks(docs.where(F.col("doc_id").isin(sorted(kept))), spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    kept -= bad
    at = {r["doc_id"]: r["mix_position"] for r in mixing.mix_sources(docs.where(F.col("doc_id").isin(sorted(kept)))).collect()}
    size = {i: len((texts[i] or "").encode()) + 8 for i in kept}
    before, total, want = 0, sum(size.values()), {}
    for i in sorted(kept, key=at.get):
        want[i] = before * 24 // total
        before += size[i]
    assert {r["doc_id"]: r["shard"] for r in corpus_pipeline.run(spark, SMALL).collect()} == want and math.isfinite(total)
