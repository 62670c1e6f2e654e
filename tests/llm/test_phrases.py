"""SentencePiece ids against the library, phrases and infilling against plain Python and SQL."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.oracle import compare, connect
from zonaris.llm import collocations, infill, pieces, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LARGER = "/root/testdata/sf0.01"
EDGES = [(1, None, None), (2, "", "en"), (None, "a b. A B", "en"), (2, "x", None), (9007199254740993, "é漢🙂 <P> b", "en"), (5, "two  words\there\x0bnext\x00one", "de"), (5, "two  words\there\x0bnext\x00one", "de")]
EXTRA = "word words f id block left right seq local names count n form output ids rank lang_x score".split()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    return pieces.Model(MODEL)


def edge_docs(spark, rows=EDGES):
    kind = "doc_id bigint, text string, lang string" + "".join(f", `{n}` string" for n in EXTRA)
    return spark.createDataFrame([(*r, *("v" for _ in EXTRA)) for r in rows], kind)


def ids_of(model, text, **ends):
    return np.frombuffer(model.encode(text, **ends), "<i4").tolist()


def test_op11_ids_are_the_librarys_on_random_texts(model, library):
    rnd = random.Random(11)
    parts = ["a", "b", "e", "t", "h", "▁", " ", "  ", "\n", "é", "漢", "🙂", "\x00", "th", "ing", " the", "ª", "́", "<s>", "<0x0A>", "1", "22", "\t", "　"]
    own = [s.replace("▁", " ") for s in model.id]
    for k in range(3000):
        text = "".join(rnd.choice(parts if k % 2 else own) for _ in range(rnd.randint(0, 30)))
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids_of(model, text, bos=True, eos=True) == want
        assert model.decode(want) == library.decode(want)


def test_op11_decodes_any_ids_as_the_library_does(model, library):
    rnd = random.Random(12)
    for _ in range(3000):
        ids = [rnd.choice((rnd.randrange(32000), rnd.randrange(260), rnd.randrange(3, 259))) for _ in range(rnd.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("text", [" " * 30_011, "a" * 30_000, "ab" * 20_000 + " the", " " * 5001 + "the", "the " * 9000, "漢" * 5000, "\x01" * 5000])
def test_op11_long_spans_and_slices(model, library, text, monkeypatch):
    want = library.encode(text)
    assert ids_of(model, text) == want
    monkeypatch.setattr(pieces, "SLICE_CHARS", 7)
    assert ids_of(model, text[:5000]) == library.encode(text[:5000])


def test_op11_backtracks_over_any_vocabulary():
    """Models whose pieces and scores are drawn at random, with ties and pieces that no merge reaches, against plain merging."""
    rnd = random.Random(13)
    for _ in range(300):
        m = object.__new__(pieces.Model)
        made = {"".join(rnd.choice("abc") for _ in range(rnd.randint(2, 5))) for _ in range(rnd.randint(1, 12))}
        m.score = {**dict.fromkeys(rnd.sample("abc", rnd.randint(1, 3)), 0.0), **{s: float(-rnd.randint(1, 8)) for s in made}}
        m.id = {s: i for i, s in enumerate(m.score)}
        own = sorted({c for s in m._table() for c in s})
        for _ in range(20):
            text = "".join(rnd.choice(own) for _ in range(rnd.randint(1, 25)))
            assert [m.tokens[k] for k in m._span(text)] == m.merged(text)


def test_op11_query_and_edges(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_sentencepiece"](spark, SMALL).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    rows = pieces.encode_documents(edge_docs(spark), MODEL).collect()
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<i4").tolist()), r["decoded"]) for r in rows) == Counter((i, tuple(library.encode(t or "", add_bos=True, add_eos=True)), t or "") for i, t, _ in EDGES)
    assert pieces.encode_documents(edge_docs(spark, []), MODEL).collect() == []
    both = edge_docs(spark).withColumn("ids", pieces.encode_column("text", MODEL)).withColumn("back", pieces.decode_column("ids", MODEL)).collect()
    assert all(r["ids"] == library.encode(r["text"] or "") and r["back"] == (r["text"] or "") for r in both)
    alone = edge_docs(spark).select(F.lit(None).cast("array<int>").alias("ids"))
    assert {r[0] for r in alone.select(pieces.decode_column("ids", MODEL)).collect()} == {""}


def test_op11_refuses_other_models(tmp_path):
    raw = open(MODEL, "rb").read()
    other = tmp_path / "other.model"
    other.write_bytes(raw.replace(b"\x0a\x08identity\x12\x00\x18\x01\x20\x00", b"\x0a\x08identity\x12\x00\x18\x01\x20\x01") + b"\x1a\x02\x20\x01")
    with pytest.raises(ValueError):
        pieces.Model(str(other))


def plain_collocations(rows, most=3, least=10, inside=50, best=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, of in f.items():
        found = []
        known = {p: a for p, a in of.items() if len(p) > 1 and a >= least}
        covered = {p[i : i + k] for p, b in known.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * b >= inside * of[p[i : i + k]]}
        for p, a in known.items():
            if p not in covered:
                score, k = min((1000000 * a * a // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        out |= {(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:best], 1)}
    return out


COLUMNS = "lang rank phrase a l r n score".split()


@pytest.mark.parametrize("block", [1 << 20, 500])
def test_op12_against_plain_python_whatever_the_blocks(spark, block):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(5)
    got = [tuple(r[c] for c in COLUMNS) for r in collocations.collocations(docs, least=4, block_words=block).collect()]
    assert len(got) == len(set(got)) > 100
    assert set(got) == plain_collocations([(r["text"], r["lang"]) for r in docs.collect()], least=4)


@pytest.mark.parametrize(("most", "best"), [(2, 7), (4, 3), (5, 2000)])
def test_op12_longer_phrases_ties_and_few_places(spark, most, best):
    rnd = random.Random(most)
    rows = [(" ".join(rnd.choice("a b c d. e, A é".split()) for _ in range(rnd.randint(0, 60))), rnd.choice(["x", "und", None, ""])) for _ in range(80)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = {tuple(r[c] for c in COLUMNS) for r in collocations.collocations(docs, most, 3, 60, best, 64).collect()}
    assert got == plain_collocations(rows, most, 3, 60, best)


def test_op12_blocks_get_no_names_for_the_last_level(spark, monkeypatch):
    written, plain = [], collocations.materialize
    monkeypatch.setattr(collocations, "materialize", lambda df, name: written.append(name) or plain(df, name))
    docs = spark.createDataFrame([("a b c a b c. b c a b", "x"), ("c a b c", "x"), ("a b", None)], "text string, lang string")
    _, levels = collocations.phrase_names(docs, 3, 2, 8)
    assert not {"known2", "named2"} & set(written) and {"known1", "named1", "names3"} <= set(written)
    word = {r["id"]: r["word"] for r in levels[0].collect()}
    two = {r["id"]: (word[r["left"]], word[r["right"]]) for r in levels[1].collect()}
    assert sorted((*two[r["left"]], two[r["right"]][1], r["f"]) for r in levels[2].collect()) == [("a", "b", "c", 3), ("b", "c", "a", 2), ("c", "a", "b", 3)]


def test_op12_a_task_holds_few_blocks_at_once(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    groups, plans, plain = {}, [], collocations.materialize

    def watched(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        out = plain(df, name)
        files = [f.split(":", 1)[1] for f in out.inputFiles()]
        groups[name] = [pq.ParquetFile("/" + f.lstrip("/")).metadata for f in files]
        return out

    monkeypatch.setattr(collocations, "materialize", watched)
    rows = [(" ".join(f"w{(i * j) % 17}" for j in range(40)), "x") for i in range(60)]
    _, levels = collocations.phrase_names(spark.createDataFrame(rows, "text string, lang string").coalesce(1), 4, 2, 40)
    for name in ("blocks", "named1", "named2"):
        sizes = [m.row_group(i).num_rows for m in groups[name] for i in range(m.num_row_groups)]
        assert sum(sizes) >= 50 and max(sizes) <= collocations.GROUP_BLOCKS
    assert max(m.row_group(i).num_rows for m in groups["names2"] for i in range(m.num_row_groups)) > collocations.GROUP_BLOCKS
    assert not any("collect_list" in p for p in plans) and spark.conf.get("parquet.block.row.count.limit", None) is None


def test_op12_words_of_a_block_that_is_done_are_let_go(monkeypatch):
    import gc

    import pyarrow as pa
    from pyspark import TaskContext

    monkeypatch.setattr(TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    batch = pa.RecordBatch.from_arrays([pa.array([b"a b c d"] * 50), pa.array(["x"] * 50)], names=["text", "lang"])
    gc.collect()
    gc.disable()
    try:
        before = sum(type(x) is collocations.defaultdict for x in gc.get_objects())
        assert len(list(collocations._blocks(4)(iter([batch])))) == 50
        assert sum(type(x) is collocations.defaultdict for x in gc.get_objects()) - before <= 1
    finally:
        gc.enable()


def test_op12_edges(spark):
    docs = edge_docs(spark)
    got = {tuple(r[c] for c in COLUMNS) for r in collocations.collocations(docs, least=1).collect()}
    assert got == plain_collocations([(t, x) for _, t, x in EDGES], least=1)
    assert collocations.collocations(edge_docs(spark, [])).collect() == [] and collocations.collocations(docs).collect() == []


@pytest.mark.parametrize("name", ["op12_collocations", "op13_fill_in_middle"])
@pytest.mark.parametrize("sf_dir", [SMALL, LARGER])
def test_queries_equal_their_sql(spark, name, sf_dir):
    assert compare(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], connect(sf_dir)) == ""


def plain_infill(i, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(text), "plain", None, None, text
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return len(text), *(("spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"))


def test_op13_against_plain_python_and_back(spark):
    rnd = random.Random(14)
    parts = ["a", "é", "漢", "🙂", "<", "<P", "S>", ">", "M", "\n", " ", "<S>"]
    rows = [(i, "".join(rnd.choice(parts[: 11 + (i % 4 == 0)]) for _ in range(rnd.choice([0, 1, 3, 40, 9000]))), "en") for i in range(300)] + EDGES
    out = infill.fill_in_middle(edge_docs(spark, rows)).withColumn("back", infill.restore(F.col("output"), F.col("form")))
    got = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in out.collect())
    assert got == Counter((i, *plain_infill(i, t), t or "") for i, t, _ in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(edge_docs(spark, [])).collect() == []


@pytest.mark.parametrize("unit", [1, 2, 3, 7, 4096])
def test_op13_checkpoints_find_every_code_point(unit):
    text = "aé漢🙂" * 5 + "\x00z"
    index = infill.Checkpoints(text.encode(), unit)
    assert index.n == len(text) and [index.byte_of(k) for k in range(len(text) + 2)] == [len(text[:k].encode()) for k in range(len(text) + 2)]
