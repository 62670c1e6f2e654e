"""Operators that SQL cannot express against plain versions, and readers on broken input."""

from __future__ import annotations

import hashlib
import io
import math
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from zonaris.functions import legal as T
from zonaris.functions import text
from zonaris.operators import aggregates, filters, graph, registry, studies
from zonaris.plans import catalog, documents
from zonaris.sources import packages as K


def test_logistic_fit_is_that_of_plain_newton(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    y = (rng.uniform(size=300) < 1 / (1 + np.exp(-(0.5 + 1.5 * x[:, 0] - 1.0 * x[:, 1])))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)] + [(None, 1.0, 1)], "a double, b double, y int")
    got = studies.logistic_fit(df, [F.col("a"), F.col("b")], F.col("y"), [0, 0, 0], 1.0, [0, 0, 0])
    z, w = np.column_stack([np.ones(300), x]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(3), z.T @ (y - p) - w)
    assert got == pytest.approx(w.tolist(), abs=1e-8)
    bound = studies.logistic_fit(df, [F.col("a"), F.col("b")], F.col("y"), [0, 0, 0], 1.0, [0, 1, 1])
    z, w = z[:, :2], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(2), z.T @ (y - p) - w)
    assert bound == pytest.approx([*w.tolist(), 0.0], abs=1e-6)


def test_segments_tile_their_texts(spark):
    rows = [(1, "One sentence. " * 300), (2, "x" * 5000), (3, ""), (4, None), (5, "line\n" * 900)]
    df = spark.createDataFrame(rows, "k int, t string")
    for k, t in rows:
        spans = [(r["start"], r["end"]) for r in text.segments(df.where(F.col("k") == k), "k", "t", 700).orderBy("index").collect()]
        t = t or ""
        assert "".join(t[a:b] for a, b in spans) == t and all(0 < b - a <= 700 for a, b in spans)


def test_near_quote_is_the_best_of_all_places():
    def plain(t, q, most):
        best = None
        for a in range(len(t) + 1):
            row = list(range(len(q) + 1))
            for c in t[a:]:
                row = _next(row, q, c)
                if row[-1] <= most and (best is None or (row[-1], a) < best[:2]):
                    best = (row[-1], a)
        return best

    def _next(row, q, c):
        new = [row[0] + 1]
        for i, x in enumerate(q, 1):
            new.append(min(row[i - 1] + (x != c), row[i] + 1, new[i - 1] + 1))
        return new

    rng = np.random.default_rng(4)
    for _ in range(60):
        t = "".join(rng.choice(list("abc"), 40))
        q = "".join(rng.choice(list("abc"), 9))
        got, want = T._near(t, q, 2), plain(t, q, 2)
        assert (got and got["edits"]) == (want and want[0])
    assert T._near("wysokość 12 m", "wysokość 13 m", 2) is None and T._near(None, "x", 1) is None


def test_archives_and_features_that_are_broken(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("/abs.xml", "x"), z.writestr("a/../../b.xml", "x"), z.writestr("ok.xml", "<r/>")
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as z:
        for i in range(K.MEMBERS + 1):
            z.writestr(f"{i}.xml", "")
    found = [(m, r) for m, _, r in K.members_of(out.getvalue(), [".xml"])]
    assert found == [("/abs.xml", "unsafe_path"), ("a/../../b.xml", "unsafe_path"), ("ok.xml", None)]
    assert [r for _, _, r in K.members_of(many.getvalue())] == ["too_many_members"] and [r for _, _, r in K.members_of(b"no")] == ["not_an_archive"]
    assert [f["reason"] for f in K.gml_features(b"<!DOCTYPE x><a/>", "a", False)] == ["document_type"]
    empty = spark.createDataFrame([], "path string, content binary")
    assert K.unzip(empty).collect() == [] and K.read_gml(empty, "a").collect() == [] and K.read_elements(empty, "a", ["b"]).collect() == []


@pytest.mark.parametrize("query", [documents.archive_members, documents.zipped_addresses, documents.gml_features, documents.feature_info])
def test_packages_of_a_small_file_are_made_in_many_tasks(spark, query):
    at = query(spark, SMALL).select(F.spark_partition_id().alias("p")).distinct().count()
    assert at > 1


def test_archives_are_packed_and_read_one_by_one(spark):
    rows = [(f"n{i:03d}", bytes([i]) * 1000) for i in range(200)] + [("n007", b"again"), ("none", None)]
    d = spark.createDataFrame(rows, "name string, content binary")
    z = K.zip_archives(d, "name", "content", 5000)
    packed = z.collect()
    assert len({r["archive"] for r in packed}) == len(packed) >= 33 and max(sum(m["n_bytes"] for m in r["manifest"]) for r in packed) <= 6000
    held = [(n, c) for n, c in rows if c is not None]
    assert sorted((m["name"], m["n_bytes"], m["sha256"]) for r in packed for m in r["manifest"]) == sorted((n, len(c), hashlib.sha256(c).hexdigest()) for n, c in held)
    assert sorted((r["member"], bytes(r["content"])) for r in K.unzip(z.select(F.col("archive").alias("path"), "content")).collect()) == sorted(held)
    plan = z._jdf.queryExecution().optimizedPlan().toString()  # each archive is a group of its own, not a value in a batch of many
    assert "FlatMapGroupsInArrow" in plan and "collect_list" not in plan


def test_members_go_back_in_small_batches():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(3):
            z.writestr(f"{i}.bin", bytes(700_000))
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(10)] + ["none"], "content": [out.getvalue()] * 10 + [None]})
    got = list(K._unpacked([])(iter([batch])))
    assert max(sum(len(c or b"") for c in b.column("content").to_pylist()) for b in got) < K.BATCH_BYTES + 700_000
    found = [(r["path"], r["member"], r["reason"]) for b in got for r in b.to_pylist()]
    assert found == [(str(i), f"{k}.bin", None) for i in range(10) for k in range(3)] + [("none", "", "not_an_archive")]


def test_percentiles_are_exact_and_gather_no_group(spark):
    rng = np.random.default_rng(8)
    groups = {"same": [4.0] * 500, "one": [7.0], "two": [1.0, 2.0], "ties": [5.0] * 300 + list(rng.normal(5, 3, 700)), "wide": list(rng.lognormal(0, 4, 5000)), None: list(rng.integers(0, 9, 800) / 4), "nan": [1.0, 2.0, 3.0, math.nan], "none": [None] * 3}
    rows = [(k, None if v is None else float(v)) for k, vs in groups.items() for v in vs] + [("wide", None)] * 50
    d = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "k string, v double").repartition(6)
    shares = (0.0, 0.1, 0.5, 0.9, 0.999, 1.0)
    want = {r["k"]: r["p"] for r in d.where("v is not null").groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("p")).collect()}
    for near in (0.001, 0.2):
        got = aggregates.percentiles(d, "k", "v", shares, near)
        found = {r["k"]: list(r)[1:] for r in got.collect()}
        assert set(found) == set(want) == set(groups) - {"none"}
        assert all(np.allclose(found[k], want[k], rtol=1e-12, atol=0, equal_nan=True) for k in want)
    plan = catalog.QUERIES["percentiles_r7"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_groups_of_a_chain_and_of_none(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100, 60, -1)] + [(7, 9), (None, 1), (5, 5)], "a int, b int")
    got = {r["node"]: r["leader"] for r in graph.groups(chain, "a", "b").collect()}
    assert got == {**{i: 61 for i in range(61, 102)}, 7: 7, 9: 7, 5: 5}
    assert graph.groups(chain.limit(0), "a", "b").collect() == []


def test_a_limit_is_an_error_not_a_cut(spark):
    d = spark.range(11)
    assert filters.limited(d, 11).count() == 11
    with pytest.raises(ValueError):
        filters.limited(d, 10)


def test_late_input_keeps_the_newest(spark):
    base = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (3, 5, "c")], "k int, version int, body string")
    new = spark.createDataFrame([(1, 4, "x"), (2, 6, "b"), (3, 6, "y"), (3, 7, "z"), (4, 1, "n")], "k int, version int, body string")
    table, log = registry.replayed(base, new, "k", "version", ["body"])
    assert {r["k"]: r["body"] for r in table.collect()} == {1: "a", 2: "b", 3: "z", 4: "n"}
    assert {r["k"]: r["action"] for r in log.collect()} == {1: "stale", 2: "unchanged", 3: "updated", 4: "inserted"}


def test_symbols_refuse_what_is_none():
    of = lambda raw: (T._symbol(raw)["symbol"], T._symbol(raw)["reason"])
    assert of(" 12\u00a0 mn\n") == ("12 mn", None) and of("6.6.MW/U(1),2+3_x-Ż") == ("6.6.MW/U(1),2+3_x-Ż", None) and of("A" * 40)[1] is None
    assert of("\x1cMN") == (None, "control_characters") and of("M\tN") == (None, "control_characters") and of("MN\x85") == (None, "control_characters")
    assert of("МН") == (None, "disallowed_characters") and of("MN;U") == (None, "disallowed_characters") and of("A" * 41) == (None, "too_long") and of(None)[1] == of(" \n")[1] == "empty"
    assert T._symbol("146 MN")["key"] == T._symbol("146mn")["key"] == "146mn"


def test_mentions_are_whole_tokens():
    text = "1MN, 1 MN; MN.1 2MN-3MN (1MN) 1MN/U x1MN 1MN. 1MN\n1mn l MN IMN 11 MN"
    places = lambda s, o=False: [text[m["start"] : m["end"]] for m in T._mentions(text, s, o)]
    assert places("1MN") == ["1MN", "1 MN", "1MN", "1MN", "1MN", "1mn"] and places("MN.1") == ["MN.1"] and places("1MN/U") == ["1MN/U"]
    assert places("MN") == ["MN"] and places("1MN", True) == ["1MN", "1 MN", "1MN", "1MN", "1MN", "1mn", "IMN"] and places("") == []


def test_normal_texts_take_time_in_proportion():
    import time

    text = "słowo-\nkolejne  i\u00adnne " * 40_000
    start = time.perf_counter()
    got = T._normalized(text)
    assert time.perf_counter() - start < 3 and got["text"].startswith("słowokolejne inne słowo") and got["flags"] == ["hyphen", "soft_hyphen", "spaces"]
    assert all(text[p] == c or c == " " for p, c in zip(got["places"], got["text"], strict=True))


def test_paths_that_lead_out_of_an_archive():
    assert [K.safe_name(n) for n in ("a/b.xml", "./a//b.xml", "a\\b.xml", "a..b/c")] == ["a/b.xml", "a/b.xml", "a/b.xml", "a..b/c"]
    assert [K.safe_name(n) for n in ("/a", "\\a", "a/../b", "..", "C:\\x", "c:x", "", ".", "a\x00b", "a\\..\\b")] == [None] * 10
