"""Grids in blocks against cells, profiles against dense sampling, budgets against a loop, imports that fail half way."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonaris.operators import blocks as B
from zonaris.operators import budgets as U
from zonaris.operators import raster, studies
from zonaris.operators import releases as R
from zonaris.sources import shared


def ground(rng, n, missing=0.02):
    """Cells (i, j, z) of hilly ground from -5 on, some without a value."""
    out = []
    for i in range(-5, n):
        for j in range(-5, n):
            z = 20 * np.sin(i / 9) + 15 * np.cos(j / 7) + (12 if j > 20 else 0)
            out.append((i, j, None if rng.random() < missing else float(z)))
    return out


@pytest.mark.parametrize("n", [1, 4, 7, 64])
def test_slopes_of_blocks_are_those_of_cells(spark, n):
    cells = spark.createDataFrame(ground(np.random.default_rng(n), 20), "i bigint, j bigint, z double")
    blocks = B.blocks_of(cells, n)
    got = {(r["i"], r["j"]): r["z"] for r in B.cells_of(B.slopes(blocks, n), n, "slope").collect()}
    want = {(r["i"], r["j"]): r["slope"] for r in raster.gradient(cells, "i", "j", "z").where("slope is not null").collect()}
    assert got == pytest.approx(want, abs=1e-9) and len(want) > 100
    back = {(r["i"], r["j"]): r["z"] for r in B.cells_of(blocks, n).collect()}
    assert back == {(i, j): z for i, j, z in cells.collect() if z is not None}
    assert B.slopes(B.blocks_of(cells.limit(0), n), n).collect() == []


def _leaves(plan):
    seq = plan.collectLeaves()
    return [seq.apply(i) for i in range(seq.size())]


def test_a_window_reads_only_its_blocks(spark, tmp_path):
    n = 2
    cells = spark.range(0, 64 * 64).select(F.floor(F.col("id") / 64).alias("i"), (F.col("id") % 64).alias("j"), F.col("id").cast("double").alias("z"))
    path = str(tmp_path / "grid")
    B.write_blocks(B.blocks_of(cells, n), path)
    d = B.window(spark, path, 17, 3, 20, 15, n)
    assert {(r["bi"], r["bj"]) for r in d.collect()} == {(a, b) for a in range(8, 11) for b in range(1, 8)}
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "fi" in plan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: [" in plan
    scan = next(s for s in _leaves(d._jdf.queryExecution().executedPlan()) if "Scan" in s.nodeName())
    d.write.format("noop").mode("overwrite").save()
    assert scan.selectedPartitions().totalNumberOfFiles() == 1  # of 16 folders
    assert B.window(spark, path, 1000, 1000, 1001, 1001, n).collect() == []


def test_samples_of_blocks_are_those_of_cells(spark):
    rng = np.random.default_rng(3)
    cells = spark.createDataFrame(ground(rng, 25, 0.05), "i bigint, j bigint, z double")
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-6, 26, (300, 2)))] + [(900, 3.0, 4.0), (901, 24.0, 24.0)], "k int, x double, y double")
    got = {r["k"]: r["z"] for r in B.samples(points, B.blocks_of(cells, 6), 6, ["k"]).collect()}
    want = {r["k"]: r["z"] for r in studies.bilinear(points, cells.where("z is not null"), "k").collect()}
    assert got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) for k in want)
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx({k: v for k, v in want.items() if v is not None}, abs=1e-9)


def test_profiles_are_within_the_bound_of_dense_sampling(spark):
    cells = spark.createDataFrame(ground(np.random.default_rng(1), 60, 0), "i bigint, j bigint, z double")
    blocks = B.blocks_of(cells, 8)
    lines = spark.createDataFrame([(1, 0.0, 0.0, 55.0, 40.0), (2, 5.0, 50.0, 5.0, 2.0), (3, 7.0, 7.0, 7.0, 7.0), (4, None, 1.0, 2.0, 3.0), (5, -20.0, 3.0, 30.0, 3.0)], "k int, x0 double, y0 double, x1 double, y1 double")
    tolerance, least = 0.5, 0.05
    got = {}
    for r in B.profiles(lines, blocks, 8, "k", tolerance, 2.0, least).collect():
        got.setdefault(r["k"], []).append((r["t"], r["z"]))
    assert got.keys() == {1, 2, 3, 5} and got[3][0][1] is not None
    z = {(r["i"], r["j"]): r["z"] for r in cells.collect()}

    def at(x, y):
        i, j = int(np.floor(y)), int(np.floor(x))
        need = [((i + a, j + b), (1 - abs(y - i - a)) * (1 - abs(x - j - b))) for a in (0, 1) for b in (0, 1)]
        need = [(c, w) for c, w in need if w > 0]
        return None if any(c not in z for c, _ in need) else sum(z[c] * w for c, w in need)

    for k, x0, y0, x1, y1 in [(1, 0, 0, 55, 40), (2, 5, 50, 5, 2), (5, -20, 3, 30, 3)]:
        ts, zs = zip(*[(t, v) for t, v in sorted(got[k]) if v is not None], strict=True)
        gap = least / np.hypot(x1 - x0, y1 - y0)
        for t in np.linspace(0, 1, 1500):
            real = at(x0 + (x1 - x0) * t, y0 + (y1 - y0) * t)
            near = min(abs(t - u) for u in ts)
            if real is not None and ts[0] + gap <= t <= ts[-1] - gap:
                assert abs(np.interp(t, ts, zs) - real) <= 2 * tolerance + 1e-9, (k, t)
            elif real is not None:
                assert near <= 2 * gap or ts[0] <= t <= ts[-1]
    steep = [t * 55 for t, _ in sorted(got[1]) if 18 < t * 55 < 23]
    flat = [t * 55 for t, _ in sorted(got[1]) if 40 < t * 55 < 45]
    assert len(steep) > len(flat)  # points are denser at the step


def plain_budget(rows, limits, ttl):
    """Entries one after another, all reservations looked through each time."""
    out, seen, spent, open_ = {}, set(), {}, {}
    for budget, entry, at, kind, ref, amount in sorted(rows, key=lambda r: (r[2], r[1])):
        if (budget, entry) in seen:
            continue
        seen.add((budget, entry))
        held = open_.setdefault(budget, {})
        for r in [r for r, (_, end) in held.items() if end <= at]:
            del held[r]
        total = lambda: sum(a for a, _ in held.values())  # noqa: B023, E731
        if kind == "reserve":
            if ref in held:
                what = "already_reserved"
            elif spent.get(budget, 0) + total() + amount > limits.get(budget, 0):
                what = "refused"
            else:
                held[ref] = (amount, at + ttl)
                what = "admitted"
        else:
            known = held.pop(ref, None)
            what = ("released" if known else "nothing_reserved") if kind == "release" else ("settled" if known else "settled_late")
            if kind == "settle":
                spent[budget] = spent.get(budget, 0) + amount
        out[budget, entry] = (what, spent.get(budget, 0), total())
    return out


@pytest.mark.parametrize("seed", range(3))
def test_budgets_are_those_of_a_loop_and_replays_change_nothing(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["a", "b", None]), k, rnd.randint(0, 300), rnd.choice(["reserve"] * 3 + ["settle", "release"]), f"r{rnd.randint(0, 9)}", rnd.randint(0, 40)) for k in range(400)]
    limits = {"a": 900, "b": 500}
    kind = "budget string, entry int, at bigint, kind string, ref string, amount int"
    l = spark.createDataFrame(list(limits.items()), "budget string, amount_limit int")  # noqa: E741
    of = lambda d: {(r["budget"], r["entry"]): (r["outcome"], int(r["spent"]), int(r["held"])) for r in U.admitted(d, l, 30).collect()}
    got = of(spark.createDataFrame(rows, kind).repartition(5))
    want = plain_budget(rows, limits, 30)
    assert got == want and {"admitted", "refused", "settled", "settled_late", "released"} <= {w[0] for w in want.values()}
    assert of(spark.createDataFrame(rows + rows[:200], kind).repartition(7)) == got
    money = spark.createDataFrame([("a", 1, 0, "reserve", "x", "0.1"), ("a", 2, 0, "reserve", "y", "0.2"), ("a", 3, 0, "reserve", "z", "0.0001")], "budget string, entry int, at int, kind string, ref string, amount string")
    assert {r["entry"]: r["outcome"] for r in U.admitted(money, spark.createDataFrame([("a", "0.3")], "budget string, amount_limit string"), 5).collect()} == {1: "admitted", 2: "admitted", 3: "refused"}
    assert U.admitted(money.limit(0), l, 5).collect() == []


def tables(spark, n, bad=0):
    zones = spark.createDataFrame([(k if k >= bad else None, f"z{k}", float(k)) for k in range(n)], "id int, name string, area double")
    return {"zones": zones, "acts": spark.createDataFrame([(1, "x")], "id int, name string")}


def test_imports_are_shown_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/store"
    rules = {"zones": [("missing_id", F.col("id").isNull()), ("no_area", F.col("area") < 0)]}
    gate = R.Gate(rejected=0.3, required=("zones",), loss=0.1, floor=2)
    run = lambda t, **k: R.run_import(spark, root, t, rules, gate, **k)
    names = lambda number=None: {r["name"] for r in R.read(spark, root, "zones", number).collect()}
    assert R.shown(spark, root) is None
    with pytest.raises(LookupError):
        R.read(spark, root, "zones")
    first = run(tables(spark, 20, bad=2))
    assert (first.status, first.number, first.layers["zones"]) == ("activated", 1, {"read": 20, "accepted": 18, "missing_id": 2})
    assert names() == {f"z{k}" for k in range(2, 20)} and {r["reject_reason"] for r in R.rejects(spark, root, "zones").collect()} == {"missing_id"}
    again = run({n: t.repartition(4) for n, t in tables(spark, 20, bad=2).items()})
    assert (again.status, again.number) == ("unchanged", 1) and list(R.manifests(spark, root)) == [1]
    for wrong, why in ((tables(spark, 20, bad=9), "too many rejected"), (tables(spark, 12), "lost too many"), ({"acts": tables(spark, 1)["acts"]}, "empty")):
        refused = run(wrong)
        assert refused.status == "refused" and any(why in r for r in refused.reasons) and names() == {f"z{k}" for k in range(2, 20)}
    assert run(tables(spark, 12), force=True).number == 2 and len(names()) == 12 and len(names(1)) == 18
    monkeypatch.setattr(R, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        run(tables(spark, 14))
    monkeypatch.undo()
    assert R.shown(spark, root)["number"] == 2 and len(names()) == 12
    third = run(tables(spark, 14))
    assert third.number == 3 and len(names()) == 14
    assert R.roll_back(spark, root).number == 4 and len(names()) == 12
    assert R.roll_back(spark, root).number == 5 and len(names()) == 18
    with pytest.raises(LookupError):
        R.roll_back(spark, root)
    assert R.roll_back(spark, root, 3).number == 6 and len(names()) == 14 and len(names(4)) == 12
    with pytest.raises(LookupError):
        R.read(spark, root, "zones", 99)
    with pytest.raises(FileExistsError):
        R._publish(spark, root, {"number": 6})
    left = sorted(p.name for p in (tmp_path / "store" / "data").iterdir())
    assert len(left) == 3 and not any((tmp_path / "store" / "staging").iterdir())  # what was not shown is gone
    assert not [p for p in (tmp_path / "store" / "manifests").iterdir() if p.name.startswith("_")]


def test_content_hash_is_that_of_a_bag(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1.5), (2, "y", 1.5)], "k int, s string, d double")
    assert R.content_hash(a) == R.content_hash(a.orderBy(F.desc("k")).repartition(3).select("d", "k", "s"))
    assert len({R.content_hash(d) for d in (a, a.distinct(), a.withColumn("s", F.lit("x")), a.limit(0))}) == 4


def test_layers_of_a_folder(spark, tmp_path):
    for n, kind in (("zones", "Polygon"), ("points", "Point")):
        feature = {"type": "Feature", "id": n, "properties": {"a": "1"}, "geometry": {"type": kind, "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]] if kind == "Polygon" else [0, 0]}}
        (tmp_path / f"{n}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    got = {n: d.collect() for n, d in R.geojson_layers(spark, str(tmp_path), ["zones", "points"]).items()}
    assert got["zones"][0]["rings"] is not None and got["points"][0]["rings"] is None and got["points"][0]["id"] == "points"


def test_a_shared_folder_is_asked_for_on_a_cluster(spark):
    held = {"spark.checkpoint.dir": None, "spark.master": "local-cluster[2,1,1024]"}

    class Fake:
        class conf:
            get = staticmethod(lambda k, d=None: held.get(k) or d)

    with pytest.raises(RuntimeError):
        shared.shared_folder(Fake)
