"""Repair against the odd rule, coverages against sums of areas, tiles against decoding, registries against plain loops."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_polygons import grid_shape, star, star_shape
from zonaris.functions import geometry as G
from zonaris.functions import planar as L
from zonaris.functions import tiles as V
from zonaris.operators import arcs as A
from zonaris.operators import filters, registry
from zonaris.operators import tiles as T


def loops(rng):
    return [rng.uniform(0, 10, 2 * rng.integers(3, 15)).tolist()]


@pytest.mark.parametrize("make", [star_shape, grid_shape, loops])
def test_repaired_rings_hold_the_same_points(make):
    rng = np.random.default_rng(7)
    for _ in range(150):
        shape = make(rng)
        rings = G.rings_of(shape)
        got = L._repair(shape)
        want = G.areas_of(G.trapezoids([rings])[0]).sum()
        if got is None:
            assert want < 1e-4
            continue
        assert got["area"] == pytest.approx(want, abs=1e-4)
        back = G.rings_of(got["shape"])
        x, y = rng.uniform(-10, 10, 300), rng.uniform(-10, 10, 300)
        assert (G.contains(rings, x, y) == G.contains(back, x, y)).all()
        assert L._repair(got["shape"]) == {**got, "was_repaired": False}  # valid now, and the same again
        for r in back:
            assert len({tuple(p) for p in r.tolist()}) == len(r)


def test_repair_tells_what_was_not_valid():
    square, bow = [0.0, 0, 4, 0, 4, 4, 0, 4], [0.0, 0, 2, 2, 2, 0, 0, 2]
    same = lambda s: L._repair(s)["was_repaired"]
    turned = [4.0, 4, 0, 4, 0, 4, 0, 0, 2, 0, 4, 0, 4, 4]  # another start, a doubled point, one on a line, closed
    assert not same([square]) and not same([turned]) and not same([square, [1.0, 1, 2, 1, 2, 2, 1, 2]])
    assert L._repair([turned])["shape"] == L._repair([square])["shape"]
    assert same([bow]) and same([square, square[:6]]) and same([[0.0, 0, 4, 0, 4, 4, 4, 0]] + [square])
    assert L._repair([bow])["area"] == 2 and len(L._repair([bow])["shape"]) == 2
    assert L._repair([square, square]) is None and L._repair([[0.0, 0, 1, 1]]) is None and L._repair([]) is None
    corner = L._repair([square, [0.0, 0, 2, 1, 1, 2]])  # a hole that touches the shell at its corner
    assert corner["area"] == pytest.approx(16 - 1.5) and len(corner["shape"]) == 2


def test_geojson_rings_are_closed_and_turned():
    two = json.loads(L._geojson([[0.0, 0, 0, 9, 9, 9, 9, 0], [1.0, 1, 2, 1, 2, 2.5, 1, 2], [20.0, 0, 21, 0, 21, 1]]))
    assert two["type"] == "MultiPolygon" and [len(p) for p in two["coordinates"]] == [2, 1]
    for polygon in two["coordinates"]:
        for k, ring in enumerate(polygon):
            assert ring[0] == ring[-1] and (G.ring_area(np.array(ring[:-1], float)) > 0) == (k == 0)
    assert L._geojson([]) is None


def coverage(rng, n=4, steps=6):
    """n x n cells whose borders are random walks that neighbours share, one split in two at the middle of a neighbour's side (no corner there)."""
    corner = {(i, j): (i * 10 + rng.uniform(-1, 1), j * 10 + rng.uniform(-1, 1)) for i in range(n + 1) for j in range(n + 1)}
    side = {}

    def walk(a, b):
        if (a, b) not in side:
            p, q = np.array(corner[a]), np.array(corner[b])
            t = np.linspace(0, 1, steps + 1)[1:-1, None]
            line = [tuple(x) for x in np.round(p + t * (q - p) + rng.uniform(-0.8, 0.8, (steps - 1, 2)), 3).tolist()]
            side[a, b], side[b, a] = line, line[::-1]
        return [corner[a], *side[a, b]]

    cells = []
    for i in range(n):
        for j in range(n):
            ring = walk((i, j), (i + 1, j)) + walk((i + 1, j), (i + 1, j + 1)) + walk((i + 1, j + 1), (i, j + 1)) + walk((i, j + 1), (i, j))
            k = int(rng.integers(len(ring)))
            cells.append([c for p in ring[k:] + ring[:k] for c in p])
    return cells


def test_simplified_neighbours_leave_no_gap_and_no_overlap(spark):
    rng = np.random.default_rng(8)
    rings = coverage(rng)
    rows = [(k, [r]) for k, r in enumerate(rings)] + [(90, [[200.0, 0.0, 210.0, 0.0, 210.0, 10.0, 205.0, 10.2, 200.0, 10.0]]), (91, None)]
    rows += [(92, [[300.0, 0.0, 310.0, 0.0, 310.0, 10.0, 300.0, 10.0]]), (93, [[310.0, 2.0, 320.0, 2.0, 320.0, 8.0, 310.0, 8.0]])]  # corners on a neighbour's side
    d = spark.createDataFrame(rows, "k int, shape array<array<double>>").repartition(3)
    got = {(r["k"], r["level"]): r["shape"] for r in A.simplified_shapes(d, "k", [0.0, 0.5, 2.0], 5.0).collect()}
    assert {k for k, _ in got} == {k for k, s in rows if s} and len(got) == 3 * (len(rows) - 1)
    area = lambda s: G._measure(s)["area"]
    for k, s in rows:
        if s:
            assert area(got[k, 0]) == pytest.approx(area(s), abs=1e-4)  # corners are snapped to micrometres
    whole = area([r for r in rings])
    for level in (0, 1, 2):
        cells = [G.rings_of(got[k, level]) for k in range(len(rings))]
        t, m = G.trapezoids(cells)
        w = G.areas_of(t)
        if level < 2:
            assert w[m.sum(1) > 1].sum() < 1e-4  # nothing twice
        outer = sum(area(got[k, level]) for k in range(len(rings)))
        ways = np.concatenate([G.edges_of(c) for c in cells])
        keys = {tuple(e) for e in np.round(ways, 6).tolist()}
        inner = [e for e in keys if (e[2], e[3], e[0], e[1]) in keys]
        border = np.array([e for e in keys if (e[2], e[3], e[0], e[1]) not in keys])
        ring = (border[:, 0] * border[:, 3] - border[:, 2] * border[:, 1]).sum() / 2
        assert outer == pytest.approx(ring, abs=1e-6) and len(inner) > 0  # the cells fill what their outer border bounds
        assert (border[:, None, :2] == border[None, :, 2:]).all(2).any(1).all()  # which is closed
        assert abs(outer - whole) < (1e-4, 20, 60)[level]
    points = lambda level: sum(len(r) for k in range(len(rings)) for r in got[k, level])
    assert points(0) > points(1) > points(2)
    assert got[90, 1] == [[200.0, 0.0, 210.0, 0.0, 210.0, 10.0, 200.0, 10.0]] and len(got[92, 0][0]) == 12


@pytest.mark.parametrize("seed", range(3))
def test_tiles_decode_to_the_clipped_shapes(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        shape = [star(rng, *rng.uniform(0, 64, 2), 40, rng.integers(3, 20)), star(rng, 32, 32, 10)]
        box = (0.0, 0.0, 64.0, 64.0)
        got = V.area_geometry(G.rings_of(shape), box, 4096, 64)
        wide = np.array([(-1, -1), (65, -1), (65, 65), (-1, 65)], float)
        want = G.area_where([G.rings_of(shape), [wide]], lambda m: m.all(1))
        rings, closed = V.decoded(got or [])
        areas = [G.ring_area(r.astype(float)) for r in rings]
        assert sum(areas) / 64**2 == pytest.approx(want, abs=0.6) and (closed or not rings)
        assert not rings or areas[0] > 0  # a shell first
        assert all((r >= -64).all() and (r <= 4160).all() for r in rings)
        coarse = V.area_geometry(G.rings_of(shape), box, 256, 4, 3.0)
        assert sum(G.ring_area(r.astype(float)) for r in V.decoded(coarse or [])[0]) / 4**2 == pytest.approx(want, abs=400)  # 3 units of 1/4 m along the rings
        line = np.array(shape[0]).reshape(-1, 2)
        parts, closed = V.decoded(V.line_geometry(line, box, 4096, 64) or [])
        t = np.linspace(0, 1, 2001)[:, None]
        dense = np.concatenate([a + t * (b - a) for a, b in zip(line[:-1], line[1:], strict=True)])
        inside = ((dense >= -1) & (dense <= 65)).all(1).reshape(-1, 2001).mean(1)
        long = np.hypot(*np.diff(line, axis=0).T)
        assert not closed and sum(np.hypot(*np.diff(p, axis=0).T).sum() for p in parts) / 64 == pytest.approx((inside * long).sum(), abs=0.5)


def test_tile_layers_are_bounded_and_say_so(spark):
    rows = [(k, "area", [[k + 0.0, 0.0, k + 4.0, 0.0, k + 4.0, 4.0]], f"n{k % 2}", float(k), 0.0, k + 4.0, 4.0) for k in range(6)] + [(9, "area", None, "n", 0.0, 0.0, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "k int, kind string, shape array<array<double>>, name string, x0 double, y0 double, x1 double, y1 double").withColumn("layer", F.lit("l"))
    placed = T.on_tiles(d, (0.0, 16.0), 16.0, {0: 8.0, 2: 0.0})
    got = {(r["z"], r["tx"], r["ty"]): r for r in T.tile_table(placed, "layer", "k", F.col("k"), ["name"], most=4).collect()}
    assert got[0, 0, 0]["n"] == 4 and got[0, 0, 0]["left_out"] == 2 and {k[2] for k in got if k[0] == 2} == {3, 2}
    assert b"name" in got[0, 0, 0]["tile"] and got[0, 0, 0]["tile"].count(b"\x0a\x02n") == 2  # each value once
    assert T.tile_table(placed.limit(0), "layer", "k", F.col("k"), []).collect() == []


def plain_registry(log):
    """Entries of one key by going through its changes."""
    out, versions, shown = [], [], None
    for s, kind, v in log:
        if kind == "open":
            versions.append(v)
            new = v
        elif kind == "close":
            new = None
        else:
            older = versions if shown is None else versions[: versions.index(shown)]
            if not older:
                continue
            new = older[-1]
        if shown is not None:
            out[-1] += [s, {"open": "replaced", "close": "withdrawn", "rollback": "rolled_back"}[kind]]
        if new is not None:
            out.append([new, s])
        shown = new
    return [tuple([*e, None, None][:4]) for e in out]


def test_rollbacks_go_on_going_back(spark):
    rnd = random.Random(4)
    logs = {0: [(1, "open", "v1"), (2, "open", "v2"), (3, "open", "v3"), (4, "rollback", None), (5, "rollback", None), (6, "rollback", None), (7, "close", None), (8, "rollback", None), (9, "open", "v4"), (10, "rollback", None)]}
    for k in range(1, 60):
        logs[k] = [(s, kind := rnd.choice(["open", "open", "rollback", "rollback", "close"]), f"v{s}" if kind == "open" else None) for s in range(rnd.randint(0, 14))]
    rows = [(k, s, kind, v) for k, log in logs.items() for s, kind, v in log]
    d = registry.entries_of(spark.createDataFrame(rows, "k int, s bigint, kind string, v string"), "k", "s", "v")
    got = {k: [] for k in logs}
    for r in d.orderBy("k", "state_from").collect():
        got[r["k"]].append((r["v"], r["state_from"], r["state_to"], r["end_reason"]))
    assert [v for v, *_ in got[0]] == ["v1", "v2", "v3", "v2", "v1", "v3", "v4", "v3"]
    assert got == {k: plain_registry(log) for k, log in logs.items()}


def test_keys_keep_values_of_every_kind(spark):
    rows = [('{"A":1.5,"B":"x","C":2,"D":{"e":[1]},"F":null}',), ("no json",), ('{"other":1}',), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string").select(filters.keys_kept(F.col("p"), ["a", "b", "d", "f"])).collect()]
    assert [None if g is None else json.loads(g) for g in got] == [{"A": 1.5, "B": "x", "D": {"e": [1]}}, None, None, None]
