"""Vector tiles of lines and areas: clipped with a margin, quantised, encoded as commands.

A geometry is a list of integers: a command with its count (move, line, close), then steps from the point before, folded so
that small negative numbers stay small. Shells run clockwise on the screen (their area is positive with y down), holes against it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

from zonaris.functions import geometry as G
from zonaris.functions import planar as L

#: Fixed values of the format: commands, geometry kinds and the version.
MOVE, LINE, CLOSE = 1, 2, 7
LINESTRING, POLYGON = 2, 3
VERSION = 2
Box = tuple[float, float, float, float]


def clipped_ring(p: np.ndarray, box: Box) -> np.ndarray:
    """A ring cut to a box, side by side; parts may be joined along the box's border."""
    x0, y0, x1, y1 = box
    for axis, limit, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        if not len(p):
            break
        q = np.roll(p, -1, 0)
        a, b = sign * (p[:, axis] - limit), sign * (q[:, axis] - limit)
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = p + (a / (a - b))[:, None] * (q - p)
        cross[:, axis] = limit
        both = np.stack([p, cross], 1).reshape(-1, 2)
        p = both[np.stack([a >= 0, (a < 0) != (b < 0)], 1).ravel()]
    return p


def clipped_line(p: np.ndarray, box: Box) -> list[np.ndarray]:
    """The parts of an open line inside a box."""
    x0, y0, x1, y1 = box
    a, d = p[:-1], p[1:] - p[:-1]
    low, high = np.zeros(len(d)), np.ones(len(d))
    ok = np.ones(len(d), bool)
    for axis, lo, hi in ((0, x0, x1), (1, y0, y1)):
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (lo - a[:, axis]) / d[:, axis], (hi - a[:, axis]) / d[:, axis]
        still = d[:, axis] == 0
        ok &= ~still | ((a[:, axis] >= lo) & (a[:, axis] <= hi))
        low = np.where(still, low, np.maximum(low, np.minimum(t, u)))
        high = np.where(still, high, np.minimum(high, np.maximum(t, u)))
    parts: list[list[np.ndarray]] = []
    for k in np.flatnonzero(ok & (low <= high)):
        first, last = a[k] + low[k] * d[k], a[k] + high[k] * d[k]
        if not parts or low[k] > 0 or not (parts[-1][-1] == first).all():
            parts.append([first])
        parts[-1].append(last)
    return [np.array(x) for x in parts]


def _steps(points: np.ndarray) -> np.ndarray:
    """Points without those equal to the one before."""
    return points[np.concatenate(([True], (np.diff(points, axis=0) != 0).any(1)))]


def commands(parts: Sequence[np.ndarray], closed: bool) -> list[int]:
    """The geometry of lines, or of rings, in whole tile units."""
    out: list[int] = []
    here = np.zeros(2, np.int64)
    for p in parts:
        d = np.diff(np.vstack([here, p]), axis=0)
        z = ((d << 1) ^ (d >> 63)).tolist()
        out += [MOVE | 1 << 3, *z[0], LINE | (len(p) - 1) << 3, *(v for s in z[1:] for v in s)]
        out += [CLOSE | 1 << 3] if closed else []
        here = p[-1]
    return out


def area_geometry(rings: list[np.ndarray], box: Box, extent: int, margin: int, tolerance: float = 0.0) -> list[int] | None:
    """The part of a shape in the tile `box` (y upwards) and `margin` units around it; null if nothing of it is left.

    `tolerance` (tile units) generalises each ring; rings that fall to a line are left out.
    """
    x0, y0, x1, y1 = box
    unit = (x1 - x0) / extent
    wide = (x0 - margin * unit, y0 - margin * unit, x1 + margin * unit, y1 + margin * unit)
    cut = [q for q in (clipped_ring(r, wide) for r in rings) if len(q) >= 3]
    on_tile = []
    for q in cut:
        q = np.column_stack([(q[:, 0] - x0) / unit, (y1 - q[:, 1]) / unit])
        on_tile.append(np.round(G.simplified(q, tolerance) if tolerance else q))
    out = []
    for polygon in L.polygons([r for r in on_tile if len(r) >= 3]):
        for ring in polygon:  # against the clock in numbers is clockwise on the screen, where y grows downwards
            p = np.array(ring).round().astype(np.int64)
            p = _steps(np.vstack([p, p[:1]]))[:-1]
            if len(p) >= 3 and G.ring_area(p) != 0:
                out.append(p)
    return commands(out, True) if out else None


def line_geometry(line: np.ndarray, box: Box, extent: int, margin: int, tolerance: float = 0.0) -> list[int] | None:
    """The parts of an open line in a tile, as `area_geometry`."""
    x0, y0, x1, y1 = box
    unit = (x1 - x0) / extent
    wide = (x0 - margin * unit, y0 - margin * unit, x1 + margin * unit, y1 + margin * unit)
    out = []
    for q in clipped_line(line, wide):
        q = np.column_stack([(q[:, 0] - x0) / unit, (y1 - q[:, 1]) / unit])
        p = _steps(np.round(L.simplified_line(q, tolerance) if tolerance else q).astype(np.int64))
        if len(p) >= 2:
            out.append(p)
    return commands(out, False) if out else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes((*out, n))


def _field(number: int, kind: int, value: bytes | int) -> bytes:
    return varint(number << 3 | kind) + (varint(value) if kind == 0 else varint(len(value)) + value)


def layer(name: str, features: Sequence[tuple[int, int, Sequence[int], dict[str, str]]], extent: int) -> bytes:
    """A layer of features (id, geometry kind, commands, properties), with its keys and values once each."""
    keys: dict[str, int] = {}
    values: dict[str, int] = {}
    body = _field(15, 0, VERSION) + _field(1, 2, name.encode())
    for i, kind, geometry, properties in features:
        tags = b"".join(varint(keys.setdefault(k, len(keys))) + varint(values.setdefault(v, len(values))) for k, v in sorted(properties.items()) if v is not None)
        feature = _field(1, 0, i) + (_field(2, 2, tags) if tags else b"") + _field(3, 0, kind) + _field(4, 2, b"".join(map(varint, geometry)))
        body += _field(2, 2, feature)
    body += b"".join(_field(3, 2, k.encode()) for k in keys) + b"".join(_field(4, 2, _field(1, 2, v.encode())) for v in values)
    return _field(3, 2, body + _field(5, 0, extent))


def _geometry(kind: str, shape, x0, y0, x1, y1, extent, margin, tolerance):
    box = (x0, y0, x1, y1)
    if kind == "area":
        return area_geometry(G.rings_of(shape), box, extent, margin, tolerance)
    parts = [g for r in shape or [] if len(r) >= 4 and (g := line_geometry(np.asarray(r, float).reshape(-1, 2), box, extent, margin, tolerance))]
    if len(parts) < 2:
        return parts[0] if parts else None
    return commands([p for g in parts for p in decoded(g)[0]], False)


def decoded(geometry: Sequence[int]) -> tuple[list[np.ndarray], bool]:
    """The lines or rings of a geometry, and whether they are closed."""
    out: list[list[tuple[int, int]]] = []
    x = y = at = 0
    closed = False
    while at < len(geometry):
        command, count = geometry[at] & 7, geometry[at] >> 3
        at += 1
        if command == CLOSE:
            closed = True
            continue
        for _ in range(count):
            dx, dy = ((v >> 1) ^ -(v & 1) for v in geometry[at : at + 2])
            x, y, at = x + dx, y + dy, at + 2
            if command == MOVE:
                out.append([])
            out[-1].append((x, y))
    return [np.array(p, np.int64) for p in out], closed


#: (kind, shape or lines, x0, y0, x1, y1 of the tile, extent, margin, tolerance) to commands; kind is `area` or `line`; null if nothing is left
geometry = G.shape_function(_geometry, "array<bigint>", pa.list_(pa.int64()))
encoded_layer = G.shape_function(lambda name, rows, extent: layer(name, [(r["id"], POLYGON if r["kind"] == "area" else LINESTRING, r["commands"], {x["k"]: x["v"] for x in r["properties"] or []}) for r in rows], extent), "binary", pa.binary())
