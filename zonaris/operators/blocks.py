"""Grids as blocks: arrays of cells as rows, windows that read only their blocks, neighbourhoods across block edges, adaptive profiles.

A block (bi, bj) holds the cells i in [bi * n, (bi + 1) * n) and j likewise, row by row, null where there is none. A cell's value stands
at the whole point (x = j, y = i).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonaris.sources.shared import written

#: Blocks of a side that share a folder of a written grid.
FOLDER = 8


def blocks_of(cells: DataFrame, n: int) -> DataFrame:
    """(bi, bj, cells): blocks of n x n cells from rows (i, j, z); of several rows of a cell the greatest value counts; blocks without a value have no row."""
    i, j = F.floor(F.col("i") / n), F.floor(F.col("j") / n)
    at = ((F.col("i") - i * n) * n + (F.col("j") - j * n)).cast("int")
    one = cells.where("z is not null and not isnan(z)").groupBy(i.alias("bi"), j.alias("bj"), at.alias("at")).agg(F.max("z").cast("double").alias("z"))
    held = one.groupBy("bi", "bj").agg(F.map_from_entries(F.collect_list(F.struct("at", "z"))).alias("held"))  # at most n * n cells
    return held.select("bi", "bj", F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda k: F.col("held")[k]).alias("cells"))


def write_blocks(blocks: DataFrame, path: str) -> None:
    """A grid in folders of `FOLDER` x `FOLDER` blocks, so that a window opens only the folders that it meets."""
    blocks.withColumns({"fi": F.floor(F.col("bi") / FOLDER), "fj": F.floor(F.col("bj") / FOLDER)}).repartition("fi", "fj").sortWithinPartitions("bi", "bj").write.partitionBy("fi", "fj").parquet(path)


def window(spark: SparkSession, path: str, i0: int, j0: int, i1: int, j1: int, n: int) -> DataFrame:
    """The blocks of a written grid that meet the cells i0..i1, j0..j1 (both inclusive): folders are pruned, then row groups."""
    b = [v // n for v in (i0, j0, i1, j1)]
    f = [v // FOLDER for v in b]
    d = spark.read.schema("bi bigint, bj bigint, cells array<double>, fi bigint, fj bigint").parquet(path)
    return d.where(F.col("fi").between(f[0], f[2]) & F.col("fj").between(f[1], f[3])).where(F.col("bi").between(b[0], b[2]) & F.col("bj").between(b[1], b[3])).drop("fi", "fj")


def cells_of(blocks: DataFrame, n: int, values: str = "cells") -> DataFrame:
    """(i, j, z) of all cells of blocks, null ones left out."""
    d = blocks.select("bi", "bj", F.posexplode(values).alias("at", "z")).where("z is not null")
    return d.select((F.col("bi") * n + F.floor(F.col("at") / n)).alias("i"), (F.col("bj") * n + F.col("at") % n).alias("j"), "z")


def with_halo(blocks: DataFrame, n: int) -> DataFrame:
    """(bi, bj, cells, halo): `halo` maps the places 0..(n + 2)**2 - 1 of the block widened by one cell to the values around it.

    Blocks send only their edge cells to their neighbours, and these meet the block by one join; the blocks' cells are shuffled once.
    """
    wide = n + 2
    d = blocks.select("bi", "bj", F.posexplode("cells").alias("at", "z")).where("z is not null")
    r, c = F.floor(F.col("at") / n), F.col("at") % n
    edge = d.withColumns({"r": r, "c": c}).where(f"r = 0 or c = 0 or r = {n - 1} or c = {n - 1}")
    ways = []
    for di in (-1, 0, 1):
        for dj in (-1, 0, 1):
            if di or dj:
                ok = (F.lit(True) if di == 0 else F.col("r") == (0 if di < 0 else n - 1)) & (F.lit(True) if dj == 0 else F.col("c") == (0 if dj < 0 else n - 1))
                place = (F.col("r") + 1 - di * n) * wide + F.col("c") + 1 - dj * n
                ways.append(F.when(ok, F.struct((F.col("bi") + di).alias("bi"), (F.col("bj") + dj).alias("bj"), place.cast("int").alias("place"), F.col("z").alias("z"))))
    sent = edge.select(F.explode(F.array_compact(F.array(*ways))).alias("x")).select("x.*")
    halo = sent.groupBy("bi", "bj").agg(F.map_from_entries(F.collect_list(F.struct("place", "z"))).alias("halo"))  # at most 4 * n + 4 cells
    return blocks.join(halo, ["bi", "bj"], "left")


def _arrays(cells: pa.ListArray, halo: pa.MapArray, n: int) -> np.ndarray:
    """(blocks, n + 2, n + 2) values, NaN where there is none."""
    wide = n + 2
    out = np.full((len(cells), wide * wide), np.nan)
    inner = (np.arange(n)[:, None] + 1) * wide + np.arange(n) + 1
    out[:, inner.ravel()] = pc.list_flatten(cells).to_numpy(zero_copy_only=False).reshape(len(cells), n * n)
    for k in range(len(halo)):
        if halo[k].is_valid:
            a, b = halo.offsets[k].as_py(), halo.offsets[k + 1].as_py()
            out[k, halo.keys[a:b].to_numpy()] = halo.items[a:b].to_numpy(zero_copy_only=False)
    return out.reshape(-1, wide, wide)


def neighbourhood(work: Callable[[np.ndarray], np.ndarray], n: int):
    """A column function of (cells, halo): `work` gets (blocks, n + 2, n + 2) and gives (blocks, n, n); NaN becomes null."""

    @F.arrow_udf("array<double>")
    def run(cells: pa.Array, halo: pa.Array) -> pa.Array:
        got = work(_arrays(cells, halo, n)).reshape(len(cells), -1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, n * n), pa.int32()), pa.array(got.ravel(), from_pandas=True))

    return run


def _horn(z: np.ndarray) -> np.ndarray:
    """Slope in degrees by Horn's weights; NaN if one of the nine values is missing."""
    at = lambda di, dj: z[:, 1 + di : z.shape[1] - 1 + di, 1 + dj : z.shape[2] - 1 + dj]
    gx = (at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)) / 8
    gy = (at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)) / 8
    return np.degrees(np.arctan(np.hypot(gx, gy))) + 0 * at(0, 0)


def slopes(blocks: DataFrame, n: int) -> DataFrame:
    """(bi, bj, slope): slope of every cell, across the edges of blocks."""
    return with_halo(blocks, n).select("bi", "bj", neighbourhood(_horn, n)("cells", "halo").alias("slope"))


def samples(points: DataFrame, blocks: DataFrame, n: int, key: list[str]) -> DataFrame:
    """(key columns, z) of points (key, x, y): bilinear between the four cells around, null if a needed one is missing.

    Points meet blocks by one join per corner cell's block (mostly the same one); cells are looked up in the block's array.
    """
    i, j = F.floor("y"), F.floor("x")
    corner = [F.struct((i + di).alias("i"), (j + dj).alias("j"), ((1 - F.abs(F.col("y") - i - di)) * (1 - F.abs(F.col("x") - j - dj))).alias("w")) for di in (0, 1) for dj in (0, 1)]
    need = points.select(*key, F.inline(F.array(*corner))).where("w > 0")
    need = need.withColumns({"bi": F.floor(F.col("i") / n), "bj": F.floor(F.col("j") / n)})
    d = need.join(blocks, ["bi", "bj"], "left").withColumn("z", F.get("cells", ((F.col("i") - F.col("bi") * n) * n + F.col("j") - F.col("bj") * n).cast("int")))
    d = d.groupBy(*key).agg(F.sum(F.col("w") * F.col("z")).alias("z"), F.count("*").alias("n"), F.count("z").alias("m"))
    return d.select(*key, F.when(F.col("n") == F.col("m"), F.col("z")).alias("z"))


def profiles(lines: DataFrame, blocks: DataFrame, n: int, key: str, tolerance: float, first: float, least: float, rounds: int = 20) -> DataFrame:
    """(key, t, x, y, z): points along lines (key, x0, y0, x1, y1), denser where the ground bends; t runs from 0 to 1.

    A line begins with pieces of at most `first` length; what is narrower than a quarter of that may stay unseen, so it should be a few cells. Each round samples the quarters of all open pieces in one join; a piece whose middle or quarters are off
    the straight line between its ends by more than `tolerance`, or where one of them is missing and another is not, is halved, as long as it is longer than `least`. So each
    round works on the open pieces only, there are at most log2(first / least) rounds, and nothing but their number comes to the driver.
    """
    long = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    name, key = key, "_line"
    lines = lines.select(F.col(name).alias(key), "x0", "y0", "x1", "y1")
    d = lines.dropna(subset=["x0", "y0", "x1", "y1"]).withColumns({"long": long, "n": F.greatest(F.lit(1), F.ceil(long / first)).cast("int")})
    piece = d.select(key, "x0", "y0", "x1", "y1", "long", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    piece = piece.select(key, "x0", "y0", "x1", "y1", "long", (F.col("k") / F.col("n")).alias("a"), ((F.col("k") + 1) / F.col("n")).alias("b"))
    done = None
    for _ in range(rounds):
        at = piece.withColumn("q", F.explode(F.array(*(F.lit(v) for v in (0.0, 0.25, 0.5, 0.75, 1.0))))).withColumn("t", F.col("a") + (F.col("b") - F.col("a")) * F.col("q"))
        at = at.withColumns({"x": F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("t"), "y": F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("t")})
        z = samples(at.select(key, "a", "b", "t", "x", "y"), blocks, n, [key, "a", "b", "t", "x", "y"])
        met = at.join(z.withColumnsRenamed({key: "z_line", "a": "z_a", "b": "z_b", "t": "z_t", "x": "z_x", "y": "z_y"}), F.col(key).eqNullSafe(F.col("z_line")) & (F.col("a") == F.col("z_a")) & (F.col("b") == F.col("z_b")) & (F.col("t") == F.col("z_t")))
        five = met.groupBy(key, "x0", "y0", "x1", "y1", "long", "a", "b").agg(F.sort_array(F.collect_list(F.struct("q", "t", "x", "y", "z"))).alias("p"))
        value = lambda i: F.col("p")[i]["z"]
        off = [F.abs(value(i) - (value(0) * (4 - i) + value(4) * i) / 4) > tolerance for i in (1, 2, 3)]
        missing = F.exists("p", lambda p: p["z"].isNull()) & F.exists("p", lambda p: p["z"].isNotNull())
        bent = F.coalesce(off[0] | off[1] | off[2], F.lit(False)) | missing
        five = written(five.withColumn("open", bent & ((F.col("b") - F.col("a")) * F.col("long") > least)), "profile")
        closed = five.where("not open").select(key, F.explode(F.array(F.col("p")[0], F.col("p")[4])).alias("p")).select(key, "p.t", "p.x", "p.y", "p.z")
        done = closed if done is None else done.union(closed)
        if five.where("open").isEmpty():
            break
        middle = (F.col("a") + F.col("b")) / 2
        half = F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b")))
        piece = five.where("open").select(key, "x0", "y0", "x1", "y1", "long", F.inline(half))
    return done.groupBy(F.col(key).alias(name), "t").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.max("z").alias("z"))

