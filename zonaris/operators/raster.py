"""Grids as rows: gradients and tile keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Horn's weights of a cell's neighbours: row and column offset, weight along x, weight along y.
HORN = ((-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 0, 0, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1))


def gradient(grid: DataFrame, row: str, col: str, value: str, resolution: float = 1.0) -> DataFrame:
    """(row, col, gx, gy, slope, aspect) of every cell; null where one of the nine values is missing.

    Each cell sends its weighted value to its neighbours, so one shuffle with partial sums does for all nine. Slope is in degrees,
    aspect in degrees clockwise from north for rows that run south, null on level ground.
    """
    known = grid.where(F.col(value).isNotNull())
    to = F.array(*(F.struct((F.col(row) - di).alias("i"), (F.col(col) - dj).alias("j"), (F.col(value) * wx).alias("wx"), (F.col(value) * wy).alias("wy"), F.lit(int((di, dj) == (0, 0))).alias("own")) for di, dj, wx, wy in HORN))
    sums = known.select(F.inline(to)).groupBy("i", "j").agg(F.sum("wx").alias("x"), F.sum("wy").alias("y"), F.count("*").alias("n"), F.max("own").alias("own")).where("own = 1")
    gx, gy = (F.when(F.col("n") == 9, F.col(c) / (8 * resolution)) for c in ("x", "y"))
    d = sums.select(F.col("i").alias(row), F.col("j").alias(col), gx.alias("gx"), gy.alias("gy"))
    steep = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    aspect = F.when(steep > 0, F.pmod(F.degrees(F.atan2(-F.col("gx"), F.col("gy"))) + 360, F.lit(360.0)))
    return d.withColumns({"slope": F.degrees(F.atan(steep)), "aspect": aspect})


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the web-mercator tile that holds a point."""
    n = 1 << zoom
    y = (1 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2
    return F.floor((lon + 180) / 360 * n), F.floor(y * n)
