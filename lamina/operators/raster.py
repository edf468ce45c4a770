"""Rasters as tables of bins: morphology, holes, components, distances. A mask is a table (ix, iy) of its bins.

Masks stay distributed: a step is an explode to neighbours and one aggregate on the bin. Only bins that are set, or next
to one, are ever rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import nearest
from .matching import components

CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]


def _around(mask: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    near = F.explode(F.array(*[F.struct((F.col("ix") + dx).alias("ix"), (F.col("iy") + dy).alias("iy")) for dx, dy in steps])).alias("n")
    return mask.select(near).select("n.ix", "n.iy")


def _inside(mask: DataFrame, nx: int, ny: int) -> DataFrame:
    return mask.where((F.col("ix") >= 0) & (F.col("ix") < nx) & (F.col("iy") >= 0) & (F.col("iy") < ny))


def dilate(mask: DataFrame, nx: int, ny: int) -> DataFrame:
    """Bins in the mask or beside it."""
    return _inside(_around(mask, CROSS), nx, ny).distinct()


def erode(mask: DataFrame, nx: int, ny: int) -> DataFrame:
    """Bins whose four neighbours are all in the mask; beyond the border there is nothing."""
    return _inside(_around(mask, CROSS), nx, ny).groupBy("ix", "iy").agg(F.count("*").alias("n")).where(F.col("n") == len(CROSS)).select("ix", "iy")


def close(mask: DataFrame, nx: int, ny: int) -> DataFrame:
    return erode(dilate(mask, nx, ny), nx, ny)


def opened(mask: DataFrame, nx: int, ny: int) -> DataFrame:
    return dilate(erode(mask, nx, ny), nx, ny)


def label(mask: DataFrame, nx: int) -> DataFrame:
    """(ix, iy, component) of four-connected parts; a part is named by the smallest row-major number of its bins."""
    m = mask.select((F.col("iy").cast("bigint") * nx + F.col("ix")).alias("at"), "ix", "iy")
    right = m.where(F.col("ix") < nx - 1).select("at", (F.col("at") + 1).alias("to"))
    up = m.select("at", (F.col("at") + nx).alias("to"))
    edges = right.unionAll(up).join(m.select(F.col("at").alias("to")), "to").select("at", "to")
    return m.join(components(edges, "at", "to").withColumnRenamed("node", "at"), "at", "left").select("ix", "iy", F.coalesce("component", "at").alias("component"))


def large_parts(mask: DataFrame, nx: int, least: int) -> DataFrame:
    """Bins of parts of ``least`` bins or more."""
    parts = label(mask, nx)
    return parts.join(parts.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("component"), "component", "left_semi").select("ix", "iy")


def fill_holes(mask: DataFrame, nx: int, ny: int) -> DataFrame:
    """The mask with the parts of its complement that don't touch the border. The grid's size is a parameter, and so bounds the complement."""
    grid = mask.sparkSession.range(nx * ny).select((F.col("id") % nx).cast("int").alias("ix"), F.floor(F.col("id") / nx).cast("int").alias("iy"))
    rest = label(grid.join(mask, ["ix", "iy"], "left_anti"), nx)
    border = rest.where((F.col("ix") == 0) | (F.col("iy") == 0) | (F.col("ix") == nx - 1) | (F.col("iy") == ny - 1)).select("component").distinct()
    return mask.select("ix", "iy").unionByName(rest.join(border, "component", "left_anti").select("ix", "iy"))


def signed_distance(grid: DataFrame, inside: str, radius: float, limit: float) -> DataFrame:
    """(ix, iy, distance): from each bin to the nearest bin of the other kind, negative inside (X34). ``grid`` has a boolean column ``inside``."""
    g = grid.select(F.concat_ws(":", "ix", "iy").alias("id"), "ix", "iy", F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"), inside)
    parts = []
    for flag in (True, False):
        near = nearest(g.where(F.col(inside) == flag).drop(inside), g.where(F.col(inside) != flag).drop(inside, "ix", "iy"), "id", "id", radius, limit)
        parts.append(near.select("id", (F.sqrt("d2") * (-1 if flag else 1)).alias("distance")))
    return g.join(parts[0].unionByName(parts[1]), "id").select("ix", "iy", F.round("distance", 6).alias("distance"))
