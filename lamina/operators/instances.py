"""Instances within structures: support by density, lumens in its holes, a watershed from lumens, and what each instance holds.

All steps are keyed rasters, so slices and structures are worked on together. A raster's border counts as outside.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.grid import Axis
from ..functions.quantiles import quantiles
from ..sources.scratch import materialize
from . import fields, tiles
from .raster import CROSS

KEYS = ["slice", "structure"]


@dataclass(frozen=True)
class Settings:
    """Lengths are in the units of x and y; thresholds are shares of a structure's own upper density."""

    density_sigma: float = 20.0
    density_threshold: float = 0.25
    closing: float = 20.0
    lumen_threshold: float = 0.1
    lumen_least_area: float = 200.0
    least_area: float = 1000.0
    ring_support: float = 0.55


def densities(cells: DataFrame, mask: DataFrame, x: Axis, y: Axis, sigma: float) -> DataFrame:
    """(slice, structure, ix, iy, density, marker): smoothed cells and markers in each bin of the masks, cells on the scale of their 95th percentile among positive ones."""
    at = cells.where(x.inside("x") & y.inside("y")).groupBy("slice", x.clipped("x").alias("ix"), y.clipped("y").alias("iy"))
    bins = at.agg(F.count("*").cast("double").alias("density"), F.sum("marker").cast("double").alias("marker"))
    even = fields.smooth(bins, ["slice"], {"ix": x.n, "iy": y.n}, sigma / x.step, ["density", "marker"])
    own = materialize(mask.join(even, ["slice", "ix", "iy"], "left").fillna(0.0, ["density", "marker"]).select(*KEYS, "ix", "iy", F.round("density", 9).alias("density"), F.round("marker", 9).alias("marker")))
    scale = quantiles(own.where("density > 0"), KEYS, ["density"], [0.95]).select(*KEYS, F.col("density")[0].alias("scale"))
    return own.join(scale, KEYS, "left").select(*KEYS, "ix", "iy", F.coalesce(F.round(F.try_divide("density", "scale"), 9), F.lit(0.0)).alias("density"), F.coalesce(F.round(F.col("marker") / (F.col("density") + 1e-9), 9), F.lit(0.0)).alias("marker"))


def _or_else(some: DataFrame, every: DataFrame) -> DataFrame:
    """``some``, and all of ``every`` for keys of which nothing is in ``some``."""
    return some.unionByName(every.join(some.select(*KEYS).distinct(), KEYS, "left_anti"))


def support_of(field: DataFrame, x: Axis, y: Axis, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(support, domain): dense or marked bins of each mask, closed by a disk; and those with their holes filled."""
    at = [*KEYS, "ix", "iy"]
    mask = field.select(*at)
    dense = _or_else(field.where((F.col("density") >= s.density_threshold) | (F.col("marker") > 0)).select(*at), mask)
    disk = tiles.disk(max(1, round(s.closing / x.step)))
    inside = lambda m: m.where((F.col("ix") >= 0) & (F.col("ix") < x.n) & (F.col("iy") >= 0) & (F.col("iy") < y.n))
    closed = tiles.eroded(inside(tiles.dilated(dense, KEYS, disk)), KEYS, disk)
    support = materialize(closed.join(mask, at, "left_semi"))
    # Closing may leave nothing near a raster's border; a hole is closed in by what is left.
    domain = support.unionByName(tiles.holes(support, KEYS, x.n, y.n).join(mask, at, "left_semi")) if not support.isEmpty() else support
    return support, materialize(_or_else(domain, mask))


def lumens_of(field: DataFrame, support: DataFrame, domain: DataFrame, x: Axis, y: Axis, s: Settings) -> DataFrame:
    """(slice, structure, ix, iy, part): empty parts of the domain, large enough and off the raster's border.

    They are holes of the support; where a structure has no such hole, thinly filled parts that don't touch the domain's edge.
    """
    at = [*KEYS, "ix", "iy"]
    least = max(1, round(s.lumen_least_area / (x.step * y.step)))
    thin = field.where(F.col("density") <= s.lumen_threshold).select(*at).join(domain, at, "left_semi")
    holes = materialize(tiles.large(thin.join(support, at, "left_anti"), KEYS, least))
    rest = thin.join(holes.select(*KEYS).distinct(), KEYS, "left_anti")
    inner = tiles.eroded(domain, KEYS, CROSS)
    others = materialize(tiles.large(rest, KEYS, least))
    edged = others.join(domain.join(inner, at, "left_anti"), at, "left_semi").select(*KEYS, "part").distinct()
    found = materialize(holes.unionByName(others.join(edged, [*KEYS, "part"], "left_anti")))
    return found.join(tiles.at_border(found, x.n, y.n).select(*KEYS, "part").distinct(), [*KEYS, "part"], "left_anti")


def segmented(field: DataFrame, x: Axis, y: Axis, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bins with their instance, support, lumens): the domain of each structure parted among its lumens, or into its own parts where it has none."""
    at = [*KEYS, "ix", "iy"]
    support, domain = support_of(field, x, y, s)
    lumens = materialize(lumens_of(field, support, domain, x, y, s))
    seeded = domain.join(lumens.select(*KEYS).distinct(), KEYS, "left_semi")
    level = tiles.squared_distances(lumens, seeded, KEYS)
    wet = tiles.flood(seeded.join(level, at).join(lumens.withColumnRenamed("part", "marker"), at, "left").withColumn("level", F.sqrt("d2")), KEYS)
    dry = tiles.parts(domain.join(lumens.select(*KEYS).distinct(), KEYS, "left_anti"), KEYS)
    bins = wet.select(*at, F.col("label").alias("instance")).unionByName(dry.select(*at, F.col("part").alias("instance")))
    return materialize(bins), support, lumens


def instances(cells: DataFrame, mask: DataFrame, x: Axis, y: Axis, s: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """(instances, their bins).

    ``cells`` has slice, x, y and marker (a count), ``mask`` the bins (slice, structure, ix, iy) of each structure. Instances
    are numbered within slice and structure by the first bin of their lumen or part. Areas and centres are those of bins.
    """
    s = s or Settings()
    at, key = [*KEYS, "ix", "iy"], [*KEYS, "instance"]
    field = materialize(densities(cells, mask, x, y, s.density_sigma))
    bins, support, lumens = segmented(field, x, y, s)
    pixel = x.step * y.step
    middle = {"cx": x.low + (F.col("ix") + 0.5) * x.step, "cy": y.low + (F.col("iy") + 0.5) * y.step}
    place = lambda t: t.withColumns(middle).groupBy(*key).agg((F.count("*") * pixel).alias("area"), F.avg("cx").alias("cx"), F.avg("cy").alias("cy"))
    hollow = place(lumens.withColumnRenamed("part", "instance")).withColumnsRenamed({"area": "lumen_area", "cx": "lumen_cx", "cy": "lumen_cy"})
    rim = bins.join(tiles.eroded(bins, key, CROSS), [*key, "ix", "iy"], "left_anti")
    ring = rim.join(support.withColumn("_on", F.lit(1)), at, "left").groupBy(*key).agg((F.count("_on") / F.count("*")).alias("ring_support"))
    held = cells.where(x.inside("x") & y.inside("y")).select("slice", x.clipped("x").alias("ix"), y.clipped("y").alias("iy"), "marker").join(bins, ["slice", "ix", "iy"])
    inside = held.groupBy(*key).agg(F.count("*").alias("n_cells"), F.sum("marker").alias("markers"), F.avg(F.when(F.col("marker") > 0, 0.0).otherwise(1.0)).alias("contamination"))
    rows = place(bins).join(hollow, key, "left").join(ring, key, "left").join(inside, key, "left").fillna(0, ["n_cells", "markers"]).fillna(0.0, ["lumen_area", "ring_support"])
    rows = rows.withColumns({
        "number": F.row_number().over(W.partitionBy(*KEYS).orderBy("instance")), "marker_score": F.col("markers") / F.greatest("n_cells", F.lit(1)), "no_lumen_seed": F.col("lumen_area") <= 0,
        "weak_ring": F.col("ring_support") < s.ring_support, "merged_candidate": F.col("lumen_area") >= max(4 * s.lumen_least_area, s.lumen_least_area + 1), "small_fragment": F.col("area") < s.least_area,
    })
    flags = F.concat_ws(";", *[F.when(F.col(f), F.lit(f)) for f in ("no_lumen_seed", "weak_ring", "merged_candidate", "small_fragment")])
    name = F.concat_ws("_", "slice", "structure", F.lpad(F.col("number").cast("string"), 4, "0"))
    return rows.select(
        name.alias("id"), *key, "number", "area", "cx", "cy", "lumen_area", "lumen_cx", "lumen_cy", "ring_support", "marker_score", "contamination", "n_cells", "markers", flags.alias("flags")
    ), bins
