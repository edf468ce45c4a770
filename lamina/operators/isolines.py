"""Outlines of what lies over a level of a field: fields from nearest points, masks and their polygons."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.grid import Axis, inverse_distance, k_nearest, nearest
from ..sources.scratch import materialize
from . import fields, levels, raster
from .regions import perimeter, signed_area

#: Steps to the neighbour beyond each side of a bin, and the side's corners with the bin on its left.
SIDES = [((0, -1), (0, 0), (1, 0)), ((1, 0), (1, 0), (1, 1)), ((0, 1), (1, 1), (0, 1)), ((-1, 0), (0, 1), (0, 0))]
RINGS = "component bigint, ring int, corners array<struct<x:double,y:double>>"


def border_edges(labelled: DataFrame) -> DataFrame:
    """(component, x0, y0, x1, y1): bin sides beyond which a component (ix, iy, component) ends, as steps from corner to corner with it on the left."""
    side = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dx", "dy", "ax", "ay", "bx", "by"), (*d, *a, *b), strict=True)]) for d, a, b in SIDES])).alias("s")
    e = labelled.select("component", "ix", "iy", side)
    e = e.select("component", (F.col("ix") + F.col("s.dx")).alias("nx"), (F.col("iy") + F.col("s.dy")).alias("ny"), *[(F.col(f"i{c}") + F.col(f"s.{p}{c}")).cast("int").alias(f"{c}{i}") for i, p in enumerate("ab") for c in "xy"])
    beyond = labelled.select("component", F.col("ix").alias("nx"), F.col("iy").alias("ny"))
    return e.join(beyond, ["component", "nx", "ny"], "left_anti").select("component", "x0", "y0", "x1", "y1")


def traced(steps: list[tuple[int, int, int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Closed rings of border steps, without corners on a straight line. Where two rings meet at a corner each turns left, so they stay apart."""
    out: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for x0, y0, x1, y1 in sorted(steps):
        out[(x0, y0)].append((x1, y1))
    while out:
        start = at = min(out)  # its lowest corner on the left, where a ring turns
        ring, heading = [], (0, 0)
        while not ring or at != start:
            choices = out[at]
            # The step farthest to the left of where it comes from has the largest cross product.
            to = max(choices, key=lambda p: heading[0] * (p[1] - at[1]) - heading[1] * (p[0] - at[0]))
            choices.remove(to)
            if not choices:
                del out[at]
            step = (to[0] - at[0], to[1] - at[1])
            if step != heading:
                ring.append(at)
            heading, at = step, to
        yield ring


def polygons(labelled: DataFrame, x: Axis, y: Axis) -> DataFrame:
    """(component, ring, corners) of the components of a mask, outer rings counter-clockwise and holes clockwise.

    What comes together is the border of one component, which the raster bounds.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rings = list(traced(list(g[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None))))
        placed = [[{"x": x.low + a * x.step, "y": y.low + b * y.step} for a, b in r] for r in rings]
        return pd.DataFrame({"component": [g["component"].iloc[0]] * len(rings), "ring": range(len(rings)), "corners": placed})

    return border_edges(labelled).groupBy("component").applyInPandas(run, RINGS)


def polygon_sizes(rings: DataFrame) -> DataFrame:
    """(component, n_rings, area, perimeter) of polygons, holes taken off."""
    r = F.col("corners")
    return rings.groupBy("component").agg(F.count("*").alias("n_rings"), F.round(F.sum(signed_area(r)), 3).alias("area"), F.round(F.sum(perimeter(r)), 3).alias("perimeter"))


def mesh(spark, x: Axis, y: Axis) -> DataFrame:
    """(node, ix, iy, x, y): the middles of a grid's bins."""
    n = spark.range(x.n * y.n).select(F.col("id").alias("node"), (F.col("id") % x.n).cast("int").alias("ix"), F.floor(F.col("id") / x.n).cast("int").alias("iy"))
    return n.withColumns({"x": x.low + (F.col("ix") + 0.5) * x.step, "y": y.low + (F.col("iy") + 0.5) * y.step})


def target_field(cells: DataFrame, x: Axis, y: Axis, k: int, radius: float, limit: float, sigma: float) -> DataFrame:
    """(ix, iy, value): the share of targets (column ``target``, 0 or 1) about each node by inverse distance to its ``k`` nearest cells, smoothed; nodes without a cell within ``limit`` are off the tissue.

    ``cells`` has cell_id, x, y and target. Each node's value is a small aggregate; smoothing weighs nodes on the tissue only.
    """
    nodes = materialize(mesh(cells.sparkSession, x, y))
    near = k_nearest(nodes.select("node", "x", "y"), cells.select("cell_id", "x", "y"), "node", "cell_id", k, radius, limit)
    known = near.join(cells.select(F.col("cell_id").alias("near_cell_id"), F.col("target").cast("double").alias("target")), "near_cell_id")
    value = inverse_distance(known, "node", "target")
    bins = nodes.join(value, "node").select("ix", "iy", "target", F.lit(1.0).alias("on"))
    even = fields.smooth(bins, [], {"ix": x.n, "iy": y.n}, sigma, ["target", "on"], "nearest")
    return even.join(bins.select("ix", "iy"), ["ix", "iy"]).select("ix", "iy", (F.col("target") / F.col("on")).alias("value"))


def isoline(cells: DataFrame, x: Axis, y: Axis, k: int = 30, radius: float = 50.0, limit: float = 200.0, sigma: float = 5.0, level: float = 0.5, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(bins of the components, their rings) where the field of targets reaches ``level`` and a component holds ``least`` targets or more.

    Genes' isolines are the same with molecules as targets among cells (X13).
    """
    field = target_field(cells, x, y, k, radius, limit, sigma)
    parts = materialize(raster.label(field.where(F.col("value") >= level).select("ix", "iy"), x.n))
    own = cells.where("target = 1").where(x.inside("x") & y.inside("y")).select(x.clipped("x").alias("ix"), y.clipped("y").alias("iy"))
    counts = own.join(parts, ["ix", "iy"]).groupBy("component").agg(F.count("*").alias("n_targets")).where(F.col("n_targets") >= least)
    kept = materialize(parts.join(counts, "component"))
    return kept, polygons(kept.drop("n_targets"), x, y)


def target_fields(molecules: DataFrame, cells: DataFrame, x: Axis, y: Axis, genes: list[str], k: int, radius: float, limit: float, sigma: float) -> DataFrame:
    """(gene, ix, iy, value): for each gene the share of its molecules (gene, id, x, y) among molecules and cells (cell_id, x, y) about each node, as :func:`target_field` has it.

    Cells are searched once for all genes, molecules once with the gene as a key; a node's nearest of both are the nearest
    of its nearest of each.
    """
    nodes = materialize(mesh(cells.sparkSession, x, y))
    named = F.array(*[F.lit(g) for g in genes])
    of_cells = k_nearest(nodes.select("node", "x", "y"), cells.select("cell_id", "x", "y"), "node", "cell_id", k, radius, limit)
    own = nodes.withColumn("gene", F.explode(named)).withColumn("at", F.struct("gene", "node"))
    of_genes = k_nearest(own.select("at", "gene", "x", "y"), molecules.where(F.col("gene").isin(genes)).select("gene", "id", "x", "y"), "at", "id", k, radius, limit, keys=("gene",))
    both = of_genes.select("at.gene", "at.node", F.lit(1.0).alias("target"), "d2", F.col("near_id").cast("string").alias("id")).unionByName(
        of_cells.select(F.explode(named).alias("gene"), "node", F.lit(0.0).alias("target"), "d2", F.col("near_cell_id").cast("string").alias("id"))
    )
    place = F.row_number().over(W.partitionBy("gene", "node").orderBy("d2", F.desc("target"), "id"))
    near = both.withColumn("place", place).where(F.col("place") <= k).withColumn("at", F.struct("gene", "node"))
    value = inverse_distance(near, "at", "target").select("at.gene", "at.node", "target")
    bins = materialize(nodes.join(value, "node").select("gene", "ix", "iy", "target", F.lit(1.0).alias("on")))
    even = fields.smooth(bins, ["gene"], {"ix": x.n, "iy": y.n}, sigma, ["target", "on"], "nearest")
    return even.join(bins.select("gene", "ix", "iy"), ["gene", "ix", "iy"]).select("gene", "ix", "iy", F.round(F.col("target") / F.col("on"), 9).alias("value"))


def level_isolines(field: DataFrame, targets: DataFrame, keys: list[str], x: Axis, y: Axis, level: float, least: int) -> tuple[DataFrame, DataFrame]:
    """((keys, ring, area, length, n_targets), their steps): interpolated outlines of where a field reaches ``level`` that have ``least`` targets (keys, id, x, y) or more inside.

    Off the tissue the field is 0, so outlines close at its border. Areas of holes are negative.
    """
    ringed = materialize(levels.rings(levels.segments(field, keys, level, x, y, 0.0), keys))
    held = levels.enclosing(targets, ringed, keys, "id", y.step).groupBy(*keys, "ring").agg(F.count("*").alias("n_targets")).where(F.col("n_targets") >= least)
    sizes = levels.ring_sizes(ringed, keys).select(*keys, "ring", "area", "length").join(held, [*keys, "ring"])
    return sizes, ringed.join(held.select(*keys, "ring"), [*keys, "ring"], "left_semi")


def gene_isolines(molecules: DataFrame, cells: DataFrame, x: Axis, y: Axis, genes: list[str], k: int = 30, radius: float = 50.0, limit: float = 200.0, sigma: float = 5.0, level: float = 0.5, least: int = 10) -> DataFrame:
    """(gene, status, n_rings, area, n_targets) for each gene named (X13, Z42): its molecules among the cells. A gene without molecules gives a row that says so."""
    field = materialize(target_fields(molecules, cells, x, y, genes, k, radius, limit, sigma))
    sizes, _ = level_isolines(field, molecules.where(F.col("gene").isin(genes)).select("gene", "id", "x", "y"), ["gene"], x, y, level, least)
    found = sizes.groupBy("gene").agg(F.count("*").alias("n_rings"), F.round(F.sum("area"), 1).alias("area"), F.sum("n_targets").alias("n_targets"))
    named = cells.sparkSession.createDataFrame([(g,) for g in genes], "gene string")
    have = molecules.where(F.col("gene").isin(genes)).groupBy("gene").agg(F.count("*").alias("_n"))
    rows = named.join(have, "gene", "left").join(found, "gene", "left")
    status = F.when(F.col("_n").isNull(), "no_molecules").when(F.col("n_rings").isNull(), "no_contour").otherwise("ok")
    return rows.select("gene", status.alias("status"), *[F.coalesce(c, F.lit(v)).alias(c) for c, v in (("n_rings", 0), ("area", 0.0), ("n_targets", 0))])


def seeded(labels: DataFrame, mask: DataFrame, x: Axis, y: Axis) -> DataFrame:
    """(ix, iy, structure_id): bins of a mask, those without a label taking that of the nearest labelled bin, ties to the smaller id."""
    have = mask.join(labels, ["ix", "iy"])
    rest = mask.join(labels, ["ix", "iy"], "left_anti")
    at = lambda t: t.withColumns({"x": F.col("ix") * x.step, "y": F.col("iy") * y.step})
    # A seed's number sorts by structure first, so that ties go to the smaller id.
    seeds = at(have).withColumn("seed", F.col("structure_id").cast("bigint") * (x.n * y.n) + F.col("iy") * x.n + F.col("ix"))
    asked = at(rest).withColumn("bin", (F.col("iy") * x.n + F.col("ix")).cast("bigint"))
    limit = ((x.high - x.low) ** 2 + (y.high - y.low) ** 2) ** 0.5
    near = nearest(asked.select("bin", "x", "y"), seeds.select("seed", "x", "y"), "bin", "seed", 2 * max(x.step, y.step), limit)
    found = asked.join(near, "bin").join(seeds.select(F.col("seed").alias("near_seed"), "structure_id"), "near_seed").select("ix", "iy", "structure_id")
    return have.select("ix", "iy", "structure_id").unionByName(found)
