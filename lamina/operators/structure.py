"""Tissue structures: assignment of clusters to structures, partitions on a grid, and their quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.grid import Axis, histogram

#: (structure_id, structure_name, cluster) of a structure specification.
Spec = list[tuple[int, str, str]]


def spec_table(spark, spec: Spec) -> DataFrame:
    if len({c for _, _, c in spec}) != len(spec):
        raise ValueError("a cluster belongs to more than one structure")
    if any(i <= 0 for i, _, _ in spec):
        raise ValueError("structure ids are positive")
    return spark.createDataFrame(spec, "structure_id int, structure_name string, cluster string")


def assign_structure(cells: DataFrame, spec: Spec) -> DataFrame:
    """``cells`` with structure_id of their cluster, 0 for none (P3). The specification is a literal of the query, so it is broadcast."""
    table = F.broadcast(spec_table(cells.sparkSession, spec).select("cluster", "structure_id"))
    return cells.join(table, "cluster", "left").withColumn("structure_id", F.coalesce("structure_id", F.lit(0)))


def dominant_bins(cells: DataFrame, x: Axis, y: Axis) -> DataFrame:
    """(ix, iy, bin_structure): the structure with most cells in each bin, ties to the smaller id.

    The winner is an aggregate, not a window: bins meet in one partial sum and one maximum.
    """
    counts = histogram(cells.where("structure_id > 0"), x, y, ["structure_id"])
    best = F.max_by("structure_id", F.struct("value", -F.col("structure_id")))
    return counts.groupBy("ix", "iy").agg(best.alias("bin_structure"))


def assign_partition(cells: DataFrame, bins: DataFrame, x: Axis, y: Axis) -> DataFrame:
    """``cells`` with bin_structure of their bin, 0 where the bin has none; cells outside go to the end bins."""
    placed = cells.withColumns({"ix": x.clipped("x"), "iy": y.clipped("y")})
    return placed.join(bins, ["ix", "iy"], "left").withColumn("bin_structure", F.coalesce("bin_structure", F.lit(0))).drop("ix", "iy")


def purity_recall(cells: DataFrame) -> DataFrame:
    """Per structure: cells, cells its bins hold, own cells in its bins, purity and recall."""
    # One pass over cells; all figures come from the counts of pairs of structures.
    pairs = cells.where("structure_id > 0").groupBy("structure_id", "bin_structure").agg(F.count("*").alias("n"))
    sides = F.explode(F.array(F.struct(F.lit(True).alias("cell"), F.col("structure_id").alias("s")), F.struct(F.lit(False).alias("cell"), F.col("bin_structure").alias("s")))).alias("e")
    each = pairs.select("n", (F.col("structure_id") == F.col("bin_structure")).alias("own"), sides).where("e.s > 0").groupBy(F.col("e.s").alias("structure_id")).agg(
        F.sum(F.when(F.col("e.cell"), F.col("n"))).alias("n_cells"), F.sum(F.when(F.col("e.cell") & F.col("own"), F.col("n")).otherwise(0)).alias("n_own"), F.sum(F.when(~F.col("e.cell"), F.col("n"))).alias("n_held")
    )
    by_cell = each.where("n_cells is not null")
    return by_cell.select(
        "structure_id", "n_cells", "n_own", F.coalesce("n_held", F.lit(0)).alias("n_held"),
        F.round(F.coalesce(F.try_divide("n_own", "n_held"), F.lit(0.0)), 6).alias("purity"), F.round(F.col("n_own") / F.col("n_cells"), 6).alias("recall"),
    )


def bin_adjacency(bins: DataFrame) -> DataFrame:
    """(a, b, n_edges): bin edges that two structures share, by pair (X16 over a raster). Each bin meets its right and upper neighbour in an equi-join."""
    right = bins.select((F.col("ix") - 1).alias("ix"), "iy", F.col("bin_structure").alias("other"))
    upper = bins.select("ix", (F.col("iy") - 1).alias("iy"), F.col("bin_structure").alias("other"))
    met = bins.join(right.unionAll(upper), ["ix", "iy"]).where("bin_structure <> other")
    return met.groupBy(F.least("bin_structure", "other").alias("a"), F.greatest("bin_structure", "other").alias("b")).agg(F.count("*").alias("n_edges"))


def centroid_matrix(cells: DataFrame, dims: str = "xy") -> DataFrame:
    """(a, b, distance) between cluster centroids, all ordered pairs (X1). There are as many rows as pairs of clusters, a label set, so the product is small."""
    c = cells.groupBy("cluster").agg(*[F.avg(d).alias(d) for d in dims])
    other = c.select(F.col("cluster").alias("b"), *[F.col(d).alias(f"{d}2") for d in dims])
    d2 = sum((F.col(d) - F.col(f"{d}2")) * (F.col(d) - F.col(f"{d}2")) for d in dims)
    return c.crossJoin(other).select(F.col("cluster").alias("a"), "b", F.round(F.sqrt(d2), 6).alias("distance"))


def ultrametric_violations(matrix: DataFrame, slack: float = 1e-6) -> DataFrame:
    """Pairs (a, b) of a distance matrix with a third label k such that d(a, b) > max(d(a, k), d(k, b)) + slack * largest (X8), and by how much at most."""
    top = matrix.agg(F.max("distance").alias("largest"))
    ak = matrix.select("a", F.col("b").alias("k"), F.col("distance").alias("d1"))
    kb = matrix.select(F.col("a").alias("k"), "b", F.col("distance").alias("d2"))
    excess = F.col("distance") - F.greatest("d1", "d2")
    worst = matrix.where("a < b").join(ak, "a").join(kb, ["k", "b"]).groupBy("a", "b").agg(F.max(excess).alias("excess"))
    return worst.crossJoin(F.broadcast(top)).where(F.col("excess") > slack * F.col("largest")).select("a", "b", F.round("excess", 6).alias("excess"))


def confidence(matrix: DataFrame, groups: Spec) -> DataFrame:
    """Mean distance within and between groups of labels, and their difference."""
    t = spec_table(matrix.sparkSession, groups).select("cluster", "structure_id")
    a, b = t.withColumnsRenamed({"cluster": "a", "structure_id": "ga"}), t.withColumnsRenamed({"cluster": "b", "structure_id": "gb"})
    rows = matrix.where("a <> b").join(F.broadcast(a), "a").join(F.broadcast(b), "b")
    inner, outer = F.avg(F.when(F.col("ga") == F.col("gb"), F.col("distance"))), F.avg(F.when(F.col("ga") != F.col("gb"), F.col("distance")))
    return rows.groupBy(F.col("ga").alias("structure_id")).agg(F.round(inner, 6).alias("inner_mean"), F.round(outer, 6).alias("outer_mean"), F.round(outer - inner, 6).alias("gap"))


def order_by_centroid(cells: DataFrame) -> DataFrame:
    """(structure_id, cx, cy, place): structures named in order of their centroid, x first."""
    c = cells.where("structure_id > 0").groupBy("structure_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    place = F.row_number().over(W.orderBy("cx", "cy", "structure_id"))  # one row per structure
    return c.select("structure_id", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), place.cast("bigint").alias("place"))
