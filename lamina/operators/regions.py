"""Regions as polygon rings: measures, point membership, resampling, distances between labelled points, overlap of fields.

A ring is ``array<struct<x, y>>`` whose last vertex need not repeat the first. All measures are column expressions, so
they stay inside code generation and scale with the rows they are applied to.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Axis, histogram, nearest, within
from ..functions.ordered import PLACE, aggregate
from ..functions.quantiles import quantiles
from ..sources.scratch import materialize


def edges(ring: Column) -> Column:
    """``array<struct<a, b>>`` of a ring's edges, the closing one included."""
    rolled = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    return F.transform(F.arrays_zip(ring.alias("a"), rolled.alias("b")), lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive counter-clockwise."""
    return _sum(F.transform(edges(ring), lambda e: (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2))


def perimeter(ring: Column) -> Column:
    return _sum(F.transform(edges(ring), lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])))


def centroid(ring: Column) -> tuple[Column, Column]:
    a6 = signed_area(ring) * 6
    return tuple(F.try_divide(_sum(F.transform(edges(ring), _moment(k))), a6) for k in "xy")


def _moment(k: str):
    return lambda e: (e["a"][k] + e["b"][k]) * (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd membership of a point (J12); points on an edge are undefined, as everywhere with this rule."""
    crossed = F.filter(
        edges(ring),
        lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"]),
    )
    return F.size(crossed) % 2 == 1


def measures(regions: DataFrame, key: str) -> DataFrame:
    """Area, perimeter, centroid and compactness 4 pi A / P^2 of each region."""
    r = F.col("ring")
    cx, cy = centroid(r)
    area, length = F.abs(signed_area(r)), perimeter(r)
    return regions.select(
        key, F.round(area, 1).alias("area"), F.round(length, 6).alias("perimeter"), F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"),
        F.round(F.try_divide(4 * math.pi * area, length * length), 6).alias("compactness"),
    )


def quantile_boxes(cells: DataFrame, key: str, shift: float) -> DataFrame:
    """(region, ring): the middle half of each group's cells in x and y as a rectangle, moved by ``shift``."""
    at = lambda c, i: F.col(c)[i] + shift
    corner = lambda i, j: F.struct(at("x", i).alias("x"), at("y", j).alias("y"))
    q = quantiles(cells.select(F.col(key).alias("region"), "x", "y"), ["region"], ["x", "y"], [0.25, 0.75])
    return q.select("region", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))


def smallest_region(points: DataFrame, regions: DataFrame, point_id: str, bin_size: float) -> DataFrame:
    """``points`` inside a region, each once, with the smallest region that holds it, ties to the smaller key.

    Regions are put into every bin that their bounding box touches and meet points in an equi-join on the bin; the
    exact test follows. The smallest is an aggregate, so a point in many regions costs no sort.
    """
    at = lambda f, c: F.floor(f(F.transform("ring", lambda p: p[c])) / bin_size).cast("int")
    spread = regions.withColumn("area", F.abs(signed_area(F.col("ring"))))
    spread = spread.withColumn("_bx", F.explode(F.sequence(at(F.array_min, "x"), at(F.array_max, "x")))).withColumn("_by", F.explode(F.sequence(at(F.array_min, "y"), at(F.array_max, "y"))))
    placed = points.withColumns({"_bx": F.floor(F.col("x") / bin_size).cast("int"), "_by": F.floor(F.col("y") / bin_size).cast("int")})
    hit = placed.join(spread, ["_bx", "_by"]).where(contains(F.col("ring"), F.col("x"), F.col("y")))
    best = hit.groupBy(point_id).agg(F.min(F.struct("area", "region")).alias("m"), F.first("x").alias("x"), F.first("y").alias("y"))
    return best.select(point_id, "x", "y", F.col("m.region").alias("region"))


def region_bins(regions: DataFrame, key: str, x: Axis, y: Axis) -> DataFrame:
    """(key, ix, iy): bins whose middle a region holds (Z29, P7). A region asks the bins of its own box alone."""
    side = lambda c, a: F.sequence(*[F.least(F.greatest(F.floor((f(F.transform("ring", lambda p: p[c])) - a.low) / a.step), F.lit(-1)), F.lit(a.n)).cast("bigint") for f in (F.array_min, F.array_max)])
    spread = regions.select(key, "ring", F.explode(side("x", x)).alias("ix"), side("y", y).alias("_y")).select(key, "ring", "ix", F.explode("_y").alias("iy"))
    inside = (F.col("ix") >= 0) & (F.col("ix") < x.n) & (F.col("iy") >= 0) & (F.col("iy") < y.n)
    return spread.where(inside & contains(F.col("ring"), x.low + (F.col("ix") + 0.5) * x.step, y.low + (F.col("iy") + 0.5) * y.step)).select(key, "ix", "iy")


def resample(regions: DataFrame, key: str, every: float) -> DataFrame:
    """(key, px, py): points along the outer ring, edges cut into equal parts of at most ``every``."""
    e = regions.select(key, F.explode(edges(F.col("ring"))).alias("e"))
    length = F.hypot(F.col("e.b.x") - F.col("e.a.x"), F.col("e.b.y") - F.col("e.a.y"))
    e = e.withColumn("n", F.greatest(F.lit(1), F.ceil(length / every).cast("bigint")))
    e = e.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return e.select(key, *[(F.col(f"e.a.{c}") + (F.col(f"e.b.{c}") - F.col(f"e.a.{c}")) * F.col("i") / F.col("n")).alias(f"p{c}") for c in "xy"])


def similarity(points: DataFrame, ox: float, oy: float, degrees: float, scale: float, dx: float, dy: float) -> DataFrame:
    """Points turned and scaled about an origin, then moved (P10)."""
    c, s = F.cos(F.radians(F.lit(degrees))), F.sin(F.radians(F.lit(degrees)))
    x, y = F.col("x") - ox, F.col("y") - oy
    return points.withColumns({"x": scale * (x * c - y * s) + ox + dx, "y": scale * (x * s + y * c) + oy + dy})


def away_from(points: DataFrame, others: DataFrame, key: str, radius: float) -> DataFrame:
    """``points`` with none of ``others`` within ``radius`` (P16). Where that would leave nothing, all stay."""
    near = within(points, others, radius).select(F.col(f"l_{key}").alias(key)).distinct()
    left = points.join(near, key, "left_anti")
    return points if left.isEmpty() else left


def search_find(points: DataFrame, key: str, labels: list[str], radius: float, limit: float) -> DataFrame:
    """(a, b, distance): the mean distance from a label's points to the nearest point of another label (X1). Not symmetric."""
    p = points.where(F.col("cluster").isin(labels)).select(key, "x", "y", "cluster")
    asked = p.withColumn("b", F.explode(F.array(*[F.lit(x) for x in labels]))).where("b <> cluster").withColumn("ask", F.struct(key, "b", F.col("cluster").alias("a")))
    near = nearest(asked, p.withColumn("b", F.col("cluster")), "ask", key, radius, limit, keys=("b",))  # one search serves all pairs of labels
    return near.groupBy("ask.a", "ask.b").agg(F.round(F.avg(F.sqrt("d2")), 6).alias("distance"))


def overlap(spots: DataFrame, x: Axis, y: Axis, key: str, quantile: float) -> DataFrame:
    """(a, b, n_both, jaccard, dice) of the hot bins of each pair of fields (X32, X33): bins at or over the field's quantile.

    Fields meet bin by bin in an equi-join; there are as many result rows as pairs of field names.
    """
    at = spots.where(x.inside("x") & y.inside("y")).withColumns({"ix": x.clipped("x"), "iy": y.clipped("y")})
    sums = aggregate(at, [key, "ix", "iy"], sums={"value": F.col("value")}) if set(PLACE) <= set(spots.columns) else histogram(spots, x, y, [key], F.col("value"))
    v = materialize(sums.withColumnRenamed(key, "gene"))
    cut = quantiles(v, ["gene"], ["value"], [quantile]).select("gene", F.col("value")[0].alias("cut"))
    hot = v.join(cut, "gene").where("value >= cut").select("gene", "ix", "iy")
    n = hot.groupBy("gene").agg(F.count("*").alias("n"))
    both = hot.withColumnRenamed("gene", "a").join(hot.withColumnRenamed("gene", "b"), ["ix", "iy"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_both"))
    pairs = n.withColumnsRenamed({"gene": "a", "n": "na"}).join(n.withColumnsRenamed({"gene": "b", "n": "nb"}), F.col("a") < F.col("b"))
    k = F.coalesce("n_both", F.lit(0))
    return pairs.join(both, ["a", "b"], "left").select(
        "a", "b", k.cast("bigint").alias("n_both"), F.round(k / (F.col("na") + F.col("nb") - k), 6).alias("jaccard"), F.round(2 * k / (F.col("na") + F.col("nb")), 6).alias("dice")
    )
