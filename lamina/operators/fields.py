"""Fields on grids as tables of bins: smoothing, enrichment, partitions, change between two images."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Axis, histogram
from ..functions.quantiles import quantiles
from ..sources.scratch import materialize


def kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    """Weights of a Gaussian from -r to r, r = truncate * sigma rounded, summing to one."""
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def _edge(i: Column, n: int, mode: str) -> Column:
    """Index inside 0..n-1 for one that may lie outside: mirrored about the border, or the border itself."""
    if mode == "nearest":
        return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1))
    m = F.pmod(i, F.lit(2 * n))
    return F.when(m < n, m).otherwise(2 * n - 1 - m)


def smooth(bins: DataFrame, keys: list[str], sizes: dict[str, int], sigma: float, values: list[str], mode: str = "reflect") -> DataFrame:
    """Gaussian smoothing of sparse bins, one axis after the other.

    Every bin gives its value to the bins of its kernel and sums meet by bin; beyond a border the image continues
    mirrored or with its border value. An output bin o takes input i once for each image of i within reach, so the rows
    are bins times kernel width, whatever the field. Sums are taken before the shuffle.
    """
    w = kernel(sigma)
    r = len(w) // 2
    for axis, n in sizes.items():
        others = [c for c in bins.columns if c not in values and c != axis]
        # Output o reads input edge(o + k): give value to every o in 0..n-1 whose o + k is an image of this bin.
        images = F.array(*([F.col(axis), -F.col(axis) - 1, 2 * n - 1 - F.col(axis)] if mode == "reflect" else [F.col(axis)]))
        if mode == "reflect":
            spread = bins.withColumn("_at", F.explode(images)).withColumn("_k", F.explode(F.array(*[F.lit(k) for k in range(-r, r + 1)]))).withColumn("_o", F.col("_at") - F.col("_k"))
        else:
            far = F.when(F.col(axis) == 0, F.sequence(F.lit(-r), F.lit(0))).when(F.col(axis) == n - 1, F.sequence(F.lit(n - 1), F.lit(n - 1 + r))).otherwise(F.array(F.col(axis)))
            spread = bins.withColumn("_at", F.explode(far)).withColumn("_k", F.explode(F.array(*[F.lit(k) for k in range(-r, r + 1)]))).withColumn("_o", F.col("_at") - F.col("_k"))
        weight = F.element_at(F.array(*[F.lit(x) for x in w]), F.col("_k") + r + 1)
        spread = spread.where((F.col("_o") >= 0) & (F.col("_o") < n))
        bins = spread.groupBy(*others, F.col("_o").cast("int").alias(axis)).agg(*[F.sum(F.col(v) * weight).alias(v) for v in values])
    return bins.select(*keys, *sizes, *values)


def partition(cells: DataFrame, x: Axis, y: Axis, sigma: float, support: float) -> DataFrame:
    """(ix, iy, structure_id): the structure whose smoothed density, on the scale of its own upper quantile, is highest in a bin, where it reaches ``support``."""
    field = materialize(smooth(histogram(cells.where("structure_id > 0"), x, y, ["structure_id"]), ["structure_id"], {"ix": x.n, "iy": y.n}, sigma, ["value"]))
    scale = quantiles(field, ["structure_id"], ["value"], [0.95]).select("structure_id", F.col("value")[0].alias("scale"))  # a row for each structure
    scaled = field.join(F.broadcast(scale), "structure_id").withColumn("level", F.round(F.col("value") / F.col("scale"), 9)).where(F.col("level") >= support)
    return scaled.groupBy("ix", "iy").agg(F.max_by("structure_id", F.struct("level", -F.col("structure_id"))).alias("structure_id"))


def enrichment(spots: DataFrame, x: Axis, y: Axis, sigma: float, least: float) -> DataFrame:
    """(gene, ix, iy, enrichment): smoothed value over smoothed count where the bin has ``least`` spots and its enrichment is in the upper quarter."""
    at = spots.where(x.inside("x") & y.inside("y")).withColumns({"ix": x.clipped("x"), "iy": y.clipped("y")})
    bins = at.groupBy("gene", "ix", "iy").agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("v"))
    raw = bins.select("gene", "ix", "iy", F.col("n").alias("cells"))
    even = smooth(bins, ["gene"], {"ix": x.n, "iy": y.n}, sigma, ["n", "v"], "nearest").join(raw, ["gene", "ix", "iy"]).where(F.col("cells") >= least)
    e = materialize(even.withColumn("enrichment", F.round(F.try_divide("v", "n"), 9)))
    cut = quantiles(e, ["gene"], ["enrichment"], [0.75]).select("gene", F.col("enrichment")[0].alias("cut"))
    return e.join(cut, "gene").where("enrichment >= cut").select("gene", "ix", "iy", F.round("enrichment", 6).alias("enrichment"))


def robust_scaled(df: DataFrame, values: list[str]) -> DataFrame:
    """``values`` less their medians over their interquartile ranges, floored at 1e-4 (W9). The quantiles are one row."""
    q = quantiles(df, [], values, [0.25, 0.5, 0.75]).select(*[F.col(v).alias(f"_q{v}") for v in values])
    scaled = {v: (F.col(v) - F.col(f"_q{v}")[1]) / F.greatest(F.col(f"_q{v}")[2] - F.col(f"_q{v}")[0], F.lit(1e-4)) for v in values}
    return df.crossJoin(F.broadcast(q)).withColumns(scaled).select(*df.columns)


def changed(before: DataFrame, after: DataFrame, values: list[str], quantile: float) -> DataFrame:
    """(ix, iy, change) of pixels in both images whose mean absolute difference of robustly scaled features reaches the quantile."""
    before, after = robust_scaled(materialize(before), values), robust_scaled(materialize(after), values)
    both = before.join(after.withColumnsRenamed({v: f"{v}_after" for v in values}), ["ix", "iy"])
    diff = sum(F.abs(F.col(v) - F.col(f"{v}_after")) for v in values) / len(values)
    both = materialize(both.select("ix", "iy", F.round(diff, 9).alias("change")))
    cut = quantiles(both, [], ["change"], [quantile]).select(F.col("change")[0].alias("cut"))
    return both.crossJoin(F.broadcast(cut)).where("change >= cut").select("ix", "iy", F.round("change", 6).alias("change"))


def otsu(df: DataFrame, value: str, axis: Axis) -> DataFrame:
    """(threshold): the bin edge that parts a histogram with the greatest variance between its sides (X54). Only the histogram's bins are ranked."""
    h = df.where(axis.inside(value)).groupBy(axis.clipped(value).alias("b")).agg(F.count("*").alias("n"))
    a, b = h.alias("a"), h.select(F.col("b").alias("t")).alias("b")
    low = F.col("a.b") <= F.col("b.t")
    mid = axis.low + (F.col("a.b") + 0.5) * axis.step
    s = a.crossJoin(b).groupBy("t").agg(F.sum(F.when(low, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(~low, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(low, F.col("n") * mid)).alias("s0"), F.sum(F.when(~low, F.col("n") * mid)).alias("s1"))
    between = F.round(F.col("n0") * F.col("n1") * F.pow(F.col("s0") / F.col("n0") - F.col("s1") / F.col("n1"), 2), 3)
    best = s.where("n0 > 0 and n1 > 0").agg(F.max(F.struct(between.alias("v"), (-F.col("t")).alias("t"))).alias("m"))
    return best.select(F.round(axis.low + (1 - F.col("m.t")) * axis.step, 6).alias("threshold"))
