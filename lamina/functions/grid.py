"""Regular grids: bin indices, histograms, and joins of points by distance through bins."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .columns import col


@dataclass(frozen=True)
class Axis:
    """``n`` equal bins from ``low`` to ``high``; the last is closed on the right."""

    low: float
    high: float
    n: int

    @property
    def step(self) -> float:
        return (self.high - self.low) / self.n

    def clipped(self, c: Column | str) -> Column:
        """Bin of a value, values outside going to the end bins."""
        return F.least(F.greatest(F.floor((col(c) - self.low) / self.step), F.lit(0)), F.lit(self.n - 1)).cast("int")

    def inside(self, c: Column | str) -> Column:
        return (col(c) >= self.low) & (col(c) <= self.high)


def histogram(df: DataFrame, x: Axis, y: Axis, keys: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """(keys, ix, iy, value): counts or weights by bin; rows outside are dropped. Partial sums are taken before the shuffle."""
    rows = df.where(x.inside("x") & y.inside("y")).withColumns({"ix": x.clipped("x"), "iy": y.clipped("y")})
    return rows.groupBy(*(keys or []), "ix", "iy").agg((F.sum(weight) if weight is not None else F.count("*")).alias("value"))


def voxel(x: Axis, y: Axis, z: Axis) -> Column:
    """Row-major number of the voxel of (x, y, z), null outside the half-open grid."""
    ins = [(F.col(c) >= a.low) & (F.col(c) < a.high) for c, a in zip("xyz", (x, y, z), strict=True)]
    i = [F.floor((F.col(c) - a.low) / a.step) for c, a in zip("xyz", (x, y, z), strict=True)]
    return F.when(ins[0] & ins[1] & ins[2], (i[2] * y.n + i[1]) * x.n + i[0]).cast("bigint")


def within(left: DataFrame, right: DataFrame, radius: float, dims: str = "xy", keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows of equal ``keys`` at most ``radius`` apart, with ``d2``; columns come as ``l_*`` and ``r_*``.

    Both sides get the number of their bin of side ``radius``; the left is repeated for the neighbouring bins, so
    the join is an equi-join on bins whatever the size, never a product. AQE splits crowded bins.
    """
    a = left.select([F.col(c).alias(f"l_{c}") for c in left.columns])
    b = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    for d in dims:
        near = F.array(*[F.floor(F.col(f"l_{d}") / radius) + k for k in (-1, 0, 1)])
        a = a.withColumn(f"_b{d}", F.explode(near))
        b = b.withColumn(f"_b{d}", F.floor(F.col(f"r_{d}") / radius))
    d2 = sum((F.col(f"l_{d}") - F.col(f"r_{d}")) * (F.col(f"l_{d}") - F.col(f"r_{d}")) for d in dims)
    bins = [f"_b{d}" for d in dims] + [f"_k{k}" for k in keys]
    a, b = (t.withColumns({f"_k{k}": F.col(f"{n}_{k}") for k in keys}) if keys else t for n, t in (("l", a), ("r", b)))
    return a.join(b, bins).drop(*bins).withColumn("d2", d2).where(F.col("d2") <= radius * radius)


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius: float, limit: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(left id, right id, d2) of each left row's nearest right row of its ``keys``, ties to the smaller id; rows with none within ``limit`` are absent."""
    return k_nearest(left, right, left_id, right_id, 1, radius, limit, keys=keys).drop("place")


def _bins(prefix: str, dims: str, side: Column) -> dict[str, Column]:
    """Bins a little wider than ``side``, so that what rounding does to a quotient can't part points one side apart by two bins."""
    return {f"_b{d}": F.floor(F.col(f"{prefix}{d}") / (side * 1.001)) for d in dims}


def _halvings(right: DataFrame, keys: tuple[str, ...], dims: str, radius: float, enough: int) -> int:
    """How often ``radius`` is halved until a row shares its bin with ``enough`` others in the mean, or bins are as small as coordinates allow."""
    far = right.agg(F.max(F.greatest(F.lit(0.0), *[F.abs(F.col(d)) for d in dims])).alias("m")).first().m or 0.0
    most = max(0, math.floor(math.log2(radius / far) + 40)) if 0 < far < math.inf else 0
    j, step = 0, 1
    while j < most:
        n = right.groupBy(*keys, *[c.alias(k) for k, c in _bins("", dims, F.lit(radius / 2**j)).items()]).agg(F.count("*").cast("double").alias("n"))
        at = n.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("pairs")).first()
        if not at.n or at.pairs <= enough * at.n:
            break
        even = math.ceil(math.log2(at.pairs / at.n / enough) / len(dims))  # halvings that points spread evenly would need
        j, step = min(most, j + max(step, even)), step + 1
    return j


def k_nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, k: int, radius: float, limit: float, dims: str = "xy", keys: tuple[str, ...] = ()) -> DataFrame:
    """(left id, near id, d2, place) of each left row's ``k`` nearest right rows of its ``keys`` within ``limit``, ties to the smaller id.

    A left row starts at ``radius``, or where right rows are dense at the smallest of its halvings whose bin holds about ``k`` of
    them, so what it meets follows ``k`` and not the table. What is found within a radius is complete there, so only left rows
    with fewer than ``k`` are tried at twice the radius, up to ``limit``. Of right rows at one place the ``k`` of smallest ids serve.
    """
    near, bins = f"near_{right_id}", [f"_b{d}" for d in dims]
    twins = F.row_number().over(W.partitionBy(*keys, *dims).orderBy(right_id))
    right = right.where(F.col(right_id).isNotNull()).select(right_id, *keys, *dims).withColumn("_t", twins).where(F.col("_t") <= k).drop("_t")
    right = materialize(right.withColumnsRenamed({c: f"r_{c}" for c in [right_id, *keys, *dims]}))
    rest = materialize(left.where(F.col(left_id).isNotNull()).select(left_id, *keys, *dims).withColumnsRenamed({c: f"l_{c}" for c in [left_id, *keys, *dims]}))
    radius = min(radius, limit)
    halved = _halvings(right.withColumnsRenamed({f"r_{c}": c for c in [*keys, *dims]}), keys, dims, radius, max(16, 2 * k))
    radii = [radius / 2**j for j in range(halved, 0, -1)]
    while radius < limit:
        radii, radius = [*radii, radius], 2 * radius
    radii.append(limit)
    last = len(radii) - 1
    side = F.get(F.array(*[F.lit(r) for r in radii]), F.col("_level"))

    def leveled(t: DataFrame, prefix: str, levels: list[int]) -> DataFrame:
        t = t.withColumn("_level", F.explode(F.array(*[F.lit(i) for i in levels]))) if "_level" not in t.columns else t
        return t.withColumns({**_bins(prefix, dims, side), **{f"_k{c}": F.col(f"{prefix}{c}") for c in keys}})

    on = ["_level", *bins, *[f"_k{c}" for c in keys]]
    if halved:
        held = leveled(right, "r_", list(range(halved))).groupBy(*on).count().where(F.col("count") >= max(1, k // 2)).drop("count")
        start = leveled(rest, "l_", list(range(halved))).join(held.hint("merge"), on, "left_semi").groupBy(f"l_{left_id}").agg(F.min("_level").alias("_level"))
        rest = materialize(rest.join(start.hint("merge"), f"l_{left_id}", "left").withColumn("_level", F.coalesce("_level", F.lit(halved))))
    else:
        rest = rest.withColumn("_level", F.lit(0))
    found: list[DataFrame] = []
    d2 = sum((F.col(f"l_{d}") - F.col(f"r_{d}")) * (F.col(f"l_{d}") - F.col(f"r_{d}")) for d in dims)
    while True:
        levels = sorted(r["_level"] for r in rest.select("_level").distinct().collect())
        if not levels:
            return reduce(DataFrame.unionByName, found) if found else _no_neighbours(left, right, left_id, right_id, near)
        asked = leveled(rest, "l_", levels)
        for d in dims:
            asked = asked.withColumn(f"_b{d}", F.explode(F.array(*[F.col(f"_b{d}") + i for i in (-1, 0, 1)])))
        pairs = asked.join(leveled(right, "r_", levels).hint("merge"), on).withColumn("d2", d2).where(F.col("d2") <= side * side)
        pairs = pairs.select(F.col(f"l_{left_id}").alias(left_id), F.col(f"r_{right_id}").alias(near), "d2", "_level")
        if k == 1:
            best = pairs.groupBy(left_id).agg(F.min(F.struct("d2", near)).alias("m"), F.first("_level").alias("_level"))
            ranked = best.select(left_id, F.col(f"m.{near}").alias(near), F.col("m.d2").alias("d2"), "_level", F.lit(1).alias("place"))
        else:
            ranked = pairs.withColumn("place", F.row_number().over(W.partitionBy(left_id).orderBy("d2", near))).where(F.col("place") <= k)
        ranked = materialize(ranked)
        full = ranked.where(F.col("place") == k).select(left_id)
        if k == 1:
            found.append(ranked.drop("_level"))
        else:
            done = ranked.where((F.col("place") == k) | ((F.col("_level") == last) & (F.col("place") == 1))).select(left_id).distinct()
            found.append(ranked.join(done.hint("merge"), left_id, "left_semi").drop("_level"))
        rest = rest.where(F.col("_level") < last).join(full.withColumnRenamed(left_id, f"l_{left_id}").hint("merge"), f"l_{left_id}", "left_anti")
        rest = materialize(rest.withColumn("_level", F.col("_level") + 1))


def _no_neighbours(left: DataFrame, right: DataFrame, left_id: str, right_id: str, near: str) -> DataFrame:
    """The empty result of left rows none of which can be asked."""
    kind = right.schema[f"r_{right_id}"].dataType
    return left.where(F.lit(False)).select(F.col(left_id), F.lit(None).cast(kind).alias(near), F.lit(None).cast("double").alias("d2"), F.lit(None).cast("int").alias("place"))


def inverse_distance(neighbours: DataFrame, left_id: str, value: str) -> DataFrame:
    """(left id, value): the mean of neighbours' values by inverse distance; where some lie at no distance, of those alone."""
    exact = F.count_if(F.col("d2") == 0)
    weighted = F.sum(F.when(F.col("d2") > 0, F.col(value) / F.sqrt("d2"))) / F.sum(F.when(F.col("d2") > 0, 1 / F.sqrt("d2")))
    return neighbours.groupBy(left_id).agg(F.when(exact > 0, F.avg(F.when(F.col("d2") == 0, F.col(value)))).otherwise(weighted).alias(value))


def gaussian_mean(neighbours: DataFrame, left_id: str, values: list[str], sigma: float) -> DataFrame:
    """(left id, values): means of neighbours' values by a Gaussian of their distance."""
    w = F.exp(-F.col("d2") / (2 * sigma * sigma))
    return neighbours.groupBy(left_id).agg(*[(F.sum(F.col(v) * w) / F.sum(w)).alias(v) for v in values])
