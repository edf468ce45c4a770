"""Polygons met with polygons and points: overlap areas, distances to outlines, hulls, best one-to-one matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import materialize
from .matching import components
from .regions import contains, edges, signed_area


def ring_distance(ring: Column, x: Column, y: Column) -> Column:
    """Distance from a point to the nearest edge of a ring, inside or out."""

    def to_edge(e: Column) -> Column:
        ax, ay = e["a"]["x"], e["a"]["y"]
        dx, dy = e["b"]["x"] - ax, e["b"]["y"] - ay
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - ax) * dx + (y - ay) * dy, dx * dx + dy * dy), F.lit(0.0))))
        return F.hypot(x - ax - t * dx, y - ay - t * dy)

    return F.array_min(F.transform(edges(ring), to_edge))


def ring_cells(points: DataFrame, regions: DataFrame, inner: float, outer: float, bin_size: float) -> DataFrame:
    """(points, region): points outside a region, farther than ``inner`` and within ``outer`` of its outline (J13). A point may match several.

    Regions go to every bin their bounding box, widened by ``outer``, touches, and meet points in an equi-join.
    """
    low = lambda c: F.floor((F.array_min(F.transform("ring", lambda p: p[c])) - outer) / bin_size).cast("int")
    high = lambda c: F.floor((F.array_max(F.transform("ring", lambda p: p[c])) + outer) / bin_size).cast("int")
    spread = regions.withColumn("_bx", F.explode(F.sequence(low("x"), high("x")))).withColumn("_by", F.explode(F.sequence(low("y"), high("y"))))
    placed = points.withColumns({"_bx": F.floor(F.col("x") / bin_size).cast("int"), "_by": F.floor(F.col("y") / bin_size).cast("int")})
    met = placed.join(spread, ["_bx", "_by"]).withColumn("_d", ring_distance(F.col("ring"), F.col("x"), F.col("y")))
    return met.where((F.col("_d") > inner) & (F.col("_d") <= outer) & ~contains(F.col("ring"), F.col("x"), F.col("y"))).select(*points.columns, "region")


def _crossings(ring: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Where horizontal lines cross a ring: a row for each level, in order, filled up with infinity."""
    a, b = ring, np.roll(ring, -1, axis=0)
    hit = (a[None, :, 1] > levels[:, None]) != (b[None, :, 1] > levels[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[None, :, 0] + (levels[:, None] - a[None, :, 1]) * ((b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1]))[None, :]
    at = np.sort(np.where(hit, at, np.inf), axis=1)
    most = int(hit.sum(axis=1).max(initial=0))
    return at[:, :most]


def _both(p: np.ndarray, q: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Length that two even-odd polygons share on each horizontal line."""
    x, y = _crossings(p, levels), _crossings(q, levels)
    if not x.shape[1] or not y.shape[1]:
        return np.zeros(len(levels))
    with np.errstate(invalid="ignore"):
        low, high = np.maximum(x[:, ::2, None], y[:, None, ::2]), np.minimum(x[:, 1::2, None], y[:, None, 1::2])
        return np.where(np.isfinite(high) & (high > low), high - low, 0.0).sum(axis=(1, 2))


def shared_area(p: np.ndarray, q: np.ndarray) -> float:
    """Area that two simple polygons share. Between the heights of vertices and of edge crossings the shared length is linear, so the middle of each slab gives its area."""
    a, r = p, np.roll(p, -1, axis=0) - p
    c, s = q, np.roll(q, -1, axis=0) - q
    cuts = [p[:, 1], q[:, 1]]
    for at in range(0, len(c), 1024):
        den = r[:, None, 0] * s[None, at : at + 1024, 1] - r[:, None, 1] * s[None, at : at + 1024, 0]
        dx, dy = c[None, at : at + 1024, 0] - a[:, None, 0], c[None, at : at + 1024, 1] - a[:, None, 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (dx * s[None, at : at + 1024, 1] - dy * s[None, at : at + 1024, 0]) / den
            u = (dx * r[:, None, 1] - dy * r[:, None, 0]) / den
            hit = (np.abs(den) > 1e-300) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        i, j = np.nonzero(hit)
        cuts.append(a[i, 1] + t[i, j] * r[i, 1])
    levels = np.unique(np.concatenate(cuts))
    mid, height = (levels[1:] + levels[:-1]) / 2, np.diff(levels)
    return float(sum((height[k : k + 512] * _both(p, q, mid[k : k + 512])).sum() for k in range(0, len(mid), 512)))


def flat(ring: Column) -> Column:
    """A ring as one array of x and y in turn."""
    return F.flatten(F.transform(ring, lambda v: F.array(v["x"], v["y"])))


@F.pandas_udf(T.DoubleType())
def shared_area_of(p: pd.Series, q: pd.Series) -> pd.Series:
    """Shared area of rings given as :func:`flat` arrays."""
    return pd.Series([shared_area(np.reshape(a, (-1, 2)), np.reshape(b, (-1, 2))) for a, b in zip(p, q, strict=True)], dtype=float)


def near_pairs(regions: DataFrame, key: str, bin_size: float, reach: float = 0.0) -> DataFrame:
    """(a, b), a < b, of regions whose bounding boxes, widened by ``reach``, touch a common bin."""
    low = lambda c: F.floor((F.array_min(F.transform("ring", lambda p: p[c])) - reach) / bin_size).cast("int")
    high = lambda c: F.floor((F.array_max(F.transform("ring", lambda p: p[c])) + reach) / bin_size).cast("int")
    binned = regions.select(key, F.explode(F.sequence(low("x"), high("x"))).alias("_bx"), F.sequence(low("y"), high("y")).alias("_s")).select(key, "_bx", F.explode("_s").alias("_by"))
    return binned.withColumnRenamed(key, "a").join(binned.withColumnRenamed(key, "b"), ["_bx", "_by"]).where("a < b").select("a", "b").distinct()


def shared_areas(regions: DataFrame, key: str, bin_size: float) -> DataFrame:
    """(a, b, aa, ab, shared): areas of regions that overlap, and the area they share. Boxes meet by bin, then outlines are overlaid once for each pair."""
    r = regions.select(key, flat(F.col("ring")).alias("ring"), F.abs(signed_area(F.col("ring"))).alias("area"))
    met = near_pairs(regions, key, bin_size).join(r.withColumnsRenamed({key: "a", "ring": "ra", "area": "aa"}), "a").join(r.withColumnsRenamed({key: "b", "ring": "rb", "area": "ab"}), "b")
    return met.select("a", "b", "aa", "ab", shared_area_of("ra", "rb").alias("shared")).where("shared > 1e-9")


def overlaps(regions: DataFrame, key: str, bin_size: float) -> DataFrame:
    """(a, b, shared, iou, dice, fraction) of regions that share area."""
    s = shared_areas(regions, key, bin_size)
    return s.select(
        "a", "b", F.round("shared", 1).alias("shared"), F.round(F.col("shared") / (F.col("aa") + F.col("ab") - F.col("shared")), 6).alias("iou"),
        F.round(2 * F.col("shared") / (F.col("aa") + F.col("ab")), 6).alias("dice"), F.round(F.col("shared") / F.least("aa", "ab"), 6).alias("fraction"),
    )


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the leftmost lowest."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(rows) -> list:
        out: list = []
        for x, y in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) <= 0:
                out.pop()
            out.append((x, y))
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def hulls(points: DataFrame, key: str) -> DataFrame:
    """(region, ring): the convex hull of each group (X14). Every batch sends the corners of its own hulls, so a group of any size meets as corners only."""

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, g in b.to_pandas().groupby("region"):
                h = hull(g[["x", "y"]].to_numpy(float))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(h), pa.string()), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["region", "x", "y"])

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        h = hull(g[["x", "y"]].to_numpy(float))
        return pd.DataFrame({"region": [g["region"].iloc[0]], "ring": [[{"x": float(x), "y": float(y)} for x, y in h]]})

    sent = points.select(F.col(key).cast("string").alias("region"), "x", "y").where("region is not null").mapInArrow(corners, "region string, x double, y double")
    return sent.groupBy("region").applyInPandas(whole, "region string, ring array<struct<x:double,y:double>>")


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row-column pairs of least total cost, by shortest augmenting paths; as many as the smaller side has."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((a, b) for b, a in assign(cost.T))
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        best, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool), np.zeros(m + 1, dtype=int)
        while True:
            used[j0] = True
            free = ~used
            free[0] = False
            reduced = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = free[1:] & (reduced < best[1:])
            best[1:][better], way[1:][better] = reduced[better], j0
            j1 = int(np.where(free, best, np.inf).argmin())
            step = best[j1]
            u[match[used]] += step
            v[used] -= step
            best[free] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j])


def best_assignment(pairs: DataFrame, groups: list[str], a: str, b: str, score: str) -> DataFrame:
    """One-to-one pairs of the highest total score in each group, those with a score over zero (J18). A group is one structure in one pair of slices.

    Objects that no chain of candidates connects don't bear on each other, so each connected part is solved on its own.
    """
    out = materialize(pairs.select(*groups, a, b, score))
    name = lambda c: F.concat_ws(":", F.lit(c), *[F.col(g).cast("string") for g in groups], F.col(c).cast("string"))
    parts = components(out.where(F.col(score) > 0).select(name(a).alias("u"), name(b).alias("v")), "u", "v").withColumnsRenamed({"node": "_node", "component": "_part"})
    split = out.where(F.col(score) > 0).withColumn("_node", name(a)).join(parts, "_node").drop("_node")
    columns = out.columns

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows, cols = sorted(g[a].unique()), sorted(g[b].unique())
        at = g.pivot_table(index=a, columns=b, values=score, aggfunc="max").reindex(index=rows, columns=cols).fillna(0.0).to_numpy()
        keep = {(rows[i], cols[j]) for i, j in assign(-at) if at[i, j] > 0}
        best = g.sort_values(score, ascending=False, kind="stable").drop_duplicates([a, b])
        return best[[(x, y) in keep for x, y in zip(best[a], best[b], strict=True)]][columns]

    return split.groupBy(*groups, "_part").applyInPandas(run, out.schema)
