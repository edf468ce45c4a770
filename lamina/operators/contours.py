"""Contours that touch: shared boundaries, enclosures, summaries, adjacency of labels and boundary networks.

Contours are rows (key, label, ring). Edges that lie on one line meet in an equi-join on that line and a stretch of it,
edges near one another in one on bins, so no contour is ever held against all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .aggregates import degrees
from .overlay import shared_areas
from .regions import edges, perimeter, signed_area

#: A pair shares area, or an exact stretch of boundary, beyond this.
LEAST = 1e-9


def edge_table(regions: DataFrame, key: str) -> DataFrame:
    """(key, edge, ax, ay, bx, by, length) of every edge."""
    e = regions.select(key, F.posexplode(edges(F.col("ring"))).alias("edge", "e"))
    at = [F.col(f"e.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"]
    return e.select(key, "edge", *at).withColumn("length", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).where("length > 0")


def exact_boundaries(regions: DataFrame, key: str, stretch: float, digits: int = 6) -> DataFrame:
    """(a, b, exact): length along which the outlines of two regions coincide.

    An edge belongs to a line (its direction and its distance from the origin, rounded) and to every stretch of that line
    it touches; two edges share what both cover of the stretch they meet in.
    """
    e = edge_table(regions, key)
    ux, uy = (F.col("bx") - F.col("ax")) / F.col("length"), (F.col("by") - F.col("ay")) / F.col("length")
    sign = F.when((F.round(ux, 9) < 0) | ((F.round(ux, 9) == 0) & (uy < 0)), -1.0).otherwise(1.0)
    e = e.withColumns({"ux": ux * sign, "uy": uy * sign})
    s, t = F.col("ux") * F.col("ax") + F.col("uy") * F.col("ay"), F.col("ux") * F.col("bx") + F.col("uy") * F.col("by")
    line = [(F.round(c, d) + 0.0).alias(n) for n, c, d in (("_u", F.col("ux"), 9), ("_v", F.col("uy"), 9), ("_c", F.col("ux") * F.col("ay") - F.col("uy") * F.col("ax"), digits))]
    e = e.select(key, *line, F.least(s, t).alias("t0"), F.greatest(s, t).alias("t1"))
    e = e.withColumn("_s", F.explode(F.sequence(F.floor(F.col("t0") / stretch), F.floor(F.col("t1") / stretch))))
    e = e.withColumns({"t0": F.greatest("t0", F.col("_s") * stretch), "t1": F.least("t1", (F.col("_s") + 1) * stretch)}).where("t1 > t0")
    a, b = (e.withColumnsRenamed({key: n, "t0": f"{n}0", "t1": f"{n}1"}) for n in "ab")
    both = F.least("a1", "b1") - F.greatest("a0", "b0")
    return a.join(b, ["_u", "_v", "_c", "_s"]).where((F.col("a") < F.col("b")) & (both > LEAST)).groupBy("a", "b").agg(F.sum(both).alias("exact"))


def covered(p: np.ndarray, q: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The stretch of each edge ``p`` (rows ax, ay, bx, by) within ``tolerance`` of edge ``q``, as places along ``p``; empty where the first is not below the second.

    What lies within a distance of a segment is convex, so the stretch is one piece: from the first to the last place
    that is in the band beside ``q`` or in the disc about one of its ends.
    """
    a, b, c, d = p[:, :2], p[:, 2:], q[:, :2], q[:, 2:]
    length, other = np.linalg.norm(b - a, axis=1), np.linalg.norm(d - c, axis=1)
    u, v = (b - a) / length[:, None], (d - c) / other[:, None]
    cross = lambda m, n: m[:, 0] * n[:, 1] - m[:, 1] * n[:, 0]
    dot = lambda m, n: (m * n).sum(axis=1)

    def between(start: np.ndarray, slope: np.ndarray, low, high) -> tuple[np.ndarray, np.ndarray]:
        """Places s with low <= start + slope * s <= high."""
        level = np.abs(slope) < 1e-12
        inside = (start >= low) & (start <= high)
        safe = np.where(level, 1.0, slope)
        s, t = (low - start) / safe, (high - start) / safe
        return np.where(level, np.where(inside, -np.inf, np.inf), np.minimum(s, t)), np.where(level, np.where(inside, np.inf, -np.inf), np.maximum(s, t))

    across, along = between(cross(a - c, v), cross(u, v), -tolerance, tolerance), between(dot(a - c, v), dot(u, v), 0.0, other)
    pieces = [(np.maximum(across[0], along[0]), np.minimum(across[1], along[1]))]
    for end in (c, d):
        m = -dot(a - end, u)
        left = tolerance * tolerance - (dot(a - end, a - end) - m * m)
        root = np.sqrt(np.maximum(left, 0.0))
        pieces.append((np.where(left > 0, m - root, np.inf), np.where(left > 0, m + root, -np.inf)))
    low = np.min([np.where(s < t, s, np.inf) for s, t in pieces], axis=0)
    high = np.max([np.where(s < t, t, -np.inf) for s, t in pieces], axis=0)
    return np.maximum(low, 0.0), np.minimum(high, length)


def edge_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance between edges that don't cross: from an end of one to the other."""

    def to(x: np.ndarray, e: np.ndarray) -> np.ndarray:
        a, d = e[:, :2], e[:, 2:] - e[:, :2]
        t = np.clip(((x - a) * d).sum(axis=1) / (d * d).sum(axis=1), 0.0, 1.0)
        return np.linalg.norm(x - a - t[:, None] * d, axis=1)

    return np.min([to(p[:, :2], q), to(p[:, 2:], q), to(q[:, :2], p), to(q[:, 2:], p)], axis=0)


def near_boundaries(regions: DataFrame, key: str, tolerance: float, bin_size: float) -> DataFrame:
    """(a, b, near, distance): the lesser of the lengths of each outline within ``tolerance`` of the other, and how near they come."""
    e = edge_table(regions, key)
    cover = lambda c, by: F.sequence(F.floor((F.least(f"a{c}", f"b{c}") - by) / bin_size), F.floor((F.greatest(f"a{c}", f"b{c}") + by) / bin_size))
    binned = lambda by: e.withColumn("_x", F.explode(cover("x", by))).withColumn("_y", F.explode(cover("y", by)))
    p, q = (binned(by).withColumnsRenamed({c: f"{n}_{c}" for c in (key, *e.columns[1:])}) for n, by in (("p", 0.0), ("q", tolerance)))
    met = p.join(q, ["_x", "_y"]).where(F.col(f"p_{key}") != F.col(f"q_{key}")).drop("_x", "_y").dropDuplicates([f"p_{key}", "p_edge", f"q_{key}", "q_edge"])
    sides = [c for n in "pq" for c in (f"{n}_ax", f"{n}_ay", f"{n}_bx", f"{n}_by")]
    own, other = f"p_{key}", f"q_{key}"
    columns = met.select(F.col(own).alias("own"), F.col(other).alias("other"), "p_edge", *sides)
    schema = T.StructType([*columns.schema[:3], *[T.StructField(c, T.DoubleType()) for c in "std"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in sides])
            s, t = covered(e[:, :4], e[:, 4:], tolerance)
            rows = pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(s), pa.array(t), pa.array(edge_distance(e[:, :4], e[:, 4:]))], names=["own", "other", "p_edge", "s", "t", "d"])
            yield rows.filter(pa.array(s < t))

    met = columns.mapInArrow(run, schema)
    w = W.partitionBy("own", "other", "p_edge").orderBy("s", "t").rowsBetween(W.unboundedPreceding, -1)  # one edge and its few neighbours
    new = F.greatest(F.col("t") - F.greatest(F.col("s"), F.coalesce(F.max("t").over(w), F.col("s"))), F.lit(0.0))
    sides = met.withColumn("new", new).groupBy("own", "other").agg(F.sum("new").alias("length"), F.min("d").alias("d"))
    first = sides.where("own < other").select(F.col("own").alias("a"), F.col("other").alias("b"), F.col("length").alias("la"), "d")
    second = sides.where("own > other").select(F.col("other").alias("a"), F.col("own").alias("b"), F.col("length").alias("lb"))
    return first.join(second, ["a", "b"]).select("a", "b", F.least("la", "lb").alias("near"), F.col("d").alias("distance"))


def topology(regions: DataFrame, key: str, bin_size: float, tolerance: float = 0.0, least: float = 0.0) -> DataFrame:
    """(a, b, exact, shared, area, aa, ab, pa, pb, fraction_a, fraction_b, jaccard, neighbours, overlapping) of contours that touch or overlap.

    Where outlines nowhere coincide and no area is shared, a boundary within ``tolerance`` counts as shared.
    """
    size = regions.select(key, F.abs(signed_area(F.col("ring"))).alias("area"), perimeter(F.col("ring")).alias("length"))
    pairs = exact_boundaries(regions, key, bin_size).join(shared_areas(regions, key, bin_size).select("a", "b", F.col("shared").alias("both")), ["a", "b"], "full")
    exact, both = F.coalesce("exact", F.lit(0.0)), F.coalesce("both", F.lit(0.0))
    if tolerance > 0:
        pairs = pairs.join(near_boundaries(regions, key, tolerance, bin_size), ["a", "b"], "full")
        shared = F.when(exact > LEAST, exact).when((both > LEAST) | (F.coalesce("distance", F.lit(0.0)) <= LEAST), 0.0).otherwise(F.coalesce("near", F.lit(0.0)))
    else:
        shared = exact
    pairs = pairs.select("a", "b", exact.alias("exact"), shared.alias("shared"), both.alias("area"))
    pairs = pairs.join(size.withColumnsRenamed({key: "a", "area": "aa", "length": "pa"}), "a").join(size.withColumnsRenamed({key: "b", "area": "ab", "length": "pb"}), "b")
    s = F.col("shared")
    out = pairs.select(
        "a", "b", "exact", "shared", "area", "aa", "ab", "pa", "pb", (s / F.col("pa")).alias("fraction_a"), (s / F.col("pb")).alias("fraction_b"),
        (s / (F.col("pa") + F.col("pb") - s)).alias("jaccard"), (s > least).alias("neighbours"), (F.col("area") > LEAST).alias("overlapping"),
    )
    return out.where("neighbours or overlapping")


def enclosures(found: DataFrame, least: float = 0.95) -> DataFrame:
    """(outer, inner, covered, occupied) of pairs of a :func:`topology` where ``least`` of the smaller contour lies in the larger."""
    larger = F.col("aa") > F.col("ab")
    inner, outer = F.least("aa", "ab"), F.greatest("aa", "ab")
    rows = found.where(F.col("overlapping") & (F.abs(F.col("aa") - F.col("ab")) > LEAST) & (F.col("area") / inner >= least))
    return rows.select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("outer"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("inner"), (F.col("area") / inner).alias("covered"), (F.col("area") / outer).alias("occupied"))


def summary(regions: DataFrame, key: str, found: DataFrame, enclosed: DataFrame) -> DataFrame:
    """(key, n_neighbours, contact, contact_fraction, n_overlaps, n_inside, n_around) of every contour, those without a partner included."""
    ends = [F.struct(F.col(p).alias("k"), F.col(q).alias("o"), F.col(f"p{p}").alias("length")) for p, q in ("ab", "ba")]
    sides = found.select(F.explode(F.array(*ends)).alias("e"), "shared", "neighbours", "overlapping").select(F.col("e.k").alias(key), "e.o", "e.length", "shared", "neighbours", "overlapping")
    s = sides.groupBy(key).agg(F.count_if("neighbours").alias("n"), F.sum(F.when(F.col("neighbours"), F.col("shared")).otherwise(0.0)).alias("c"), F.count_if("overlapping").alias("v"), F.first("length").alias("length"))
    around = enclosed.groupBy(F.col("outer").alias(key)).agg(F.count("*").alias("i"))
    inside = enclosed.groupBy(F.col("inner").alias(key)).agg(F.count("*").alias("u"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    j = regions.select(key).join(s, key, "left").join(around, key, "left").join(inside, key, "left")
    return j.select(
        key, zero("n").alias("n_neighbours"), F.coalesce("c", F.lit(0.0)).alias("contact"), F.coalesce(F.try_divide("c", "length"), F.lit(0.0)).alias("contact_fraction"),
        zero("v").alias("n_overlaps"), zero("i").alias("n_inside"), zero("u").alias("n_around"),
    )


def label_edges(regions: DataFrame, key: str, label: str, found: DataFrame) -> DataFrame:
    """(a, b, n, length): pairs of contours of two labels that are neighbours, and the boundary they share (X17); a label with itself included."""
    of = regions.select(F.col(key).alias("k"), F.col(label).alias("label"))
    rows = found.where("neighbours").join(of.withColumnsRenamed({"k": "a", "label": "la"}), "a").join(of.withColumnsRenamed({"k": "b", "label": "lb"}), "b")
    return rows.groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.count("*").alias("n"), F.sum("shared").alias("length"))


def label_matrix(labels: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b, length): :func:`label_edges` for all ordered pairs of ``labels`` (column label, a bounded set), zero where there is none."""
    both = found.select("a", "b", "length").unionByName(found.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "length"))
    grid = labels.select(F.col("label").alias("a")).crossJoin(labels.select(F.col("label").alias("b")))
    return grid.join(both, ["a", "b"], "left").select("a", "b", F.coalesce("length", F.lit(0.0)).alias("length"))


def filtered(found: DataFrame, drop: list, least_length: float = 0.0, least_pairs: int = 1, top: int | None = None) -> DataFrame:
    """Edges between other labels than ``drop``, long and frequent enough, and of those the ``top`` longest."""
    rows = found.where(~F.col("a").isin(drop) & ~F.col("b").isin(drop) if drop else F.lit(True)).where((F.col("length") >= least_length) & (F.col("n") >= least_pairs))
    return rows.orderBy(F.desc("length"), F.desc("n"), "a", "b").limit(top) if top is not None else rows


def network_nodes(found: DataFrame) -> DataFrame:
    """(node, n_neighbours, n_edges, strength, mean_boundary) of a boundary network."""
    d = degrees(found.select("a", "b", "length"), "a", "b", "length")
    return d.withColumn("mean_boundary", F.round(F.col("strength") / F.col("n_edges"), 4))
