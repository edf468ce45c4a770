"""Alignment of slices: rigid and similarity fits from sums, consensus of pairs, thin-plate warps, drift."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import first_of, top_k


def procrustes(pairs: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """(keys, rotation in degrees, scale, dx, dy, residual) that takes (x, y) to (u, v) with least squares.

    Everything comes from weighted sums, so a group of any size is one partial aggregation; the residual is the root
    mean square, by the same sums.
    """
    w = weight if weight is not None else F.lit(1.0)
    sums = {"w": w, **{c: w * F.col(c) for c in "xyuv"}, "xu": w * F.col("x") * F.col("u"), "yv": w * F.col("y") * F.col("v"), "xv": w * F.col("x") * F.col("v"), "yu": w * F.col("y") * F.col("u")}
    sums |= {"s": w * (F.col("x") * F.col("x") + F.col("y") * F.col("y")), "t": w * (F.col("u") * F.col("u") + F.col("v") * F.col("v"))}
    a = pairs.groupBy(*keys).agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()]).where("_w > 0")
    m = {c: F.col(f"_{c}") / F.col("_w") for c in "xyuv"}
    dot = F.col("_xu") + F.col("_yv") - F.col("_w") * (m["x"] * m["u"] + m["y"] * m["v"])
    cross = F.col("_xv") - F.col("_yu") - F.col("_w") * (m["x"] * m["v"] - m["y"] * m["u"])
    spread, target = F.col("_s") - F.col("_w") * (m["x"] * m["x"] + m["y"] * m["y"]), F.col("_t") - F.col("_w") * (m["u"] * m["u"] + m["v"] * m["v"])
    size = F.sqrt(dot * dot + cross * cross)
    a = a.withColumns({"_c": F.try_divide(dot, spread), "_d": F.try_divide(cross, spread), "_r": F.sqrt(F.greatest(target - F.try_divide(size * size, spread), F.lit(0.0)) / F.col("_w"))})
    return a.select(
        *keys, F.degrees(F.atan2("_d", "_c")).alias("rotation"), F.hypot("_c", "_d").alias("scale"),
        (m["u"] - F.col("_c") * m["x"] + F.col("_d") * m["y"]).alias("dx"), (m["v"] - F.col("_d") * m["x"] - F.col("_c") * m["y"]).alias("dy"), F.col("_r").alias("residual"),
    )


def moved(points: DataFrame, transforms: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` under the transform of their slice (X36); points of slices without one stay. Slices are few, so Spark may broadcast them."""
    p = points.join(transforms.select(*keys, "rotation", "scale", "dx", "dy"), keys, "left")
    c, s = F.cos(F.radians("rotation")) * F.col("scale"), F.sin(F.radians("rotation")) * F.col("scale")
    x, y = c * F.col("x") - s * F.col("y") + F.col("dx"), s * F.col("x") + c * F.col("y") + F.col("dy")
    return p.select(*[F.coalesce({"x": x, "y": y}.get(n, F.col(n)), F.col(n)).alias(n) if n in "xy" else F.col(n) for n in points.columns])


def consensus(anchors: DataFrame, keys: list[str], limit: float, top: int) -> DataFrame:
    """(keys, a, b, inliers, residual, rotation, scale) of trials (X47): each pair of a group's ``top`` best anchors defines a similarity, and all anchors of the group vote.

    Anchors have id, x, y, u, v and score. The cap is on trials alone, so votes are trials, a table of bounded size for each
    group, joined to all anchors, and one aggregate.
    """
    k = top_k(anchors, keys, [F.desc("score"), F.col("id")], top)
    a, b = (k.select(*keys, *[F.col(c).alias(f"{n}_{c}") for c in ("id", "x", "y", "u", "v")]) for n in "ab")
    t = a.join(b, keys).where(F.col("a_id") < F.col("b_id"))
    px, py, qx, qy = (F.col(f"b_{c}") - F.col(f"a_{c}") for c in "xyuv")
    n = px * px + py * py
    t = t.where(n > 0).withColumns({"_c": (px * qx + py * qy) / n, "_d": (px * qy - py * qx) / n})
    t = t.withColumns({"_dx": F.col("a_u") - F.col("_c") * F.col("a_x") + F.col("_d") * F.col("a_y"), "_dy": F.col("a_v") - F.col("_d") * F.col("a_x") - F.col("_c") * F.col("a_y")})
    votes = anchors.join(t.select(*keys, "a_id", "b_id", "_c", "_d", "_dx", "_dy"), keys)
    off = F.hypot(F.col("_c") * F.col("x") - F.col("_d") * F.col("y") + F.col("_dx") - F.col("u"), F.col("_d") * F.col("x") + F.col("_c") * F.col("y") + F.col("_dy") - F.col("v"))
    s = votes.withColumn("_e", F.round(off, 6)).groupBy(*keys, F.col("a_id").alias("a"), F.col("b_id").alias("b")).agg(
        F.count_if(F.col("_e") <= limit).alias("inliers"), F.round(F.avg(F.when(F.col("_e") <= limit, F.col("_e"))), 4).alias("residual"), F.first("_c").alias("_c"), F.first("_d").alias("_d")
    )
    return s.select(*keys, "a", "b", "inliers", "residual", F.round(F.degrees(F.atan2("_d", "_c")), 4).alias("rotation"), F.round(F.hypot("_c", "_d"), 6).alias("scale"))


def drift_free(centres: DataFrame, order: str, value: str) -> DataFrame:
    """``centres`` with ``steady``: ``value`` less its line over ``order``, for three slices or more; with fewer it stays."""
    slope = centres.agg(F.regr_slope(value, F.col(order).cast("double")).alias("_s"), F.countDistinct(order).alias("_n"))
    return centres.crossJoin(F.broadcast(slope)).withColumn("steady", F.col(value) - F.when(F.col("_n") >= 3, F.col("_s")).otherwise(0.0) * F.col(order)).drop("_s", "_n")


def coverage(anchors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, quadrants, evenness): anchors, how many quarters of their own bounding box they lie in, and the entropy over quarters as a share of the most."""
    box = anchors.groupBy(*keys).agg(*[((F.min(c) + F.max(c)) / 2).alias(f"_m{c}") for c in "xy"])
    quarter = (F.col("x") >= F.col("_mx")).cast("int") * 2 + (F.col("y") >= F.col("_my")).cast("int")
    n = anchors.join(box, keys).groupBy(*keys, quarter.alias("_q")).agg(F.count("*").alias("_n"))
    p = F.col("_n") / F.col("_t")
    total = n.groupBy(*keys).agg(F.sum("_n").alias("_t"))
    return n.join(total, keys).groupBy(*keys).agg(F.max("_t").alias("n"), F.count("*").alias("quadrants"), (-F.sum(p * F.log(p)) / F.log(F.lit(4.0))).alias("evenness"))


def thin_plate(source: np.ndarray, target: np.ndarray, smooth: float = 0.0) -> np.ndarray:
    """Weights of the thin-plate spline that takes each source landmark to its target (X46); landmarks are a bounded set."""
    n = len(source)
    r2 = ((source[:, None] - source[None]) ** 2).sum(-1)
    k = np.where(r2 > 0, r2 * np.log(np.where(r2 > 0, r2, 1)) / 2, 0) + smooth * np.eye(n)
    p = np.column_stack([np.ones(n), source])
    return np.linalg.solve(np.block([[k, p], [p.T, np.zeros((3, 3))]]), np.vstack([target, np.zeros((3, 2))]))


def warp(points: DataFrame, key: str, splines: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``points`` with x and y under the thin-plate spline (landmarks, weights) of their group, batch by batch; groups without one stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xy = np.column_stack([b.column("x").to_numpy(zero_copy_only=False), b.column("y").to_numpy(zero_copy_only=False)]).astype(float)
            of = np.array(b.column(key).to_pylist(), dtype=object)
            out = xy.copy()
            for name, (landmarks, weights) in splines.items():
                rows = np.flatnonzero(of == name)
                for s in range(0, len(rows), 4096):
                    q = xy[rows[s : s + 4096]]
                    r2 = ((q[:, None] - landmarks[None]) ** 2).sum(-1)
                    k = np.where(r2 > 0, r2 * np.log(np.where(r2 > 0, r2, 1)) / 2, 0)
                    out[rows[s : s + 4096]] = k @ weights[:-3] + np.column_stack([np.ones(len(q)), q]) @ weights[-3:]
            moved_to = {"x": out[:, 0], "y": out[:, 1]}
            yield pa.RecordBatch.from_arrays([pa.array(moved_to[f.name], f.type) if f.name in moved_to else b.column(f.name) for f in b.schema], schema=b.schema)

    return points.mapInArrow(run, points.schema)


def spread_landmarks(pairs: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` pairs (id, x, y, u, v, score) of each group, evenly over its extent: the best of each field of a square grid."""
    side = max(1, int(most**0.5))
    box = pairs.groupBy(key).agg(*[f(c).alias(f"_{n}{c}") for c in "xy" for f, n in ((F.min, "l"), (F.max, "h"))])
    at = lambda c: F.least(F.floor(F.coalesce(F.try_divide(F.col(c) - F.col(f"_l{c}"), F.col(f"_h{c}") - F.col(f"_l{c}")), F.lit(0.0)) * side), F.lit(side - 1))
    placed = pairs.join(box, key).withColumns({"_i": at("x"), "_j": at("y")}).select(*pairs.columns, "_i", "_j")
    return first_of(placed, [key, "_i", "_j"], [-F.col("score"), F.col("id")]).select(*pairs.columns)


def landmark_warp(points: DataFrame, pairs: DataFrame, key: str, most: int, smooth: float = 0.0) -> DataFrame:
    """``points`` warped group by group by landmarks spread over the group (X46); groups with fewer than three landmarks stay.

    What comes to the driver is ``most`` landmarks for each label.
    """
    held: dict[str, list] = {}
    for r in spread_landmarks(pairs, key, most).collect():
        held.setdefault(r[key], []).append((r.x, r.y, r.u, r.v))
    splines = {}
    for name, rows in held.items():
        at = np.array(sorted(rows), float)
        if len(at) >= 3:
            splines[name] = (at[:, :2], thin_plate(at[:, :2], at[:, 2:], smooth))
    return warp(points, key, splines) if splines else points
