"""Concave outlines of points: the border of the union of Delaunay triangles whose circumradius is under a limit.

No triangulation is made. A circle of the limit's radius that touches a point and holds no other can be rolled about it
through an open angle; where it is stopped by another point, the two are an edge of the border. So what a point needs
are the directions of its neighbours within the circle's diameter, which bins bring together exactly, whatever the
partitioning. Points inside are told first by a few nearest neighbours, so only those near the border meet all about them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import k_nearest, within
from ..sources.scratch import materialize

#: Nearest neighbours by which points inside are told.
FEW = 24


def open_angles(direction: np.ndarray, reach: np.ndarray) -> list[tuple[int, int]]:
    """Neighbours between which a circle about a point is open, as (the one before the gap, the one after it), counter-clockwise.

    Neighbour i stops the circle's middle from direction - reach to direction + reach; all reaches are under a right angle.
    """
    if not len(direction):
        return []
    start = np.mod(direction - reach, 2 * math.pi)
    stop = start + 2 * reach
    order = np.argsort(start, kind="stable")
    start, stop = start[order], stop[order]
    # Twice round: what ends last of all that started before a place.
    s, e = np.concatenate([start, start + 2 * math.pi]), np.concatenate([stop, stop + 2 * math.pi])
    who = np.concatenate([order, order])
    top = np.maximum.accumulate(e)
    at = np.maximum.accumulate(np.where(e == top, np.arange(len(e)), 0))
    n = len(order)
    gaps = np.flatnonzero(s[n:] > top[n - 1 : -1] + 1e-12) + n  # in the second round all neighbours have been met
    return [(int(who[at[g - 1]]), int(who[g])) for g in gaps.tolist()]


def border(points: DataFrame, keys: list[str], point: str, radius: float) -> DataFrame:
    """(keys, a, b, before, ax, ay, bx, by, spike): directed edges of the border with the inside on the left, ``before`` the point that comes before ``a``.

    Points of one place count once, as the smallest id. A ``spike`` is an edge outside all triangles: it is passed in both
    directions, so areas don't see it. Points without a neighbour within twice the radius have no edges.
    """
    once = materialize(points.where("x is not null and y is not null").groupBy(*keys, "x", "y").agg(F.min(point).alias("p")))
    ids = ["p", "x", "y"]
    turn = F.atan2(F.col("r_y") - F.col("l_y"), F.col("r_x") - F.col("l_x"))
    reach = F.acos(F.least(F.sqrt("d2") / (2 * radius), F.lit(1.0)))

    def around(some: DataFrame) -> DataFrame:
        met = within(some, once, 2 * radius, keys=tuple(keys)).where("d2 > 0 and l_p <> r_p")
        return met.select(*[F.col(f"l_{k}").alias(k) for k in [*keys, *ids]], turn.alias("turn"), reach.alias("reach"), F.struct(F.col("r_p").alias("p"), F.col("r_x").alias("x"), F.col("r_y").alias("y")).alias("to"))

    sites = once.withColumn("site", F.struct(*keys, "p"))
    near = k_nearest(sites, sites, "site", "site", FEW + 1, 2 * radius, 2 * radius, keys=tuple(keys)).where("site <> near_site")
    near = near.join(sites.select(F.col("site").alias("near_site"), F.col("x").alias("r_x"), F.col("y").alias("r_y")).hint("merge"), "near_site")
    near = near.join(sites.select("site", *keys, "p", F.col("x").alias("l_x"), F.col("y").alias("l_y")).hint("merge"), "site")
    near = near.groupBy(*keys, "p", F.col("l_x").alias("x"), F.col("l_y").alias("y")).agg(F.collect_list(F.struct(turn.alias("turn"), reach.alias("reach"))).alias("near"))
    types = ", ".join(f"{k} {once.schema[k].dataType.simpleString()}" for k in [*keys, *ids])
    id_type = once.schema["p"].dataType.simpleString()

    def outer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = [bool(open_angles(np.array([m["turn"] for m in near]), np.array([m["reach"] for m in near]))) for near in f["near"]]
            yield f.loc[keep, [*keys, *ids]]

    def rolled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                to = r["to"]
                for i, j in open_angles(np.array([t["turn"] for t in to]), np.array([t["reach"] for t in to])):
                    a, b = to[i]["to"], to[j]["to"]
                    rows.append((*(r[k] for k in keys), r["p"], b["p"], a["p"], r["x"], r["y"], b["x"], b["y"]))
            if rows:
                yield pd.DataFrame(rows, columns=[*keys, "a", "b", "before", "ax", "ay", "bx", "by"])

    edge = materialize(near.mapInPandas(outer, types))
    full = around(edge).groupBy(*keys, *ids).agg(F.sort_array(F.collect_list(F.struct("turn", "reach", "to"))).alias("to"))
    key_types = ", ".join(f"{k} {once.schema[k].dataType.simpleString()}" for k in keys)
    found = materialize(full.mapInPandas(rolled, f"{key_types}, a {id_type}, b {id_type}, before {id_type}, ax double, ay double, bx double, by double"))
    back = found.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")).distinct().withColumn("spike", F.lit(True))
    return found.join(back, [*keys, "a", "b"], "left").withColumn("spike", F.coalesce("spike", F.lit(False)))


def sizes(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_edges, area, length) of a border; holes are taken off."""
    true = edges.where("not spike")
    return true.groupBy(*keys).agg(
        F.count("*").alias("n_edges"), (F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("area"), F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("length")
    )
