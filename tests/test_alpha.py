"""Concave outlines, held against empty circles and areas of triangles by brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import alpha


def circumcircle(a, b, c):
    (ax, ay), (bx, by), (cx, cy) = a, b, c
    d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    if abs(d) < 1e-12:
        return None
    ux = ((ax * ax + ay * ay) * (by - cy) + (bx * bx + by * by) * (cy - ay) + (cx * cx + cy * cy) * (ay - by)) / d
    uy = ((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by * by) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / d
    return ux, uy, math.hypot(ax - ux, ay - uy)


def triangles(points, radius):
    """Edges seen once in the Delaunay triangles under the radius, and their area."""
    seen, area = {}, 0.0
    for i, j, k in itertools.combinations(range(len(points)), 3):
        c = circumcircle(points[i], points[j], points[k])
        if c is None or c[2] >= radius or any(math.hypot(x - c[0], y - c[1]) < c[2] - 1e-9 for m, (x, y) in enumerate(points) if m not in (i, j, k)):
            continue
        (ax, ay), (bx, by), (cx, cy) = points[i], points[j], points[k]
        area += abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay)) / 2
        for e in ((i, j), (j, k), (i, k)):
            seen[e] = seen.get(e, 0) + 1
    return {e for e, n in seen.items() if n == 1}, area


@pytest.mark.parametrize("radius", [0.09, 0.14, 0.3, 5.0])
def test_border_is_that_of_the_triangles(spark, radius):
    rng = np.random.default_rng(3)
    sets = {"a": [tuple(p) for p in rng.random((45, 2))], "ring": [(0.5 + r * math.cos(t), 0.5 + r * math.sin(t)) for r, t in zip(0.3 + 0.15 * rng.random(50), 2 * math.pi * rng.random(50), strict=True)], "few": [(0.1, 0.1), (0.15, 0.1)]}
    rows = [(k, i, float(x), float(y)) for k, p in sets.items() for i, (x, y) in enumerate(p)] + [("a", 99, *map(float, sets["a"][0])), ("ring", 98, None, 0.5)]
    df = spark.createDataFrame(rows, "k string, id int, x double, y double").repartition(3)
    edges = alpha.border(df, ["k"], "id", radius)
    true = edges.where("not spike").collect()
    area = {r.k: r.area for r in alpha.sizes(edges, ["k"]).collect()}
    for k, p in sets.items():
        want, size = triangles(p, radius)
        assert {tuple(sorted((r.a, r.b))) for r in true if r.k == k} == want
        assert math.isclose(area.get(k, 0.0), size, abs_tol=1e-9)
    # Every edge is followed by one that starts where it ends.
    follows = {(r.k, r.before, r.a) for r in edges.collect()}
    assert follows == {(r.k, r.a, r.b) for r in edges.collect()}


def test_dense_points_inside_are_left_out_early(spark):
    grid = spark.range(3600).select(F.lit("g").alias("k"), "id", (F.col("id") % 60 + 0.001 * F.rand(1)).alias("x"), (F.floor(F.col("id") / 60) + 0.001 * F.rand(2)).alias("y"))
    s = alpha.sizes(alpha.border(grid, ["k"], "id", 1.5), ["k"]).first()
    assert 59 * 59 - 8 < s.area < 59.1 * 59.1 and 230 <= s.n_edges <= 240
