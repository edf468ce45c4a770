"""Level sets, held against closed forms and a walk along the outlines in plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions.grid import Axis
from lamina.operators import levels

X, Y = Axis(0.0, 24.0, 24), Axis(0.0, 20.0, 20)


def table(spark, fields):
    rows = [(k, int(ix), int(iy), float(v)) for k, f in fields.items() for (iy, ix), v in np.ndenumerate(f)]
    return spark.createDataFrame(rows, "k string, ix int, iy int, value double").repartition(3)


def walk(field, level, outside):
    """Area and number of outlines of a field by brute force: the area of each square's part over the level, cut into triangles about its crossings."""
    padded = np.full((field.shape[0] + 2, field.shape[1] + 2), outside)
    padded[1:-1, 1:-1] = field
    area, nxt = 0.0, {}
    for iy in range(padded.shape[0] - 1):
        for ix in range(padded.shape[1] - 1):
            c = [(ix, iy), (ix + 1, iy), (ix + 1, iy + 1), (ix, iy + 1)]
            v = [padded[y, x] for x, y in c]
            on = [a >= level for a in v]
            joined = sum(v) / 4 >= level
            polygons = []
            if sum(on) == 2 and on[0] == on[2] and not joined:
                polygons = [[i] for i in range(4) if on[i]]
            elif any(on):
                polygons = [[i for i in range(4) if on[i]]]
            for own in polygons:
                points = []
                for i in range(4):
                    j = (i + 1) % 4
                    if i in own:
                        points.append((c[i], None))
                    if (i in own) != (j in own):
                        t = (level - v[i]) / (v[j] - v[i])
                        points.append(((c[i][0] + (c[j][0] - c[i][0]) * t, c[i][1] + (c[j][1] - c[i][1]) * t), tuple(sorted((c[i], c[j])))))
                area += sum(p[0] * q[1] - q[0] * p[1] for (p, _), (q, _) in zip(points, points[1:] + points[:1], strict=True)) / 2
                for (_, e), (_, f) in zip(points, points[1:] + points[:1], strict=True):
                    if e and f:
                        nxt.setdefault(e, f)
    seen, n = set(), 0
    for e in nxt:
        n += e not in seen
        while e not in seen:
            seen.add(e)
            e = nxt[e]
    return area, n


@pytest.fixture(scope="module")
def fields():
    rng = np.random.default_rng(4)
    iy, ix = np.mgrid[0:20, 0:24]
    ring = 6 - np.abs(np.hypot(ix - 12, iy - 10) - 6)
    return {"noise": rng.random((20, 24)), "ring": ring, "checks": ((ix + iy) % 2).astype(float), "flat": np.zeros((20, 24)), "full": np.ones((20, 24))}


def test_steps_keep_the_inside_on_the_left():
    middles = [(0.5, 0), (1, 0.5), (0.5, 1), (0, 0.5)]
    for bits in range(16):
        for s, e in levels.STEPS[bits]:
            (ax, ay), (bx, by) = middles[s], middles[e]
            sides = [(bx - ax) * (cy - ay) - (by - ay) * (cx - ax) for cx, cy in levels.CORNERS]
            own = {0: (0, 3), 1: (0, 1), 2: (1, 2), 3: (2, 3)}
            near = lambda side: [levels.SIDES[side][0], levels.SIDES[side][1]]
            for i in set(near(s)) | set(near(e)):
                assert (sides[i] > 0) == bool(bits >> i & 1) or sides[i] == 0, (bits, s, e, own)


def test_areas_and_rings(spark, fields):
    level = 0.5
    ringed = levels.rings(levels.segments(table(spark, fields), ["k"], level, X, Y, -0.25), ["k"])
    got = {r.k: (r.area, r.n) for r in levels.ring_sizes(ringed, ["k"]).groupBy("k").agg(F.sum("area").alias("area"), F.count("*").alias("n")).collect()}
    assert set(got) == set(fields) - {"flat"}
    for k, f in fields.items():
        area, n = walk(f, level, -0.25)
        if k != "flat":
            assert abs(got[k][0] - area) < 1e-9 and got[k][1] == n, k
    with pytest.raises(ValueError, match="under the level"):
        levels.segments(table(spark, {}), ["k"], 0.5, X, Y, 0.5)


def test_outlines_in_order_and_holes(spark, fields):
    ringed = levels.rings(levels.segments(table(spark, {k: fields[k] for k in ("ring", "noise")}), ["k"], 3.0 / 6, X, Y, 0.0), ["k"])
    for r in levels.outlines(ringed, ["k"]).collect():
        p = [(c.x, c.y) for c in r.corners]
        assert abs(sum(a * d - c * b for (a, b), (c, d) in zip(p, p[1:] + p[:1], strict=True)) / 2 - r.area) < 1e-9
        assert all(math.hypot(a - c, b - d) <= math.sqrt(2) + 1e-9 for (a, b), (c, d) in zip(p, p[1:] + p[:1], strict=True))
    rows = levels.parents(ringed, ["k"], 2.0).collect()
    own = {(r.k, r.ring): r.area for r in rows}
    assert len(rows) == len(own) and all((r.area > 0) == (r.outer == r.ring) and own[r.k, r.outer] > abs(min(r.area, 0)) for r in rows)


def test_circle(spark):
    """The half level of a cone is a circle; its hole is found inside it."""
    iy, ix = np.mgrid[0:20, 0:24]
    d = np.hypot(ix - 12, iy - 10)
    field = np.minimum(np.maximum(0, 8 - d), np.maximum(0, d - 2)) / 3
    ringed = levels.rings(levels.segments(table(spark, {"c": field}), ["k"], 0.5, X, Y, 0.0), ["k"])
    outer, hole = sorted(levels.parents(ringed, ["k"], 3.0).collect(), key=lambda r: -r.area)
    assert hole.outer == outer.ring == outer.outer
    assert abs(outer.area - math.pi * 6.5**2) < 1.5 and abs(hole.area + math.pi * 3.5**2) < 1.5
