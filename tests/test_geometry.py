import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from lamina.operators import alignment, overlay, raster, regions


def test_shared_area():
    sq = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
    assert math.isclose(overlay.shared_area(sq, sq + 2), 4) and overlay.shared_area(sq, sq + 5) == 0
    assert math.isclose(overlay.shared_area(sq, sq), 16)
    tri = np.array([(0, 0), (8, 0), (0, 8)], float)
    assert math.isclose(overlay.shared_area(sq, tri), 16) and math.isclose(overlay.shared_area(sq + 2, tri), 8)
    bow = np.array([(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6)], float)
    assert math.isclose(overlay.shared_area(bow, np.array([(-1, 3), (7, 3), (7, 5), (-1, 5)], float)), 8)


def test_overlaps_and_rings(spark):
    box = lambda x, y, n: [(x, y), (x + n, y), (x + n, y + n), (x, y + n)]
    r = spark.createDataFrame([("a", box(0.0, 0.0, 4.0)), ("b", box(2.0, 2.0, 4.0)), ("c", box(50.0, 50.0, 1.0))], "region string, ring array<struct<x:double,y:double>>")
    assert [(x.a, x.b, x.shared, x.iou) for x in overlay.overlaps(r, "region", 3.0).collect()] == [("a", "b", 4.0, round(4 / 28, 6))]
    pts = spark.createDataFrame([(1, 5.0, 1.0), (2, 2.0, 2.0), (3, 8.0, 0.0), (4, -1.5, 2.0)], "id int, x double, y double")
    assert sorted((x.id, x.region) for x in overlay.ring_cells(pts, r.where("region = 'a'"), 0.5, 2.0, 1.7).collect()) == [(1, "a"), (4, "a")]


def test_hull(spark):
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.random((300, 2)) * 8 + 1, [(0, 0), (10, 0), (10, 10), (0, 10), (5, 0)]])
    assert {tuple(x) for x in overlay.hull(p)} == {(0, 0), (10, 0), (10, 10), (0, 10)}
    df = overlay.hulls(spark.createDataFrame([("g", *map(float, x)) for x in p] + [(None, 1.0, 1.0)], "k string, x double, y double").repartition(5), "k")
    assert df.select(regions.signed_area(F.col("ring")).alias("s")).collect()[0].s == 100.0


def test_assignment(spark):
    rng = np.random.default_rng(1)
    for shape in ((4, 4), (3, 5), (5, 2)):
        c = rng.random(shape)
        got = sum(c[i, j] for i, j in overlay.assign(c))
        small, large = min(shape), max(shape)
        best = min(sum((c if shape[0] <= shape[1] else c.T)[i, j] for i, j in enumerate(pick)) for pick in itertools.permutations(range(large), small))
        assert math.isclose(got, best)
    df = spark.createDataFrame([("s", 1, 10, 5.0), ("s", 1, 11, 4.0), ("s", 2, 10, 4.5), ("t", 1, 10, 0.0)], "g string, a int, b int, score double")
    assert sorted((r.a, r.b) for r in overlay.best_assignment(df, ["g"], "a", "b", "score").collect()) == [(1, 11), (2, 10)]


def test_procrustes_and_consensus(spark):
    rng = random.Random(4)
    c, s = 1.5 * math.cos(math.radians(40)), 1.5 * math.sin(math.radians(40))
    rows = []
    for i in range(30):
        x, y = rng.random() * 10, rng.random() * 10
        u, v = c * x - s * y + 3, s * x + c * y - 7
        rows.append((i, "k", x, y, u + (50 if i % 6 == 5 else 0), v))
    df = spark.createDataFrame(rows, "id int, k string, x double, y double, u double, v double")
    t = alignment.procrustes(df.where("id % 6 <> 5"), ["k"])
    r = t.first()
    assert all(math.isclose(a, b, abs_tol=1e-6) for a, b in ((r.rotation, 40), (r.scale, 1.5), (r.dx, 3), (r.dy, -7))) and r.residual < 1e-4
    out = alignment.moved(df.select("id", "k", "x", "y"), t, ["k"]).join(df.select("id", "u", "v"), "id").where("id % 6 <> 5")
    assert out.agg(F.max(F.hypot(F.col("x") - F.col("u"), F.col("y") - F.col("v")))).first()[0] < 1e-6
    best = alignment.consensus(df.select("id", "x", "y", "u", "v", "k", F.lit(1.0).alias("score")), ["k"], 0.01, 40).orderBy(F.desc("inliers")).first()
    assert best.inliers == 25 and best.rotation == 40.0 and best.scale == 1.5


def test_thin_plate_meets_its_landmarks(spark):
    rng = np.random.default_rng(5)
    a, b = rng.random((12, 2)) * 10, rng.random((12, 2)) * 10
    pairs = spark.createDataFrame([(i, *map(float, x), *map(float, y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "id int, x double, y double, u double, v double")
    pairs = pairs.withColumns({"k": F.lit("g"), "score": F.lit(1.0)})
    more = pairs.select("id", "x", "y", "k").union(spark.createDataFrame([(99, 1.0, 2.0, "other")], "id int, x double, y double, k string"))
    got = alignment.landmark_warp(more, pairs, "k", 1_000_000).orderBy("id").collect()
    assert np.allclose([(r.x, r.y) for r in got], [*b, (1, 2)], atol=1e-6)
    assert alignment.landmark_warp(pairs, pairs.limit(2), "k", 100) is pairs
    assert alignment.spread_landmarks(pairs, "k", 9).count() <= 9


def dense(df, nx, ny):
    out = np.zeros((nx, ny), dtype=bool)
    for r in df.collect():
        out[r.ix, r.iy] = True
    return out


def test_morphology(spark):
    rng = np.random.default_rng(6)
    m = rng.random((12, 9)) < 0.55
    df = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(m), strict=True)], "ix int, iy int")
    pad = np.pad(m, 1)
    views = [pad[1 + dx : 13 + dx, 1 + dy : 10 + dy] for dx, dy in raster.CROSS]
    assert (dense(raster.dilate(df, 12, 9), 12, 9) == np.any(views, axis=0)).all()
    assert (dense(raster.erode(df, 12, 9), 12, 9) == np.all(views, axis=0)).all()
    seen, parts = np.zeros_like(m, dtype=int), {}
    for i, j in sorted(zip(*np.nonzero(m), strict=True), key=lambda p: p[1] * 12 + p[0]):
        if not seen[i, j]:
            name, stack = j * 12 + i, [(i, j)]
            seen[i, j] = name + 1
            while stack:
                a, b = stack.pop()
                parts[(int(a), int(b))] = int(name)
                for dx, dy in raster.CROSS[1:]:
                    p, q = a + dx, b + dy
                    if 0 <= p < 12 and 0 <= q < 9 and m[p, q] and not seen[p, q]:
                        seen[p, q] = name + 1
                        stack.append((p, q))
    assert {(r.ix, r.iy): r.component for r in raster.label(df, 12).collect()} == parts
    ring = spark.createDataFrame([(i, j) for i in range(2, 7) for j in range(2, 7) if i in (2, 6) or j in (2, 6)] + [(0, 0)], "ix int, iy int")
    assert dense(raster.fill_holes(ring, 9, 9), 9, 9).sum() == 26 and raster.large_parts(ring, 9, 5).count() == 16


def test_signed_distance(spark):
    grid = [(i, j, 3 <= i <= 6 and 3 <= j <= 6) for i in range(10) for j in range(10)]
    got = {(r.ix, r.iy): r.distance for r in raster.signed_distance(spark.createDataFrame(grid, "ix int, iy int, ins boolean"), "ins", 1.0, 64.0).collect()}
    for i, j, ins in grid:
        d = min(math.hypot(i - a, j - b) for a, b, o in grid if o != ins)
        assert math.isclose(got[(i, j)], -d if ins else d, abs_tol=1e-5)


def test_orientation_is_the_best_of_all(spark):
    from lamina.operators import orientation

    rng = random.Random(7)
    rows = [(g, i, *(float(rng.randint(0, 9)) for _ in range(4))) for g in range(12) for i in range(5)]
    got = {r.g: r for r in orientation.best_orientation(spark.createDataFrame(rows, "g int, i int, s00 double, s01 double, s10 double, s11 double").repartition(3), ["g"], "i").collect()}
    for g in range(12):
        e = [r[2:] for r in rows if r[0] == g]
        total = {p: sum(s[2 * a + b] for s, a, b in zip(e, p, p[1:], strict=False)) for p in itertools.product((0, 1), repeat=6)}
        path = tuple(map(int, got[g].path))
        assert got[g].score == max(total.values()) == total[path]
        assert got[g].margin == max(total.values()) - max(v for p, v in total.items() if p[-1] != path[-1])


def test_structure_quality_uses_every_cell_under_the_cap(spark):
    from lamina.plans import geometry

    rows = geometry.x20_structure_quality(spark, "/root/testdata/sf0.01").collect()
    assert any(r.n_cells > 1500 for r in rows) and all(r.n_used == min(r.n_cells, 20_000) for r in rows)
    assert all(abs(r.p_tissue * 50 - round(r.p_tissue * 50)) < 1e-3 for r in rows)
