"""Tiled rasters, watersheds and instances, held against brute force on small rasters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions.grid import Axis
from lamina.operators import instances, tiles

NX, NY = 37, 29


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(0)
    return {k: rng.random((NY, NX)) < p for k, p in (("a", 0.62), ("b", 0.55), ("c", 0.0))}


@pytest.fixture(scope="module")
def bins(spark, masks):
    return spark.createDataFrame([(k, int(x), int(y)) for k, m in masks.items() for y, x in zip(*np.nonzero(m), strict=True)], "k string, ix int, iy int").repartition(3)


def around(x, y):
    return ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1))


def brute_parts(mask):
    out = {}
    for y, x in zip(*np.nonzero(mask), strict=True):
        stack = [] if (x, y) in out else [(x, y)]
        out.setdefault((x, y), (x, y))
        while stack:
            for q in around(*stack.pop()):
                if 0 <= q[0] < mask.shape[1] and 0 <= q[1] < mask.shape[0] and mask[q[1], q[0]] and q not in out:
                    out[q] = (x, y)
                    stack.append(q)
    return out


@pytest.mark.parametrize("size", [8, 128])
def test_parts_and_holes(bins, masks, size):
    got = {(r.k, r.ix, r.iy): r.part for r in tiles.parts(bins, ["k"], size).collect()}
    assert got == {(k, x, y): b * tiles.WIDE + a for k, m in masks.items() for (x, y), (a, b) in brute_parts(m).items()}
    if size == 128:
        return
    want = set()
    for k, m in masks.items():
        if m.any():
            rest = brute_parts(~m)
            open_ = {p for (x, y), p in rest.items() if x in (0, NX - 1) or y in (0, NY - 1)}
            want |= {(k, int(x), int(y)) for (x, y), p in rest.items() if p not in open_}
    assert {tuple(r) for r in tiles.holes(bins, ["k"], NX, NY, 16).collect()} == want


def brute_flood(level, marker):
    """Every bin takes the least of what its neighbours offer, all at once, until nothing changes."""
    fixed = {p: (level[p], 0, m) for p, m in marker.items()}
    now = dict(fixed)
    while True:
        new = dict(fixed)
        for p, v in level.items():
            offers = [(h, g + 1, m) if v <= h else (v, 0, m) for h, g, m in (now[q] for q in around(*p) if q in now)]
            if p not in fixed and offers:
                new[p] = min(offers)
        if new == now:
            return now
        now = new


@pytest.mark.parametrize("size", [7, 128])
def test_flood(spark, masks, size):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for k, m in masks.items():
        level = {(int(x), int(y)): float(rng.integers(0, 6)) for y, x in zip(*np.nonzero(m), strict=True)}
        marker = {p: i for i, p in enumerate(list(level)[:: max(1, len(level) // 5)], 1)}
        rows += [(k, *p, v, marker.get(p)) for p, v in level.items()]
        want |= {(k, *p): (h, label) for p, (h, _, label) in brute_flood(level, marker).items()}
    field = spark.createDataFrame(rows, "k string, ix int, iy int, level double, marker bigint")
    assert {(r.k, r.ix, r.iy): (r.level, r.label) for r in tiles.flood(field, ["k"], size).collect()} == want
    assert tiles.flood(field.withColumn("marker", F.lit(None).cast("bigint")), ["k"], size).count() == 0


def test_distances(bins):
    sources = bins.where("ix % 7 = 0 and iy % 5 = 0 and k = 'a'")
    at = [(r.ix, r.iy) for r in sources.collect()]
    got = {(r.k, r.ix, r.iy): r.d2 for r in tiles.squared_distances(sources, bins, ["k"]).collect()}
    assert got == {(r.k, r.ix, r.iy): min((r.ix - x) ** 2 + (r.iy - y) ** 2 for x, y in at) for r in bins.where("k = 'a'").collect()}


def test_morphology(bins, masks):
    disk = tiles.disk(2)
    on = {k: {(int(x), int(y)) for y, x in zip(*np.nonzero(m), strict=True)} for k, m in masks.items()}
    shifted = lambda p: {(p[0] + dx, p[1] + dy) for dx, dy in disk}
    assert {tuple(r) for r in tiles.dilated(bins, ["k"], disk).collect()} == {(k, *q) for k, s in on.items() for p in s for q in shifted(p)}
    assert {tuple(r) for r in tiles.eroded(bins, ["k"], disk).collect()} == {(k, *p) for k, s in on.items() for p in s if shifted(p) <= s}


def test_instances_of_planted_rings(spark):
    """Two rings that touch are parted by their lumens; a filled disk has none, and another slice holds a ring that a border cuts."""
    x, y = Axis(0.0, 400.0, 40), Axis(0.0, 300.0, 30)
    centres = {"s1": [(100, 150, 30, 70), (230, 150, 35, 70)], "s2": [(80, 80, 0, 50), (395, 200, 30, 80)]}
    cells, mask, inner = [], [], {}
    for name, shapes in centres.items():
        for ix in range(40):
            for iy in range(30):
                px, py = ix * 10 + 5, iy * 10 + 5
                d = [(np.hypot(px - cx, py - cy), lo, hi, i) for i, (cx, cy, lo, hi) in enumerate(shapes)]
                if any(r <= hi for r, _, hi, _ in d):
                    mask.append((name, 1, ix, iy))
                    if all(r >= lo for r, lo, _, _ in d):
                        cells += [(name, px + dx, py + dy, int(ix % 2 == 0)) for dx in (-2.0, 2.0) for dy in (-2.0, 2.0)]
                    else:
                        i = min(d)[3]
                        inner[name, i] = inner.get((name, i), 0) + 100.0
    df = spark.createDataFrame([(c[0], float(c[1]), float(c[2]), c[3]) for c in cells], "slice string, x double, y double, marker int")
    masks = spark.createDataFrame(mask, "slice string, structure int, ix int, iy int")
    s = instances.Settings(density_sigma=2.0, density_threshold=0.3, closing=10.0, lumen_least_area=300.0, least_area=500.0)
    found, bins = instances.instances(df, masks, x, y, s)
    rows = {r.id: r for r in found.collect()}
    assert set(rows) == {"s1_1_0001", "s1_1_0002", "s2_1_0001", "s2_1_0002"}
    left, right = rows["s1_1_0001"], rows["s1_1_0002"]
    if left.cx > right.cx:
        left, right = right, left
    for r, i in ((left, 0), (right, 1)):
        cx, cy, _, _ = centres["s1"][i]
        assert abs(r.lumen_cx - cx) < 10 and abs(r.lumen_cy - cy) < 10 and r.lumen_area <= inner["s1", i] and r.lumen_area >= 0.15 * inner["s1", i]
    assert left.cx < 165 < right.cx and left.ring_support > 0.9 and "no_lumen_seed" not in left.flags
    cut = bins.where("slice = 's1'").groupBy("instance").agg(F.min("ix").alias("low"), F.max("ix").alias("high")).collect()
    assert len(cut) == 2 and sorted((r.low, r.high) for r in cut)[0][1] <= 17
    assert all(r.no for r in found.where("slice = 's2'").select(F.col("flags").contains("no_lumen_seed").alias("no")).collect())  # a disk, and a lumen at the border
    assert sum(r.n_cells for r in rows.values()) == bins.join(df.select("slice", x.clipped("x").alias("ix"), y.clipped("y").alias("iy")), ["slice", "ix", "iy"]).count()
    assert left.area + right.area == sum(1 for m in mask if m[0] == "s1") * 100.0
    assert instances.instances(df.where("false"), masks, x, y, s)[0].where("n_cells > 0").count() == 0


def test_links_of_instances_by_shape_lumen_and_markers(spark):
    import math

    from lamina.operators import tracks

    rng = np.random.default_rng(7)
    shapes, rows = {}, []
    for s in (1, 2, 3):
        for k in range(6):
            x, y, w, h = (int(v) for v in (rng.integers(0, 30), rng.integers(0, 30), rng.integers(2, 9), rng.integers(2, 9)))
            name, group = f"{s}:{k}", "ab"[k % 2]
            shapes[name] = {(i, j) for i in range(x, x + w) for j in range(y, y + h)}
            hollow = k != 3
            rows.append((name, group, s, x + w / 2, y + h / 2, float(w * h), x + 1.0 if hollow else None, y + 1.0 if hollow else None, [float(v) for v in rng.integers(0, 3, 3)]))
    found = spark.createDataFrame(rows, "id string, g string, s int, cx double, cy double, area double, lumen_cx double, lumen_cy double, profile array<double>")
    bins = spark.createDataFrame([(r[0], r[1], r[2], *b) for r in rows for b in shapes[r[0]]], "id string, g string, s int, ix int, iy int").repartition(3)
    want = {}
    for p in rows:
        for q in rows:
            if p[1] != q[1] or q[2] != p[2] + 1:
                continue
            a, b = shapes[p[0]], shapes[q[0]]
            iou, d = len(a & b) / len(a | b), math.dist(p[3:5], q[3:5])
            ratio = max(p[5], q[5]) / min(p[5], q[5])
            lumen = math.dist(p[6:8], q[6:8]) if p[6] is not None and q[6] is not None else d
            norm = math.hypot(*p[8]) * math.hypot(*q[8])
            cosine = sum(x * y for x, y in zip(p[8], q[8], strict=True)) / norm if norm else 0.0
            if (iou >= 0.1 or d <= 12) and ratio <= 3:
                want[p[0], q[0]] = 0.3 * (0.5 * iou + 0.3 * max(0, 1 - d / 12) + 0.2 / ratio) + 0.4 * max(0, 1 - lumen / 12) + 0.3 * cosine
    got = {(r.source, r.target): r.score for r in tracks.instance_links(found, bins, "s", "g", 12.0, (0.0, 3.0)).collect()}
    assert set(got) == set(want) and len(want) > 5 and all(abs(got[k] - v) < 1e-8 for k, v in want.items())
