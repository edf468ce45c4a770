"""Trees of labels, contours and surroundings, held against plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions.grid import Axis, gaussian_mean, inverse_distance, k_nearest
from lamina.operators import autosplit, contours, latent, profiles

X, Y = Axis(0.0, 200.0, 40), Axis(0.0, 100.0, 20)
OPTIONS = {"n_sim": 19, "max_points": 5000}
RADII = [10.0, 15.0, 20.0, 25.0, 30.0]


@pytest.fixture(scope="module")
def tissue(spark):
    """Two clusters mixed over the left half, one packed in each quarter of the right half; a partition that gives each cluster's home to its group."""
    rng = np.random.default_rng(0)
    homes = {"A": (0, 100, 0, 100), "B": (0, 100, 0, 100), "C": (100, 200, 0, 50), "D": (100, 200, 50, 100)}
    rows = [(f"{c}{i}", float(rng.uniform(x0, x1)), float(rng.uniform(y0, y1)), c) for c, (x0, x1, y0, y1) in homes.items() for i in range(400)]
    cells = spark.createDataFrame(rows, "cell_id string, x double, y double, cluster string").cache()
    quarter = {"A": (0, 0), "B": (0, 1), "C": (1, 0), "D": (1, 1)}

    def partition(groups):
        at = {quarter[c]: i for i, g in enumerate(groups, 1) for c in g}
        bins = [(i, j, at.get((int(i >= 20), int(j >= 10)), 0)) for i in range(40) for j in range(20)]
        return spark.createDataFrame(bins, "ix int, iy int, structure_id int")

    d = {("A", "B"): 0.1, ("C", "D"): 0.4}
    matrix = spark.createDataFrame([(a, b, 0.0 if a == b else d.get((min(a, b), max(a, b)), 1.0)) for a in "ABCD" for b in "ABCD"], "a string, b string, distance double")
    return cells, partition, matrix


def test_split_along_the_tree(spark, tissue):
    cells, partition, matrix = tissue
    root = autosplit.tree_of(matrix)
    assert [(b.name, b.height, sorted(b.leaves)) for b in root.inner() if b.name != "N1"] == [("N3", 0.1, ["A", "B"]), ("N2", 0.4, ["C", "D"])] or root.leaves
    found = autosplit.explore(cells, root, partition, X, Y, RADII, **OPTIONS)
    gain = found.gain()
    assert gain["N1"] > 1 and gain["N2"] > 0.3 and gain["N3"] < 0.3
    b = {r.branch: r for r in found.branches(spark).collect()}
    assert {r.place for r in b.values()} == {1, 2, 3} and b["N1"].place == 1 and found.frame(spark).count() == 8
    for rule in autosplit.RULES:
        groups, done = autosplit.by_threshold(found, 0.3, rule)
        assert sorted(sorted(g.labels) for g in groups) == [["A", "B"], ["C"], ["D"]] and done == {"N1": "split", "N2": "split", "N3": "keep"}
    after = autosplit.cut_tree(cells, found, groups, partition, X, Y, RADII, **OPTIONS).collect()
    assert sum(r.after for r in after) < sum(r.before for r in after) and {r.label for r in after} == set("ABCD")
    for n, want in ((1, [["A", "B", "C", "D"]]), (2, [["A", "B"], ["C", "D"]]), (3, [["A", "B"], ["C"], ["D"]]), (10, [["A"], ["B"], ["C"], ["D"]])):
        assert sorted(sorted(g.labels) for g in autosplit.by_count(found, n)[0]) == want
    with pytest.raises(ValueError, match="rule"):
        autosplit.by_threshold(found, 0.3, "other")


def test_threshold_rules_on_a_weak_root():
    leaf = lambda n: autosplit.Branch(0.0, [n], name=f"C{n}")
    a, b, c, d = (leaf(x) for x in "abcd")
    low = autosplit.Branch(0.2, ["a", "b"], [a, b], "N3")
    mid = autosplit.Branch(0.5, ["a", "b", "c"], [low, c], "N2")
    root = autosplit.Branch(1.0, ["a", "b", "c", "d"], [mid, d], "N1")
    rows = [("N1", x, "", 0.0, 0.0, 0.0, 1, 1) for x in "abcd"] + [("N2", x, "", v, 0.0, 0.0, 1, 1) for x, v in (("a", 0.1), ("b", 0.1), ("c", 0.9))] + [("N3", x, "", 0.0, 0.0, 0.0, 1, 1) for x in "ab"]
    found = autosplit.Exploration(root, {}, rows)
    get = lambda rule: sorted("".join(sorted(g.labels)) for g in autosplit.by_threshold(found, 1.0, rule)[0])
    assert get("stop") == ["abcd"] and get("extract_top_branch") == ["abd", "c"] and get("split_parent") == ["ab", "c", "d"]


def test_trees_need_an_ultrametric(spark):
    rows = [("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 5.0)]
    m = spark.createDataFrame([*rows, *[(b, a, d) for a, b, d in rows], *[(x, x, 0.0) for x in "abc"]], "a string, b string, distance double")
    with pytest.raises(ValueError, match="ultrametric"):
        autosplit.tree_of(m)
    with pytest.raises(ValueError, match="without a row"):
        autosplit.label_rows(m, ["a", "z"])
    tree = autosplit.tree_of(latent.cophenetic_matrix(m))
    assert tree.height == 3.5 and sorted(tree.leaves) == ["a", "b", "c"]


def test_hotspot_groups_and_ties():
    leaf = lambda n: autosplit.Branch(0.0, [n], name=n)
    tie = autosplit.Branch(1.0, ["a", "b"], [leaf("a"), leaf("b")])
    root = autosplit.Branch(1.0, ["a", "b", "c"], [tie, leaf("c")])
    assert autosplit.hotspot_groups(root, "S", {"c", "a"}) == [("S.1", ["a"], 0.0), ("S.2", ["c"], 0.0), ("S.rest", ["b"], None)]
    assert autosplit.hotspot_groups(root, "S", {"a", "b", "c"}) == [("S.1", ["a", "b", "c"], 1.0)]


def test_group_counts(spark):
    rng = np.random.default_rng(2)
    at = np.concatenate([rng.normal(c, 0.1, (4, 2)) for c in (0, 5, 10)])
    d = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1))
    m = spark.createDataFrame([(f"l{i:02d}", f"l{j:02d}", float(d[i, j])) for i in range(12) for j in range(12)], "a string, b string, distance double")
    scores = latent.count_scores(m).orderBy(F.desc("score")).first()
    assert scores.n == 3 and scores.silhouette > 0.9 and math.isclose(scores.balance, 1)
    groups = {r.label: r.group for r in latent.balanced_groups(m, 4).collect()}
    assert len(set(groups.values())) == 3 and all(groups[f"l{i:02d}"] == groups[f"l{i // 4 * 4:02d}"] for i in range(12))
    assert max(np.bincount(list(r.group for r in latent.balanced_groups(m, 2).collect()))) <= 3


def box(x0, y0, x1, y1):
    return [(float(x0), float(y0)), (float(x1), float(y0)), (float(x1), float(y1)), (float(x0), float(y1))]


RING = "id string, label string, ring array<struct<x:double,y:double>>"


def test_contours_that_touch(spark):
    rows = [("a", "p", box(0, 0, 4, 4)), ("b", "p", box(4, 1, 8, 3)), ("c", "q", box(1, 1, 2, 2)), ("d", "q", box(10, 0, 12, 4)), ("e", "q", [(8.0, 3.0), (10.0, 5.0), (10.0, 4.0)]), ("f", "r", box(50, 50, 51, 51))]
    c = spark.createDataFrame(rows, RING)
    found = contours.topology(c, "id", 2.5)
    got = {(r.a, r.b): (round(r.exact, 9), round(r.area, 9)) for r in found.collect()}
    assert got == {("a", "b"): (2, 0), ("a", "c"): (0, 1)}
    inside = contours.enclosures(found)
    assert [(r.outer, r.inner, r.covered) for r in inside.collect()] == [("a", "c", 1.0)]
    s = {r.id: (r.n_neighbours, r.contact, r.n_overlaps, r.n_inside, r.n_around) for r in contours.summary(c, "id", found, inside).collect()}
    assert s["a"] == (1, 2.0, 1, 1, 0) and s["c"] == (0, 0.0, 1, 0, 1) and s["f"] == (0, 0.0, 0, 0, 0)
    assert [(r.a, r.b, r.n, r.length) for r in contours.label_edges(c, "id", "label", found).collect()] == [("p", "p", 1, 2.0)]
    slanted = spark.createDataFrame([("a", "p", [(0.0, 0.0), (6.0, 3.0), (0.0, 6.0)]), ("b", "p", [(2.0, 1.0), (8.0, 0.0), (8.0, 4.0)])], RING)
    assert math.isclose(contours.exact_boundaries(slanted, "id", 1.7).collect()[0].exact, math.hypot(4, 2), abs_tol=1e-6)


def test_boundaries_within_a_tolerance(spark):
    rng = random.Random(4)
    for _ in range(3):
        rings = []
        for k, (cx, cy) in enumerate([(0, 0), (7, 0.5), (3, 7)]):
            turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(9))
            rings.append((f"r{k}", "x", [(cx + 3 * math.cos(t), cy + 3 * math.sin(t)) for t in turns]))
        tol = 1.8
        got = {(r.a, r.b): (r.near, r.distance) for r in contours.near_boundaries(spark.createDataFrame(rings, RING), "id", tol, 2.0).collect()}

        def segments(ring):
            return [(np.array(p), np.array(q)) for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]

        def off(p, ring):
            best = math.inf
            for a, b in segments(ring):
                t = np.clip((p - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1)
                best = min(best, float(np.linalg.norm(p - a - t * (b - a))))
            return best

        for (i, _, p), (j, _, q) in itertools.combinations(rings, 2):
            sides, least = [], math.inf
            for own, other in ((p, q), (q, p)):
                total = 0.0
                for a, b in segments(own):
                    steps = 400
                    d = [off(a + (b - a) * (s + 0.5) / steps, other) for s in range(steps)]
                    total += np.linalg.norm(b - a) * sum(x <= tol for x in d) / steps
                    least = min(least, min(d))
                sides.append(total)
            if min(sides) > 0.05:
                assert abs(got[(i, j)][0] - min(sides)) < 0.05 and abs(got[(i, j)][1] - least) < 0.02


def test_nearest_few(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random((40, 2)), np.concatenate([rng.random((60, 2)), [[9, 9]]])
    b[0] = a[0]
    left = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)], "id int, x double, y double")
    right = spark.createDataFrame([(i, *map(float, p), float(i)) for i, p in enumerate(b)], "id int, x double, y double, v double")
    near = k_nearest(left, right, "id", "id", 4, 0.02, 0.5)
    got = {}
    for r in near.collect():
        got.setdefault(r.id, {})[r.place] = (r.near_id, r.d2)
    for i, p in enumerate(a):
        d = ((b - p) ** 2).sum(1)
        want = sorted((x, j) for j, x in enumerate(d) if x <= 0.25)[:4]
        assert [got[i][k + 1][0] for k in range(len(want))] == [j for _, j in want]
    with_v = near.join(right.select(F.col("id").alias("near_id"), "v"), "near_id")
    field = {r.id: r.v for r in inverse_distance(with_v, "id", "v").collect()}
    assert field[0] == 0.0
    d, v = np.sqrt([got[1][k][1] for k in range(1, 5)]), [float(got[1][k][0]) for k in range(1, 5)]
    assert math.isclose(field[1], (v / d).sum() / (1 / d).sum())
    soft = {r.id: r.v for r in gaussian_mean(with_v, "id", ["v"], 0.3).collect()}
    w = np.exp(-(d**2) / (2 * 0.09))
    assert math.isclose(soft[1], (w * v).sum() / w.sum())


def test_surroundings(spark):
    rng = np.random.default_rng(6)
    rows = []
    for key in ("a", "b"):
        rows += [(key, float(x), float(y), float(r)) for x, y, r in np.column_stack([rng.standard_normal((5, 2)), rng.uniform(0.5, 2, 5)])]
    turn = math.radians(100)
    rows += [("c", x * math.cos(turn) - y * math.sin(turn), x * math.sin(turn) + y * math.cos(turn), r) for k, x, y, r in rows if k == "a"] + [("d", 1.0, 0.0, 1.0)]
    s = profiles.surroundings(spark.createDataFrame(rows, "k string, dx double, dy double, ratio double"), "k")
    around = {r.k: r.around for r in s.collect()}
    assert math.isclose(sum(x.gap for x in around["a"]), 1)

    def brute(p, q):
        n = min(len(p), len(q))
        best = 0.0
        for shift in range(n):
            o = np.roll(np.arange(n), shift)
            near = math.exp(-np.mean([abs(math.log(p[i].distance / q[o[i]].distance)) for i in range(n)]))
            gap = 1 - min(1, np.mean([abs(p[i].gap - q[o[i]].gap) for i in range(n)]) / 0.25)
            area = 1 - min(1, np.mean([abs(p[i].area - q[o[i]].area) for i in range(n)]) / math.log(4))
            best = max(best, 0.45 * near + 0.35 * gap + 0.2 * area)
        return best

    pairs = s.select(F.col("k").alias("p"), F.col("around").alias("x")).crossJoin(s.select(F.col("k").alias("q"), F.col("around").alias("y")))
    got = {(r.p, r.q): r.v for r in pairs.select("p", "q", profiles.surroundings_similarity(F.col("x"), F.col("y")).alias("v")).collect()}
    assert math.isclose(got[("a", "b")], brute(around["a"], around["b"])) and math.isclose(got[("a", "c")], 1) and got[("a", "d")] == 0


def test_rings_of_a_mask(spark):
    from lamina.operators import isolines, raster

    art = [".######.", ".#....#.", ".#.##.#.", ".#..#.#.", ".######.", "#......#", "##....#."]
    mask = {(i, j) for j, row in enumerate(art) for i, c in enumerate(row) if c == "#"}
    x, y = Axis(0.0, 16.0, 8), Axis(0.0, 7.0, 7)
    parts = raster.label(spark.createDataFrame(sorted(mask), "ix int, iy int"), 8).cache()
    rings = isolines.polygons(parts, x, y)
    sizes = {r.component: r for r in isolines.polygon_sizes(rings).collect()}
    cells = {}
    for r in parts.collect():
        cells.setdefault(r.component, set()).add((r.ix, r.iy))
    assert set(sizes) == set(cells)
    for c, own in cells.items():
        border = sum(2.0 if d[1] else 1.0 for i, j in own for d in ((1, 0), (-1, 0), (0, 1), (0, -1)) if (i + d[0], j + d[1]) not in own)
        assert sizes[c].area == 2.0 * len(own) and sizes[c].perimeter == border
    # A point is inside the rings' even-odd sum exactly where its bin is in the component.
    flat = {c: [] for c in cells}
    for r in rings.collect():
        assert len(r.corners) >= 4 and len({(p.x, p.y) for p in r.corners}) >= 4
        flat[r.component].append([(p.x, p.y) for p in r.corners])
    for c, own in cells.items():
        for i, j in itertools.product(range(8), range(7)):
            px, py, inside = 2 * i + 1.0, j + 0.5, False
            for ring in flat[c]:
                for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                    inside ^= (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax
            assert inside == ((i, j) in own)
    assert rings.groupBy("component").count().where("count > 1").count() == 1


def test_isoline_of_a_packed_cluster(spark):
    from lamina.operators import isolines

    rng = np.random.default_rng(9)
    inner = 20 + 10 * rng.random((300, 2))
    outer = [p for p in 60 * rng.random((900, 2)) if not ((18 < p) & (p < 32)).all()]
    rows = [(i, float(a), float(b), 1) for i, (a, b) in enumerate(inner)] + [(1000 + i, float(a), float(b), 0) for i, (a, b) in enumerate(outer)] + [(5000, 50.0, 50.0, 1)]
    cells = spark.createDataFrame(rows, "cell_id int, x double, y double, target int")
    x = Axis(0.0, 60.0, 30)
    field = {(r.ix, r.iy): r.value for r in isolines.target_field(cells, x, x, 4, 3.0, 8.0, 0.01).collect()}
    pts, t = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows], float)
    for i, j in ((12, 12), (9, 12), (3, 20), (25, 25)):
        d = np.hypot(*(pts - (2 * i + 1, 2 * j + 1)).T)
        k = np.argsort(d)[:4]
        assert math.isclose(field[(i, j)], (t[k] / d[k]).sum() / (1 / d[k]).sum(), rel_tol=1e-9)
    kept, rings = isolines.isoline(cells, x, x, 4, 3.0, 8.0, 1.0, 0.5, 10)
    sizes = isolines.polygon_sizes(rings).collect()
    assert len(sizes) == 1 and 80 < sizes[0].area < 180 and kept.first().n_targets >= 250


def test_tracks_through_bins_are_those_of_all_pairs(spark):
    from lamina.operators import tracks

    rng = np.random.default_rng(4)
    rows = []
    for s in range(3):
        for k in range(40):
            x0, y0, w, h = *(rng.uniform(-50, 50, 2)), *(rng.uniform(1, 12, 2))
            rows.append((f"{s}:{k}", "g", s, x0, x0 + w, y0, y0 + h, w * h, x0 + w / 2, y0 + h / 2))
    df = spark.createDataFrame([tuple(float(v) if isinstance(v, float) else v for v in r) for r in rows], "id string, g string, s int, x0 double, x1 double, y0 double, y1 double, area double, cx double, cy double")
    want = set()
    for a, b in itertools.product(rows, rows):
        if b[2] == a[2] + 1:
            inter = max(0, min(a[4], b[4]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[5], b[5]))
            iou, d, ratio = inter / (a[7] + b[7] - inter), math.hypot(a[8] - b[8], a[9] - b[9]), max(a[7], b[7]) / min(a[7], b[7])
            if (iou >= 0.1 or d <= 9) and ratio <= 3:
                want.add((a[0], b[0]))
    for size in (None, 3.0, 500.0):
        got = [(r.source, r.target) for r in tracks.links(df, "s", "id", "g", 9.0, 3.0, size).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_registration_pieces(spark):
    from lamina.operators import registration as R

    v = spark.createDataFrame([(0, 0, 0), (1, 1, 1), (2, 1, 1), (5, 5, 5), (5, 6, 6), (9, 9, 9)], "ix int, iy int, iz int")
    parts = {(r.ix, r.iy, r.iz): (r.part, r.n) for r in R.volume_parts(v).collect()}
    assert {p for p, _ in parts.values()} == {"00000:00000:00000", "00005:00005:00005", "00009:00009:00009"} and parts[(2, 1, 1)] == ("00000:00000:00000", 3)
    assert R.volume_parts(v, 2).count() == 5
    rows = [("e", i, 1.0 if i % 3 else 0.2, 0.5) for i in range(30)] + [("f", i, 0.1, 0.9) for i in range(5)]
    got = {r.k: (r.n, r.support) for r in R.bootstrap_support(spark.createDataFrame(rows, "k string, i int, same double, flip double"), ["k"], "i", "same", "flip").collect()}
    assert got["e"][0] == 30 and got["e"][1] > 0.95 and got["f"] == (5, got["f"][1]) and got["f"][1] < 0.05
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 99.0, 99.0)], "id int, x double, y double")
    a = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 3.0, 0.0), (10.0, 1.0, 0.0, 8.0)], "x double, y double, dx double, dy double")
    moved = {r.id: (r.x, r.y) for r in R.tear_field(p, "id", a, 4.0, 2.5).collect()}
    w = math.exp(-1 / 8)
    assert math.isclose(moved[1][0], (1 + 3 * w) / (1 + w)) and math.isclose(moved[2][1], 2.5) and moved[3] == (99.0, 99.0)
    pad = R.padding_points(p.where("id < 3").withColumn("g", F.lit(1)), ["g"], 2, 1.0).orderBy("i").collect()
    assert [(r.x, r.y) for r in pad][:4] == [(-1.0, -1.0), (5.0, -1.0), (11.0, -1.0), (11.0, 0.0)]
