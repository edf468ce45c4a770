import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import columns as C
from lamina.functions.grid import Axis, histogram, nearest, within
from lamina.operators import decisions, fields, latent, matching, patterns, regions, structure


def points(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.random() * 10, rng.random() * 10) for i in range(n)] + [(n, 0.0, 0.0), (n + 1, 0.0, 0.0)]
    return spark.createDataFrame(rows, "id int, x double, y double"), rows


def test_within_and_nearest(spark):
    df, rows = points(spark, 120)
    got = {(r.l_id, r.r_id) for r in within(df, df, 1.3).collect()}
    assert got == {(a, b) for a, ax, ay in rows for b, bx, by in rows if (ax - bx) ** 2 + (ay - by) ** 2 <= 1.3 * 1.3}
    left, right = df.where("id % 3 = 0"), df.where("id % 3 <> 0")
    got = {r.id: r.near_id for r in nearest(left, right, "id", "id", 0.2, 100.0).collect()}
    want = {a: min(((ax - bx) ** 2 + (ay - by) ** 2, b) for b, bx, by in rows if b % 3)[1] for a, ax, ay in rows if a % 3 == 0}
    assert got == want


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0), (10.0, 10.0), (9.999, 5.0), (10.001, 1.0), (-0.1, 1.0), (float("nan"), 1.0)], "x double, y double")
    got = {(r.ix, r.iy): r.value for r in histogram(df, Axis(0, 10, 5), Axis(0, 10, 5)).collect()}
    assert got == {(0, 0): 1, (4, 4): 1, (4, 2): 1}


def test_labels(spark):
    raw = [("10",), ("10.0",), (" 10 ",), ("c10",), ("Cluster_3",), ("1e1",), (None,), ("NaN",), ("x.0",)]
    df = spark.createDataFrame(raw, "v string").select("v", C.canonical_label("v").alias("a"), C.loose_label("v").alias("b"))
    got = {r.v: (r.a, r.b) for r in df.collect()}
    assert got["10.0"] == ("10", "10") and got[" 10 "] == ("10", "10") and got["c10"] == ("c10", "10") and got["Cluster_3"] == ("Cluster_3", "3") and got["1e1"][0] == "1e1" and got["1e1"][1] == "10" and got[None] == ("", "")
    names = spark.createDataFrame([("g10",), ("g2",), ("g1a3",)], "v string")
    assert [r.v for r in names.orderBy(C.natural_key("v")).collect()] == ["g1a3", "g2", "g10"]


def test_purity_of_a_clean_partition(spark):
    rows = [(i, float(i % 10), float(i // 10 % 10), "a" if i % 10 < 5 else "b") for i in range(400)] + [(900, 1.0, 1.0, "z")]
    cells = structure.assign_structure(spark.createDataFrame(rows, "cell_id int, x double, y double, cluster string"), [(1, "A", "a"), (2, "B", "b")])
    x = Axis(0.0, 10.0, 10)
    bins = structure.dominant_bins(cells, x, x)
    found = structure.purity_recall(structure.assign_partition(cells, bins, x, x)).collect()
    assert {(r.structure_id, r.n_cells, r.purity, r.recall) for r in found} == {(1, 200, 1.0, 1.0), (2, 200, 1.0, 1.0)}
    assert [(r.a, r.b, r.n_edges) for r in structure.bin_adjacency(bins).collect()] == [(1, 2, 10)]
    with pytest.raises(ValueError):
        structure.spec_table(spark, [(1, "A", "a"), (2, "B", "a")])


def test_ultrametric(spark):
    m = [("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 5.0)]
    rows = m + [(b, a, d) for a, b, d in m] + [(x, x, 0.0) for x in "abc"]
    bad = structure.ultrametric_violations(spark.createDataFrame(rows, "a string, b string, distance double")).collect()
    assert {(r.a, r.b) for r in bad} == {("b", "c")}
    tree = {("A", "B"): 0.1, ("C", "D"): 0.4}
    flat = [(a, b, 0.0 if a == b else tree.get((min(a, b), max(a, b)), 1.0)) for a in "ABCD" for b in "ABCD"]
    df = spark.createDataFrame(flat, "a string, b string, distance double")
    assert structure.ultrametric_violations(df).isEmpty()
    assert {r.label: r.group for r in latent.label_groups(df, 2).collect()} == {"A": 1, "B": 1, "C": 2, "D": 2}
    assert {r.label: r.group for r in latent.label_groups(df, 3).collect()} == {"A": 1, "B": 1, "C": 2, "D": 3}


def test_trees():
    d = np.array([[0, 1, 4, 5], [1, 0, 4, 5], [4, 4, 0, 2], [5, 5, 2, 0]], float)
    single = latent.linkage(d, "single")
    assert [h for *_, h in single] == [1, 2, 4] and latent.cophenetic(4, single)[0, 3] == 4
    assert [h for *_, h in latent.linkage(d, "complete")] == [1, 2, 5] and [h for *_, h in latent.linkage(d)] == [1, 2, 4.5]


def test_region_measures(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]
    df = spark.createDataFrame([("r", ring), ("empty", [(0.0, 0.0)] * 3)], "region string, ring array<struct<x:double,y:double>>")
    m = {r.region: r for r in regions.measures(df, "region").collect()}
    assert (m["r"].area, m["r"].perimeter, m["r"].cx, m["r"].cy) == (12.0, 14.0, 2.0, 1.5) and m["empty"].area == 0 and m["empty"].cx is None
    inside = df.where("region = 'r'").crossJoin(spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (3.9, 2.9), (-1.0, 2.0)], "x double, y double"))
    assert [(r.x, r.y) for r in inside.where(regions.contains(F.col("ring"), F.col("x"), F.col("y"))).orderBy("x").collect()] == [(1.0, 1.0), (3.9, 2.9)]
    nested = spark.createDataFrame([("big", [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]), ("small", [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0)])], "region string, ring array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(1, 3.0, 3.0), (2, 7.0, 7.0), (3, 11.0, 1.0)], "id int, x double, y double")
    assert {r.id: r.region for r in regions.smallest_region(pts, nested, "id", 3.0).collect()} == {1: "small", 2: "big"}


def test_crowded_filter_never_empties(spark):
    df, _ = points(spark, 30)
    assert regions.away_from(df, df, "id", 100.0).count() == df.count()


@pytest.mark.parametrize("mode", ["reflect", "nearest"])
def test_smoothing_equals_dense(spark, mode):
    rng = np.random.default_rng(0)
    a = np.where(rng.random((9, 7)) < 0.4, rng.random((9, 7)), 0)
    w = fields.kernel(1.2)
    r = len(w) // 2
    pad = np.pad(a, r, mode="symmetric" if mode == "reflect" else "edge")
    want = sum(w[i] * pad[i : i + 9, :] for i in range(2 * r + 1))
    want = sum(w[j] * want[:, j : j + 7] for j in range(2 * r + 1))
    bins = spark.createDataFrame([("k", int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "key string, ix int, iy int, value double")
    got = np.zeros((9, 7))
    for row in fields.smooth(bins, ["key"], {"ix": 9, "iy": 7}, 1.2, ["value"], mode).collect():
        got[row.ix, row.iy] = row.value
    assert np.allclose(got, want)


def test_greedy_and_components(spark):
    rng = random.Random(2)
    pairs = list({(rng.randint(0, 30), 100 + rng.randint(0, 30)): None for _ in range(200)})
    rows = [(a, b, float(rng.randint(0, 8))) for a, b in pairs]
    df = spark.createDataFrame(rows, "a int, b int, score double")
    used, want = set(), set()
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    assert {(r.a, r.b) for r in matching.greedy_pairs(df, "a", "b", [-F.col("score")]).collect()} == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a int, b int")
    got = {r.node: r.component for r in matching.components(chain, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_decisions(spark):
    df = spark.createDataFrame([(0.05, 0.5, 0.01), (0.2, 0.5, 0.01), (0.4, 0.5, 0.01), (0.05, -0.1, 0.01), (0.05, 0.5, 0.2)], "i double, t double, p double")
    verdict, explained = decisions.structure_verdict(F.col("i"), F.col("t"), F.col("p"))
    assert [r.v for r in df.select(verdict.alias("v"), explained).collect()] == ["PASS", "PARTIAL", "FAIL", "FAIL", "FAIL"]


def test_pattern_statistics():
    rng = np.random.default_rng(1)
    xy = rng.random((300, 2))
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    radii = np.array([0.05, 0.1, 0.2])
    assert (patterns.pair_counts(xy, radii) == [(d <= r).sum() - 300 for r in radii]).all()
    np.fill_diagonal(d, np.inf)
    assert math.isclose(patterns.nearest_distance(xy), d.min(1).mean())


def test_clustered_points_are_found(spark):
    rng = np.random.default_rng(2)
    tight = 0.5 + 0.02 * rng.standard_normal((150, 2))
    even = rng.random((150, 2))
    rows = [("tight", i, float(a), float(b)) for i, (a, b) in enumerate(tight)] + [("even", i, float(a), float(b)) for i, (a, b) in enumerate(even)]
    axis = Axis(0.0, 1.0, 10)
    window = spark.createDataFrame([(i, j) for i in range(10) for j in range(10)], "ix int, iy int")
    points = spark.createDataFrame(rows, "key string, id int, x double, y double")
    window = window.withColumn("window", F.lit("w"))
    pools = points.select(F.lit("p").alias("pool"), (F.col("id") + F.when(F.col("key") == "even", 1000).otherwise(0)).alias("id"), "x", "y")
    tests = spark.createDataFrame([("tight", "w", None), ("even", "w", None)], "key string, window string, pool string")
    labelled = spark.createDataFrame([("tight", "w", "p"), ("even", "w", "p")], "key string, window string, pool string")
    got = {r.key: r for r in patterns.pattern_tests(points, tests, window, axis, axis, [0.02, 0.05, 0.1], 19).collect()}
    assert got["tight"].di > 1 and got["tight"].p_clustered == 0.05 and abs(got["even"].di) < 0.3 and got["tight"].area == 1 and got["even"].n_used == 150
    got = {r.key: r for r in patterns.pattern_tests(points, labelled, window, axis, axis, [0.02, 0.05, 0.1], 19, pools=pools).collect()}
    assert got["tight"].di > 0.2 and got["tight"].p_clustered == 0.05 and got["even"].di < 0 and got["even"].p_regular == 0.05


def test_pattern_statistics_follow_their_definition(spark):
    rng = np.random.default_rng(5)
    measured = [("k", s, [float(a) for a in rng.random(3)], float(rng.random())) for s in range(8)]
    known = spark.createDataFrame([("k", 10, 10, 4.0)], "key string, n_cells long, n_used long, area double")
    r = patterns._judged(spark.createDataFrame(measured, patterns.MEASURED), known, np.array([1.0, 2.0, 3.0]), 7, (2.0, 3.0)).first()
    level = np.sqrt(4.0 * np.array([m[2] for m in measured]) / np.pi)[:, 1:]
    di = (level[0] / level[1:].mean(0)).mean() - 1
    null = [(level[i] / np.delete(level[1:], i - 1, axis=0).mean(0)).mean() - 1 for i in range(1, 8)]
    near = np.array([m[3] for m in measured])
    assert math.isclose(r.di, di) and math.isclose(r.p_clustered, (1 + sum(n >= di for n in null)) / 8) and math.isclose(r.p_regular, (1 + sum(n <= di for n in null)) / 8)
    assert math.isclose(r.ce, near[0] / near[1:].mean()) and math.isclose(r.p_ce, min(1, 2 * (1 + min((near[1:] <= near[0]).sum(), (near[1:] >= near[0]).sum())) / 8))


def test_thinning_keeps_as_many_as_asked(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4900, "big").otherwise("small").alias("key"), "id")
    n = {r.key: (r["count"], r.full) for r in patterns.thinned(rows, "key", 400).groupBy("key").agg(F.count("*").alias("count"), F.max("n_full").alias("full")).collect()}
    assert n == {"big": (400, 4900), "small": (100, 100)}


@pytest.mark.parametrize("small", [0, 10_000])
def test_quantiles_equal_numpy(spark, monkeypatch, small):
    from lamina.functions import quantiles as module
    from lamina.functions.quantiles import at_ranks, quantiles

    monkeypatch.setattr(module, "LEAST_ROWS", 8)
    monkeypatch.setattr(module, "SMALL", small)

    rng = np.random.default_rng(0)
    rows = [("a", float(v)) for v in rng.standard_normal(999)] + [("b", float(v)) for v in rng.integers(0, 4, 500)] + [("c", 5.0)] * 3 + [("d", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("w", -F.col("v"))
    p = [0.0, 0.05, 0.5, 0.77, 1.0]
    got = {r.k: (r.v, r.w) for r in quantiles(df, ["k"], ["v", "w"], p, 7).collect()}
    assert set(got) == {"a", "b", "c", None}
    for k, (v, w) in got.items():
        own = np.array([x for g, x in rows if g == k])
        assert np.allclose(v, np.quantile(own, p)) and np.allclose(w, np.quantile(-own, p))
    ids = spark.createDataFrame([("a", i * i) for i in range(300)] + [("b", 7)], "k string, i int")
    ranks = F.transform(F.array(F.lit(0), F.lit(100), F.lit(299)), lambda x: x)
    assert sorted((r.k, r.i) for r in at_ranks(ids, ["k"], "i", ranks, 5).collect()) == [("a", 0), ("a", 10_000), ("a", 299 * 299), ("b", 7)]


def test_latent_space_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 3)) @ np.array([[2, 1, 0], [0, 1, 0.5], [0, 0, 0.2]])
    df = latent.components_of(spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double"), ["a", "b", "c"], 2)
    z = (x - x.mean(0)) / x.std(0)
    _, s, _ = np.linalg.svd(z, full_matrices=False)
    got = np.array([(r.pc1, r.pc2) for r in df.collect()])
    assert np.allclose((got**2).sum(0), s[:2] ** 2)


def test_components_and_greedy_pairs_cover_every_pair(spark, sf):
    import duckdb

    from lamina.plans import relations

    pairs = duckdb.sql(f"SELECT l_partkey, l_suppkey, round(sum(l_quantity), 2) FROM '{sf}/lineitem.parquet' GROUP BY ALL").fetchall()
    root = {x: x for a, b, _ in pairs for x in (a, -b - 1)}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in pairs:
        low, high = sorted((top(a), top(-b - 1)))
        root[high] = low
    assert {(r.node, r.component) for r in relations.g1_components(spark, sf).collect()} == {(x, top(x)) for x in root}
    taken, left, right = set(), set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in left and b not in right:
            taken.add((a, b, s))
            left.add(a)
            right.add(b)
    assert {tuple(r) for r in relations.j19_greedy(spark, sf).collect()} == taken


def test_nearest_reaches_the_limit(spark):
    from lamina.functions.grid import nearest

    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 200.0, 0.0)], "id int, x double, y double")
    right = spark.createDataFrame([(7, 0.05, 0.0), (8, 104.5, 0.0), (9, 205.5, 0.0)], "id int, x double, y double")
    assert sorted((r.id, r.near_id) for r in nearest(left, right, "id", "id", 0.1, 5.0).collect()) == [(1, 7), (2, 8)]
