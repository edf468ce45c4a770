"""Searches for near rows: what they meet follows the number asked for, not the table."""

import math

import numpy as np
from pyspark.sql import functions as F

from lamina.functions.grid import k_nearest, nearest
from lamina.operators import regions


def joined_rows(spark, run):
    """Rows that joins made while ``run`` ran, and its result."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    made = 0
    for i in range(before, store.executionsList().size()):
        e = store.executionsList().apply(i).executionId()
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for j in range(nodes.size()):
            if "Join" in nodes.apply(j).name():
                ms = nodes.apply(j).metrics()
                for m in (ms.apply(x) for x in range(ms.size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        made += int(values.apply(m.accumulatorId()).replace(",", "").split("\n")[-1])
    return made, out


def _crowd(n=1500):
    rng = np.random.default_rng(5)
    at = np.concatenate([rng.normal(0, 1e-3, (n, 2)), rng.normal(0, 0.2, (40, 2)), [[3.0, 3.0], [3.0, 3.0], [-2.0, 1.0]]])
    return [(i, float(x), float(y), str(i % 3)) for i, (x, y) in enumerate(at)]


def _truth(rows, k, ok=lambda a, b: True):
    at = np.array([r[1:3] for r in rows])
    out = {}
    for i, r in enumerate(rows):
        d = (at[i, 0] - at[:, 0]) ** 2 + (at[i, 1] - at[:, 1]) ** 2
        out[i] = [j for j in np.lexsort((np.arange(len(rows)), d)) if ok(r, rows[j])][:k]
    return out


def test_crowds_within_the_radius_meet_few(spark):
    rows = _crowd()
    p = spark.createDataFrame(rows, "id int, x double, y double, g string")
    made, got = joined_rows(spark, lambda: k_nearest(p, p, "id", "id", 5, 0.5, 10.0).collect())
    near = {}
    for r in sorted(got, key=lambda r: (r.id, r.place)):
        near.setdefault(r.id, []).append(r.near_id)
    assert near == _truth(rows, 5)
    assert len(rows) <= made < 150 * len(rows)  # all within the radius are 2,250,000


def test_search_between_labels_meets_few(spark):
    rows = _crowd()
    p = spark.createDataFrame(rows, "id int, x double, y double, cluster string")
    made, got = joined_rows(spark, lambda: regions.search_find(p, "id", ["0", "1", "2"], 0.5, 10.0).collect())
    for b in "012":
        near = _truth(rows, 1, lambda r, o: o[3] == b)  # noqa: B023
        for a in set("012") - {b}:
            want = np.mean([math.dist(r[1:3], rows[near[r[0]][0]][1:3]) for r in rows if r[3] == a])
            assert math.isclose({(r.a, r.b): r.distance for r in got}[a, b], want, abs_tol=2e-6)
    assert len(rows) <= made < 100 * len(rows)


def test_twins_and_groups(spark):
    rows = [(i, float(i % 4), 0.0, "ab"[i % 2]) for i in range(400)]
    p = spark.createDataFrame(rows, "id int, x double, y double, g string")
    got = {r.id: r.near_id for r in nearest(p, p, "id", "id", 0.5, 9.0, keys=("g",)).collect()}
    assert got == {i: i % 4 for i in range(400)}
    many = k_nearest(p, p, "id", "id", 3, 0.5, 9.0, keys=("g",)).where("id = 399").orderBy("place").collect()
    assert [(r.near_id, r.d2) for r in many] == [(3, 0.0), (7, 0.0), (11, 0.0)]
    assert nearest(p, p.where("false"), "id", "id", 0.5, 9.0).collect() == []
    assert nearest(p.where("false"), p, "id", "id", 0.5, 9.0).collect() == []


def test_outlines_of_crowds_meet_few(spark):
    from lamina.operators import alpha

    rows = [(i, math.sqrt((i + 0.5) / 1500) * math.cos(2.4 * i), math.sqrt((i + 0.5) / 1500) * math.sin(2.4 * i), "g") for i in range(1500)]
    p = spark.createDataFrame(rows, "id int, x double, y double, g string")
    made, edges = joined_rows(spark, lambda: alpha.border(p, ["g"], "id", 0.5).collect())
    met = {r.a for r in edges}
    assert len(met) == len(edges) > 30 and all(math.hypot(*rows[i][1:3]) > 0.9 for i in met)
    assert len(rows) <= made < 300 * len(rows)  # all within the diameter are over 1,000,000


def test_layout_loss_takes_all_components(spark):
    from lamina.operators import registration as R

    # 900 components of a slice, of which the last hundred lie a step off the other slice's.
    a = [("g", f"a{i}", 10.0 * i, 0.0, 1000 - i) for i in range(900)]
    b = [("g", f"b{i}", 10.0 * i, 3.0 if i >= 800 else 0.0, 1000 - i) for i in range(900)]
    sides = [spark.createDataFrame(r, "g string, id string, x double, y double, area long") for r in (a, b)]
    total = sum(r[4] for r in a)
    loss = R.layout_loss(*sides, ["g"], "id", "area", 5.0, 1e5).first().loss
    assert math.isclose(loss, sum(3.0 * r[4] / total for r in a[800:]))


def test_tears_follow_all_anchors(spark):
    from lamina.operators import registration as R

    anchors = [(0.01 * i, 0.0, float(i >= 70), 0.0) for i in range(140)]
    p = spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double")
    moved = R.tear_field(p, "id", spark.createDataFrame(anchors, "x double, y double, dx double, dy double"), 4.0, 9.0).first()
    w = [math.exp(-(x * x) / 8) for x, *_ in anchors]
    assert math.isclose(moved.x, sum(w[70:]) / sum(w))


def test_components_broadcast_nothing(spark):
    from lamina.operators import matching as M

    edges = spark.range(3000).select((F.col("id") * 2).alias("a"), (F.col("id") * 2 + F.when(F.col("id") % 10 < 9, 2).otherwise(1)).alias("b"))
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    got = {r.node: r.component for r in M.components(edges, "a", "b").collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert got == {n: n // 20 * 20 for n in got} and len(got) == 3300
    plans = [store.executionsList().apply(i).physicalPlanDescription() for i in range(before, store.executionsList().size())]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)
