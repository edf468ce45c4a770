"""Queries over structures, grids and distances, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grid import Axis, histogram, nearest, voxel, within
from ..operators import regions, structure
from ..sources import tables
from ..sources.tables import SQL

X, Y = Axis(0.0, 5000.0, 50), Axis(0.0, 3000.0, 30)
SPEC = [(1, "cortex", "1-URGENT"), (1, "cortex", "2-HIGH"), (2, "medulla", "3-MEDIUM"), (3, "capsule", "4-NOT SPECIFIED")]
SPEC_SQL = "(VALUES (1, '1-URGENT'), (1, '2-HIGH'), (2, '3-MEDIUM'), (3, '4-NOT SPECIFIED'))"
RADIUS = 0.05


def _structured(spark, sf):
    return structure.assign_structure(tables.cells(spark, sf), SPEC)


def p3_structure_assign(spark, sf):
    return _structured(spark, sf).groupBy("structure_id", "cluster").agg(F.count("*").alias("n"))


def a20_hist2d(spark, sf):
    return histogram(tables.cells(spark, sf), X, Axis(0.0, 2000.0, 40), ["slice"]).withColumn("ix", F.col("ix").cast("bigint")).withColumn("iy", F.col("iy").cast("bigint"))


def a21_voxel(spark, sf):
    cell = voxel(Axis(-1.0, 1.0, 20), Axis(-1.0, 1.0, 20), Axis(-0.4, 0.4, 8))
    return tables.points(spark, sf).withColumn("voxel", cell).where("voxel is not null").groupBy("voxel").agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("sum_x"))


def _partition(spark, sf):
    placed = _structured(spark, sf)
    return placed, structure.dominant_bins(placed, X, Y)


def x11_assign_counts(spark, sf):
    placed, bins = _partition(spark, sf)
    return structure.assign_partition(placed, bins, X, Y).groupBy("structure_id", "bin_structure").agg(F.count("*").alias("n"))


def qc_purity_recall(spark, sf):
    placed, bins = _partition(spark, sf)
    return structure.purity_recall(structure.assign_partition(placed, bins, X, Y))


def x16_raster_adjacency(spark, sf):
    return structure.bin_adjacency(_partition(spark, sf)[1])


def x6_structure_order(spark, sf):
    return structure.order_by_centroid(_structured(spark, sf))


def x1_centroid_matrix(spark, sf):
    return structure.centroid_matrix(tables.points(spark, sf), "xyz")


def x8_ultrametric(spark, sf):
    return structure.ultrametric_violations(structure.centroid_matrix(tables.points(spark, sf), "xyz"))


def x24_confidence(spark, sf):
    groups = [(i % 3 + 1, "g", str(i)) for i in range(10)]
    return structure.confidence(structure.centroid_matrix(tables.points(spark, sf), "xyz"), groups)


def j8_radius(spark, sf):
    p = tables.points(spark, sf).select("vec_id", "x", "y", "cluster")
    found = within(p, p, RADIUS).where("l_vec_id <> r_vec_id")
    return found.groupBy(F.col("l_vec_id").alias("vec_id")).agg(F.count("*").alias("n_near"), F.count_if(F.col("l_cluster") == F.col("r_cluster")).alias("n_same"))


def j9_pair_counts(spark, sf):
    p = tables.points(spark, sf).select("vec_id", "x", "y", "cluster")
    radii = [0.01, 0.02, 0.03, 0.04, 0.05]
    found = within(p, p, max(radii)).where("l_vec_id <> r_vec_id and l_cluster = r_cluster")
    return found.groupBy(F.col("l_cluster").alias("cluster")).agg(*[F.count_if(F.col("d2") <= r * r).alias(f"pairs_{i + 1}") for i, r in enumerate(radii)])


def j6_nearest(spark, sf):
    p = tables.points(spark, sf).select("vec_id", "x", "y", "cluster")
    near = nearest(p, p.where("cluster = '3'"), "vec_id", "vec_id", 0.1, 5.0)
    return near.select("vec_id", F.col("near_vec_id").alias("near_id"), F.round(F.sqrt("d2"), 6).alias("distance"))


def x1_search_find(spark, sf):
    p = tables.points(spark, sf).select("vec_id", "x", "y", "cluster")
    return regions.search_find(p, "vec_id", [str(i) for i in range(10)], 0.2, 5.0)


def p16_crowded_filter(spark, sf):
    p = tables.points(spark, sf).select("vec_id", "x", "y", "cluster")
    return regions.away_from(p, p.where("cluster = '3'"), "vec_id", 0.03).where("cluster <> '3'").select("vec_id", "cluster")


def p10_similarity(spark, sf):
    moved = regions.similarity(tables.cells(spark, sf), 2500.0, 1200.0, 30.0, 1.25, 10.0, -5.0)
    return moved.groupBy("slice").agg(F.round(F.avg("x"), 4).alias("mean_x"), F.round(F.avg("y"), 4).alias("mean_y"), F.round(F.min("x"), 4).alias("min_x"), F.round(F.max("y"), 4).alias("max_y"))


def j12_smallest_area(spark, sf):
    cells = tables.cells(spark, sf)
    boxes = regions.quantile_boxes(cells, "cluster", 0.0037)
    return regions.smallest_region(cells, boxes, "cell_id", 250.0).groupBy("region").agg(F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("mean_x"))


def x33_overlap(spark, sf):
    s = tables.spots(spark, sf, place=True)
    return regions.overlap(s.withColumn("value", F.col("weight")), Axis(0.0, 1060.0, 40), Axis(0.0, 51.0, 25), "cluster", 0.9)


def x52_resample(spark, sf):
    boxes = regions.quantile_boxes(tables.cells(spark, sf), "cluster", 0.0)
    return regions.resample(boxes, "region", 100.0).groupBy("region").agg(F.count("*").alias("n_points"), F.round(F.sum("px"), 1).alias("sum_x"), F.round(F.sum("py"), 1).alias("sum_y"))


def f11_region_measures(spark, sf):
    return regions.measures(regions.quantile_boxes(tables.cells(spark, sf), "cluster", 0.0), "region")


def p6_bbox_cells(spark, sf):
    cells = tables.cells(spark, sf)
    return cells.where(F.col("x").between(1000.0, 2000.0) & F.col("y").between(500.0, 1500.0)).groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("mean_y"))


NAMES = (
    "p3_structure_assign a20_hist2d a21_voxel x11_assign_counts qc_purity_recall x16_raster_adjacency x6_structure_order x1_centroid_matrix x8_ultrametric x24_confidence "
    "j8_radius j9_pair_counts j6_nearest x1_search_find p16_crowded_filter p10_similarity j12_smallest_area x33_overlap x52_resample f11_region_measures p6_bbox_cells"
).split()
QUERIES = {n: globals()[n] for n in NAMES}


def _bin(c: str, low: float, high: float, n: int) -> str:
    return f"CAST(least(greatest(floor(({c} - {low}) / {(high - low) / n}), 0), {n - 1}) AS BIGINT)"


_CELLS, _POINTS, _SPOTS = SQL["cells"], SQL["points"], SQL["spots"]
_PLACED = f"""placed AS (SELECT c.*, coalesce(s.sid, 0) AS structure_id, {_bin("x", 0.0, 5000.0, 50)} AS ix, {_bin("y", 0.0, 3000.0, 30)} AS iy
  FROM {_CELLS} c LEFT JOIN {SPEC_SQL} s(sid, cl) ON c.cluster = s.cl),
bins AS (SELECT ix, iy, structure_id AS bin_structure FROM (
  SELECT ix, iy, structure_id, row_number() OVER (PARTITION BY ix, iy ORDER BY count(*) DESC, structure_id) AS k
  FROM placed WHERE structure_id > 0 AND x BETWEEN 0 AND 5000 AND y BETWEEN 0 AND 3000 GROUP BY ix, iy, structure_id) WHERE k = 1),
assigned AS (SELECT p.*, coalesce(b.bin_structure, 0) AS bin_structure FROM placed p LEFT JOIN bins b USING (ix, iy))"""
_MATRIX = f"""c AS (SELECT cluster, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM {_POINTS} GROUP BY cluster),
m AS (SELECT p.cluster AS a, q.cluster AS b, round(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)), 6) AS distance FROM c p CROSS JOIN c q)"""
_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"
_BOXES = f"""boxes AS (SELECT cluster AS region, quantile_cont(x, 0.25) + {{e}} AS x0, quantile_cont(x, 0.75) + {{e}} AS x1,
  quantile_cont(y, 0.25) + {{e}} AS y0, quantile_cont(y, 0.75) + {{e}} AS y1 FROM {_CELLS} GROUP BY cluster)"""
ORACLE_SQL = {
    "p3_structure_assign": f"SELECT coalesce(s.sid, 0) AS structure_id, cluster, count(*) AS n FROM {_CELLS} c LEFT JOIN {SPEC_SQL} s(sid, cl) ON c.cluster = s.cl GROUP BY ALL",
    "a20_hist2d": f"SELECT slice, {_bin('x', 0.0, 5000.0, 50)} AS ix, {_bin('y', 0.0, 2000.0, 40)} AS iy, count(*) AS value FROM {_CELLS} WHERE x BETWEEN 0 AND 5000 AND y BETWEEN 0 AND 2000 GROUP BY ALL",
    "a21_voxel": f"""SELECT CAST((floor((z + 0.4) / 0.1) * 20 + floor((y + 1) / 0.1)) * 20 + floor((x + 1) / 0.1) AS BIGINT) AS voxel, count(*) AS n, round(sum(x), 6) AS sum_x
      FROM {_POINTS} WHERE x >= -1 AND x < 1 AND y >= -1 AND y < 1 AND z >= -0.4 AND z < 0.4 GROUP BY ALL""",
    "x11_assign_counts": f"WITH {_PLACED} SELECT structure_id, bin_structure, count(*) AS n FROM assigned GROUP BY ALL",
    "qc_purity_recall": f"""WITH {_PLACED},
      o AS (SELECT structure_id, count(*) AS n_cells, count(*) FILTER (structure_id = bin_structure) AS n_own FROM assigned WHERE structure_id > 0 GROUP BY 1),
      h AS (SELECT bin_structure AS structure_id, count(*) AS n_held FROM assigned WHERE bin_structure > 0 AND structure_id > 0 GROUP BY 1)
      SELECT structure_id, n_cells, n_own, coalesce(n_held, 0) AS n_held, round(coalesce(n_own / nullif(n_held, 0), 0), 6) AS purity, round(n_own / n_cells, 6) AS recall FROM o LEFT JOIN h USING (structure_id)""",
    "x16_raster_adjacency": f"""WITH {_PLACED} SELECT least(p.bin_structure, q.bin_structure) AS a, greatest(p.bin_structure, q.bin_structure) AS b, count(*) AS n_edges
      FROM bins p JOIN bins q ON (q.ix = p.ix + 1 AND q.iy = p.iy) OR (q.ix = p.ix AND q.iy = p.iy + 1) WHERE p.bin_structure <> q.bin_structure GROUP BY ALL""",
    "x6_structure_order": f"""WITH {_PLACED}, c AS (SELECT structure_id, avg(x) AS cx, avg(y) AS cy FROM placed WHERE structure_id > 0 GROUP BY 1)
      SELECT structure_id, round(cx, 6) AS cx, round(cy, 6) AS cy, row_number() OVER (ORDER BY c.cx, c.cy, structure_id) AS place FROM c""",
    "x1_centroid_matrix": f"WITH {_MATRIX} SELECT a, b, distance FROM m",
    "x8_ultrametric": f"""WITH {_MATRIX}, t AS (SELECT max(distance) AS largest FROM m)
      SELECT ab.a, ab.b, round(max(ab.distance - greatest(ak.distance, kb.distance)), 6) AS excess FROM m ab JOIN m ak ON ab.a = ak.a JOIN m kb ON kb.a = ak.b AND kb.b = ab.b, t
      WHERE ab.a < ab.b GROUP BY ab.a, ab.b, t.largest HAVING max(ab.distance - greatest(ak.distance, kb.distance)) > 1e-6 * t.largest""",
    "x24_confidence": f"""WITH {_MATRIX}, r AS (SELECT CAST(CAST(a AS INT) % 3 + 1 AS INT) AS ga, CAST(b AS INT) % 3 + 1 AS gb, distance FROM m WHERE a <> b AND CAST(a AS INT) < 10 AND CAST(b AS INT) < 10)
      SELECT ga AS structure_id, round(avg(distance) FILTER (ga = gb), 6) AS inner_mean, round(avg(distance) FILTER (ga <> gb), 6) AS outer_mean,
      round(avg(distance) FILTER (ga <> gb) - avg(distance) FILTER (ga = gb), 6) AS gap FROM r GROUP BY ga""",
    "j8_radius": f"""SELECT a.vec_id, count(*) AS n_near, count(*) FILTER (a.cluster = b.cluster) AS n_same FROM {_POINTS} a JOIN {_POINTS} b
      ON a.vec_id <> b.vec_id AND abs(a.x - b.x) <= {RADIUS} AND {_D2} <= {RADIUS * RADIUS} GROUP BY a.vec_id""",
    "j9_pair_counts": "SELECT a.cluster, "
    + ", ".join(f"count(*) FILTER ({_D2} <= {r * r}) AS pairs_{i + 1}" for i, r in enumerate([0.01, 0.02, 0.03, 0.04, 0.05]))
    + f" FROM {_POINTS} a JOIN {_POINTS} b ON a.cluster = b.cluster AND a.vec_id <> b.vec_id WHERE {_D2} <= {0.05 * 0.05} GROUP BY a.cluster",
    "j6_nearest": f"""SELECT vec_id, near_id, round(sqrt(d2), 6) AS distance FROM (SELECT a.vec_id, b.vec_id AS near_id, {_D2} AS d2, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_D2}, b.vec_id) AS k
      FROM {_POINTS} a JOIN {_POINTS} b ON b.cluster = '3') WHERE k = 1""",
    "x1_search_find": f"""SELECT a, b, round(avg(d), 6) AS distance FROM (SELECT a.cluster AS a, b.cluster AS b, a.vec_id, sqrt(min({_D2})) AS d FROM {_POINTS} a JOIN {_POINTS} b
      ON a.cluster <> b.cluster GROUP BY a.cluster, b.cluster, a.vec_id) GROUP BY a, b""",
    "p16_crowded_filter": f"SELECT a.vec_id, a.cluster FROM {_POINTS} a WHERE a.cluster <> '3' AND NOT EXISTS (SELECT 1 FROM {_POINTS} b WHERE b.cluster = '3' AND {_D2} <= {0.03 * 0.03})",
    "p10_similarity": f"""WITH m AS (SELECT slice, 1.25 * ((x - 2500) * cos(radians(30)) - (y - 1200) * sin(radians(30))) + 2500 + 10 AS x, 1.25 * ((x - 2500) * sin(radians(30)) + (y - 1200) * cos(radians(30))) + 1200 - 5 AS y FROM {_CELLS})
      SELECT slice, round(avg(x), 4) AS mean_x, round(avg(y), 4) AS mean_y, round(min(x), 4) AS min_x, round(max(y), 4) AS max_y FROM m GROUP BY slice""",
    "j12_smallest_area": f"""WITH {_BOXES.format(e=0.0037)}, hit AS (SELECT c.cell_id, c.x, b.region, row_number() OVER (PARTITION BY c.cell_id ORDER BY (b.x1 - b.x0) * (b.y1 - b.y0), b.region) AS k
      FROM {_CELLS} c JOIN boxes b ON c.x BETWEEN b.x0 AND b.x1 AND c.y BETWEEN b.y0 AND b.y1) SELECT region, count(*) AS n, round(avg(x), 4) AS mean_x FROM hit WHERE k = 1 GROUP BY region""",
    "x33_overlap": f"""WITH v AS (SELECT cluster AS gene, {_bin("x", 0.0, 1060.0, 40)} AS ix, {_bin("y", 0.0, 51.0, 25)} AS iy, sum(weight) AS value FROM {_SPOTS} WHERE x BETWEEN 0 AND 1060 AND y BETWEEN 0 AND 51 GROUP BY ALL),
      t AS (SELECT gene, quantile_cont(value, CAST(0.9 AS DOUBLE)) AS cut FROM v GROUP BY gene), h AS (SELECT v.* FROM v JOIN t USING (gene) WHERE value >= cut),
      n AS (SELECT gene, count(*) AS n FROM h GROUP BY gene), p AS (SELECT a.gene AS a, b.gene AS b, count(*) AS n_both FROM h a JOIN h b ON a.ix = b.ix AND a.iy = b.iy AND a.gene < b.gene GROUP BY ALL)
      SELECT x.gene AS a, y.gene AS b, coalesce(n_both, 0) AS n_both, round(coalesce(n_both, 0) / (x.n + y.n - coalesce(n_both, 0)), 6) AS jaccard, round(2 * coalesce(n_both, 0) / (x.n + y.n), 6) AS dice
      FROM n x JOIN n y ON x.gene < y.gene LEFT JOIN p ON p.a = x.gene AND p.b = y.gene""",
    "x52_resample": f"""WITH {_BOXES.format(e=0.0)}, e AS (SELECT region, x0 AS ax, y0 AS ay, x1 AS bx, y0 AS by_ FROM boxes UNION ALL SELECT region, x1, y0, x1, y1 FROM boxes UNION ALL SELECT region, x1, y1, x0, y1 FROM boxes UNION ALL SELECT region, x0, y1, x0, y0 FROM boxes),
      s AS (SELECT *, greatest(1, CAST(ceil(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) / 100) AS BIGINT)) AS n FROM e), p AS (SELECT region, ax, ay, bx, by_, n, unnest(range(n)) AS i FROM s)
      SELECT region, count(*) AS n_points, round(sum(ax + (bx - ax) * i / n), 1) AS sum_x, round(sum(ay + (by_ - ay) * i / n), 1) AS sum_y FROM p GROUP BY region""",
    "f11_region_measures": f"""WITH {_BOXES.format(e=0.0)} SELECT region, round((x1 - x0) * (y1 - y0), 1) AS area, round(2 * (x1 - x0 + y1 - y0), 6) AS perimeter, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy,
      round(4 * pi() * (x1 - x0) * (y1 - y0) / ((2 * (x1 - x0 + y1 - y0)) * (2 * (x1 - x0 + y1 - y0))), 6) AS compactness FROM boxes""",
    "p6_bbox_cells": f"SELECT cluster, count(*) AS n, round(avg(y), 6) AS mean_y FROM {_CELLS} WHERE x BETWEEN 1000 AND 2000 AND y BETWEEN 500 AND 1500 GROUP BY cluster",
}
