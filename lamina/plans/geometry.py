"""Queries over overlays, rasters and alignments, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment, isolines, orientation, overlay, quality, raster, regions, structure
from ..sources import tables
from ..sources.scratch import materialize
from .fields import _objects
from .structures import _BOXES, _CELLS, _PLACED, _SPOTS, SPEC, X, Y

NX, NY = X.n, Y.n


def _boxes(spark, sf):
    return regions.quantile_boxes(tables.cells(spark, sf), "cluster", 0.0037)


def j13_ring_cells(spark, sf):
    near = overlay.ring_cells(tables.cells(spark, sf).select("cell_id", "x", "y"), _boxes(spark, sf), 50.0, 150.0, 400.0)
    return near.groupBy("region").agg(F.count("*").alias("n"), F.round(F.avg("x"), 3).alias("mean_x"))


def a30_overlaps(spark, sf):
    return overlay.overlaps(_boxes(spark, sf), "region", 500.0)


def x14_hulls(spark, sf):
    return regions.measures(overlay.hulls(tables.cells(spark, sf), "cluster"), "region")


def _mask(spark, sf):
    bins = structure.dominant_bins(structure.assign_structure(tables.cells(spark, sf), SPEC), X, Y)
    return bins, bins.where("bin_structure = 1").select("ix", "iy")


def x54_components(spark, sf):
    return raster.label(_mask(spark, sf)[1], NX).select(F.col("ix").cast("bigint").alias("ix"), F.col("iy").cast("bigint").alias("iy"), "component")


def x10_morphology(spark, sf):
    """Bins of the closed mask, of its opening, and of the closed mask without holes and small parts."""
    mask = _mask(spark, sf)[1]
    closed = raster.close(mask, NX, NY)
    return closed.select(F.lit("closed").alias("step"), "ix", "iy").unionByName(raster.opened(mask, NX, NY).select(F.lit("opened").alias("step"), "ix", "iy")).groupBy("step").agg(F.count("*").alias("n"), F.sum("ix").alias("sum_ix"), F.sum("iy").alias("sum_iy"))


def x10_filled(spark, sf):
    return raster.large_parts(raster.fill_holes(_mask(spark, sf)[1], NX, NY), NX, 3).groupBy("iy").agg(F.count("*").alias("n"))


def x15_polygons(spark, sf):
    parts = materialize(raster.label(_mask(spark, sf)[1], NX))
    return isolines.polygon_sizes(isolines.polygons(parts, X, Y)).select("component", "area", "perimeter")


def x10_seeded(spark, sf):
    """Bins of the closed mask of all structures, the empty ones filled from the nearest labelled bin."""
    bins = _mask(spark, sf)[0].where("bin_structure > 0").withColumnRenamed("bin_structure", "structure_id")
    closed = raster.close(bins.select("ix", "iy"), NX, NY)
    return isolines.seeded(bins, closed, X, Y).select(F.col("ix").cast("bigint").alias("ix"), F.col("iy").cast("bigint").alias("iy"), "structure_id")


def x34_signed_distance(spark, sf):
    grid = _mask(spark, sf)[0].withColumn("inner", F.col("bin_structure") == 1)
    found = raster.signed_distance(grid, "inner", 2.0, 256.0)
    return found.select(F.col("ix").cast("bigint").alias("ix"), F.col("iy").cast("bigint").alias("iy"), "distance")


def _landmarks(spark, sf):
    """Regions of each cluster in odd and even slices as matching points."""
    s = tables.spots(spark, sf)
    at = lambda odd, a, b, n: s.where(F.col("sample") % 2 == odd).groupBy("cluster", "region").agg(F.avg("x").alias(a), (F.avg("y") * 20).alias(b), F.count("*").alias(n))
    both = at(1, "x", "y", "_m").join(at(0, "u", "v", "_n"), ["cluster", "region"])
    return both.withColumn("score", F.round(F.least("_m", "_n") / F.greatest("_m", "_n"), 6)).drop("_m", "_n")


def x47_procrustes(spark, sf):
    t = alignment.procrustes(_landmarks(spark, sf), ["cluster"])
    return t.select("cluster", *[F.round(c, 3).alias(c) for c in ("rotation", "scale", "dx", "dy", "residual")])


def x47_consensus(spark, sf):
    a = _landmarks(spark, sf).withColumnRenamed("region", "id")
    return alignment.consensus(a, ["cluster"], 60.0, 30).select("cluster", "a", "b", "inliers")


def z8_coverage(spark, sf):
    return alignment.coverage(_landmarks(spark, sf), ["cluster"]).select("cluster", "n", "quadrants", F.round("evenness", 6).alias("evenness"))


def x36_projection(spark, sf):
    moved = alignment.moved(tables.spots(spark, sf).select("cluster", "x", (F.col("y") * 20).alias("y")), alignment.procrustes(_landmarks(spark, sf), ["cluster"]), ["cluster"])
    return moved.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("x"), 3).alias("mean_x"), F.round(F.avg("y"), 3).alias("mean_y"))


def x46_warp(spark, sf):
    a = _landmarks(spark, sf).withColumnRenamed("region", "id")
    warped = alignment.landmark_warp(tables.spots(spark, sf).select("cluster", "x", (F.col("y") * 20).alias("y")), a, "cluster", 50, 100.0)
    return warped.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("x"), 2).alias("mean_x"), F.round(F.avg("y"), 2).alias("mean_y"))


def j18_assignment(spark, sf):
    from ..operators.tracks import links

    o = _objects(spark, sf)
    found = links(o, "sample", "id", "cluster", 30.0, 1.6).join(o.select(F.col("id").alias("source"), "cluster", "sample"), "source")
    return overlay.best_assignment(found, ["cluster", "sample"], "source", "target", "score")


def x38_orientation(spark, sf):
    t = tables.spots(spark, sf).groupBy("region", "sample").agg(F.avg("x").alias("cx"), F.avg("weight").alias("w"))
    nxt = t.select("region", (F.col("sample") - 1).alias("sample"), F.col("cx").alias("nx"), F.col("w").alias("nw"))
    near = F.round(1 / (1 + F.abs(F.col("cx") - F.col("nx")) / 50), 6)
    flip = F.round(10 * F.abs(F.col("w") - F.col("nw")), 6)
    e = t.join(nxt, ["region", "sample"]).select("region", "sample", near.alias("s00"), flip.alias("s01"), flip.alias("s10"), near.alias("s11"))
    best = orientation.best_orientation(e, ["region"], "sample")
    return best.select("region", "n_edges", "path", F.round("score", 4).alias("score"), F.round("margin", 4).alias("margin"))


def _quality(spark, sf):
    """(cells with their structures, bins, results of all tests)."""
    bins, _ = _mask(spark, sf)
    cells = structure.assign_partition(structure.assign_structure(tables.cells(spark, sf), SPEC), bins, X, Y)
    return cells, bins, materialize(quality.structure_tests(cells, bins, X, Y, [50.0, 100.0, 150.0]))


def x20_structure_quality(spark, sf):
    cells, bins, found = _quality(spark, sf)
    found = quality.structure_quality(found, quality.cluster_quality(cells, bins, X, Y, found), cells.where("structure_id > 0").select("structure_id", "cluster").distinct())
    return found.select("structure_id", "n_cells", "n_used", *[F.round(c, 6).alias(c) for c in ("di_in", "di_tissue", "p_tissue", "explained")], "verdict", "n_hotspots", "split")


def x20_cluster_quality(spark, sf):
    cells, bins, found = _quality(spark, sf)
    c = quality.cluster_quality(cells, bins, X, Y, found).join(quality.before_after(found).drop("p_original"), ["structure_id", "cluster"], "left")
    return c.select("structure_id", "cluster", *[F.round(v, 6).alias(v) for v in ("di_csr", "p_csr", "di_rl", "p_rl", "edge_ratio", "di_original", "d_di")], "status", "at_edge", "role")


def x20_border_depth(spark, sf):
    """Distances of a structure's bins to its border, as the edge ratio takes them."""
    d = quality.border_distances(_mask(spark, sf)[0], X, Y)
    return d.select(F.col("ix").cast("bigint").alias("ix"), F.col("iy").cast("bigint").alias("iy"), F.round("depth", 4).alias("depth"))


def d5_tested_clusters(spark, sf):
    return quality.tested_clusters(structure.assign_structure(tables.cells(spark, sf), SPEC))


NAMES = "x15_polygons x10_seeded z8_coverage x20_cluster_quality x20_border_depth x38_orientation x20_structure_quality d5_tested_clusters j13_ring_cells a30_overlaps x14_hulls x54_components x10_morphology x10_filled x34_signed_distance x47_procrustes x47_consensus x36_projection x46_warp j18_assignment".split()
QUERIES = {n: globals()[n] for n in NAMES}

_BOX = _BOXES.format(e=0.0037)
_LAND = f"""o AS (SELECT cluster, region, avg(x) AS x, avg(y) * 20 AS y, count(*) AS m FROM {_SPOTS} WHERE sample % 2 = 1 GROUP BY ALL), e AS (SELECT cluster, region, avg(x) AS u, avg(y) * 20 AS v, count(*) AS n FROM {_SPOTS} WHERE sample % 2 = 0 GROUP BY ALL),
l AS (SELECT *, round(least(m, n) / greatest(m, n), 6) AS score FROM o JOIN e USING (cluster, region))"""
_FIT = """m AS (SELECT cluster, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM l GROUP BY cluster),
c AS (SELECT cluster, sum((x - mx) * (u - mu) + (y - my) * (v - mv)) AS dt, sum((x - mx) * (v - mv) - (y - my) * (u - mu)) AS cr, sum((x - mx) * (x - mx) + (y - my) * (y - my)) AS s,
  sum((u - mu) * (u - mu) + (v - mv) * (v - mv)) AS t, count(*) AS n FROM l JOIN m USING (cluster) GROUP BY cluster),
f AS (SELECT cluster, dt / s AS a, cr / s AS b, mu - dt / s * mx + cr / s * my AS dx, mv - cr / s * mx - dt / s * my AS dy, sqrt(greatest(t - (dt * dt + cr * cr) / s, 0) / n) AS residual FROM c JOIN m USING (cluster))"""
ORACLE_SQL = {
    "d5_tested_clusters": f"""WITH {_PLACED}, n AS (SELECT structure_id, cluster, count(*) AS n FROM placed WHERE structure_id > 0 GROUP BY ALL)
      SELECT structure_id, cluster, n, round(n / sum(n) OVER w, 6) AS share, n >= 100 AND n / sum(n) OVER w >= 0.01 AS tested FROM n WINDOW w AS (PARTITION BY structure_id)""",
    "j13_ring_cells": f"""WITH {_BOX}, d AS (SELECT region, c.x AS x, sqrt(power(greatest(x0 - c.x, 0, c.x - x1), 2) + power(greatest(y0 - c.y, 0, c.y - y1), 2)) AS d FROM {_CELLS} c, boxes)
      SELECT region, count(*) AS n, round(avg(x), 3) AS mean_x FROM d WHERE d > 50 AND d <= 150 GROUP BY region""",
    "a30_overlaps": f"""WITH {_BOX}, b AS (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM boxes), s AS (SELECT p.region AS a, q.region AS b, p.area AS aa, q.area AS ab,
      greatest(least(p.x1, q.x1) - greatest(p.x0, q.x0), 0) * greatest(least(p.y1, q.y1) - greatest(p.y0, q.y0), 0) AS shared FROM b p JOIN b q ON p.region < q.region)
      SELECT a, b, round(shared, 1) AS shared, round(shared / (aa + ab - shared), 6) AS iou, round(2 * shared / (aa + ab), 6) AS dice, round(shared / least(aa, ab), 6) AS fraction FROM s WHERE shared > 0""",
    "x54_components": f"""WITH RECURSIVE {_PLACED}, m AS (SELECT ix, iy, iy * {NX} + ix AS no FROM bins WHERE bin_structure = 1), g AS (SELECT p.no AS a, q.no AS b FROM m p JOIN m q ON abs(p.ix - q.ix) + abs(p.iy - q.iy) = 1),
      r(a, b) AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a) SELECT ix, iy, least(no, coalesce(low, no)) AS component FROM m LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) ON a = no""",
    "x15_polygons": f"""WITH RECURSIVE {_PLACED}, m AS (SELECT ix, iy, iy * {NX} + ix AS no FROM bins WHERE bin_structure = 1), g AS (SELECT p.no AS a, q.no AS b FROM m p JOIN m q ON abs(p.ix - q.ix) + abs(p.iy - q.iy) = 1),
      r(a, b) AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a), c AS (SELECT ix, iy, least(no, coalesce(low, no)) AS component FROM m LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) ON a = no),
      s(dx, dy, len) AS (VALUES (1, 0, {Y.step}), (-1, 0, {Y.step}), (0, 1, {X.step}), (0, -1, {X.step})),
      p AS (SELECT c.component, sum(len) AS perimeter FROM c CROSS JOIN s LEFT JOIN c n ON n.ix = c.ix + dx AND n.iy = c.iy + dy AND n.component = c.component WHERE n.ix IS NULL GROUP BY c.component)
      SELECT component, round(CAST(count(*) * {X.step * Y.step} AS DOUBLE), 3) AS area, round(CAST(any_value(perimeter) AS DOUBLE), 3) AS perimeter FROM c JOIN p USING (component) GROUP BY component""",
    "x10_seeded": f"""WITH {_PLACED}, b AS (SELECT ix, iy, bin_structure AS s FROM bins WHERE bin_structure > 0), s(dx, dy) AS (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)),
      d AS (SELECT DISTINCT ix + dx AS ix, iy + dy AS iy FROM b, s WHERE ix + dx BETWEEN 0 AND {NX - 1} AND iy + dy BETWEEN 0 AND {NY - 1}),
      c AS (SELECT ix + dx AS ix, iy + dy AS iy FROM d, s WHERE ix + dx BETWEEN 0 AND {NX - 1} AND iy + dy BETWEEN 0 AND {NY - 1} GROUP BY ALL HAVING count(*) = 5),
      h AS (SELECT c.ix, c.iy, b.s FROM c JOIN b USING (ix, iy))
      SELECT ix, iy, s AS structure_id FROM h UNION ALL SELECT c.ix, c.iy, arg_min(h.s, (round(power((c.ix - h.ix) * {X.step}, 2) + power((c.iy - h.iy) * {Y.step}, 2), 6), h.s)) FROM (SELECT * FROM c WHERE (ix, iy) NOT IN (SELECT ix, iy FROM h)) c, h GROUP BY c.ix, c.iy""",
    "x10_morphology": f"""WITH {_PLACED}, m AS (SELECT ix, iy FROM bins WHERE bin_structure = 1), s(dx, dy) AS (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)),
      d AS (SELECT DISTINCT ix + dx AS ix, iy + dy AS iy FROM m, s WHERE ix + dx BETWEEN 0 AND {NX - 1} AND iy + dy BETWEEN 0 AND {NY - 1}),
      c AS (SELECT ix + dx AS ix, iy + dy AS iy FROM d, s WHERE ix + dx BETWEEN 0 AND {NX - 1} AND iy + dy BETWEEN 0 AND {NY - 1} GROUP BY ALL HAVING count(*) = 5),
      e AS (SELECT ix + dx AS ix, iy + dy AS iy FROM m, s WHERE ix + dx BETWEEN 0 AND {NX - 1} AND iy + dy BETWEEN 0 AND {NY - 1} GROUP BY ALL HAVING count(*) = 5),
      o AS (SELECT DISTINCT ix + dx AS ix, iy + dy AS iy FROM e, s WHERE ix + dx BETWEEN 0 AND {NX - 1} AND iy + dy BETWEEN 0 AND {NY - 1})
      SELECT 'closed' AS step, count(*) AS n, CAST(sum(ix) AS BIGINT) AS sum_ix, CAST(sum(iy) AS BIGINT) AS sum_iy FROM c HAVING count(*) > 0 UNION ALL SELECT 'opened', count(*), CAST(sum(ix) AS BIGINT), CAST(sum(iy) AS BIGINT) FROM o HAVING count(*) > 0""",
    "x10_filled": f"""WITH RECURSIVE {_PLACED}, m AS (SELECT ix, iy, iy * {NX} + ix AS no FROM bins WHERE bin_structure = 1),
      q AS (SELECT no % {NX} AS ix, no // {NX} AS iy, no FROM (SELECT unnest(range({NX * NY})) AS no) WHERE no NOT IN (SELECT no FROM m)),
      out(no, ix, iy) AS (SELECT no, ix, iy FROM q WHERE ix = 0 OR iy = 0 OR ix = {NX - 1} OR iy = {NY - 1} UNION SELECT q.no, q.ix, q.iy FROM out JOIN q ON abs(q.ix - out.ix) + abs(q.iy - out.iy) = 1),
      f AS (SELECT no, no % {NX} AS ix, no // {NX} AS iy FROM (SELECT unnest(range({NX * NY})) AS no) WHERE no NOT IN (SELECT no FROM out)),
      e AS (SELECT a.no AS a, b.no AS b FROM f a JOIN f b ON abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1), r(a, b) AS (SELECT no, no FROM f UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
      big AS (SELECT a FROM r GROUP BY a HAVING count(*) >= 3) SELECT CAST(iy AS INT) AS iy, count(*) AS n FROM f WHERE no IN (SELECT a FROM big) GROUP BY 1""",
    "x38_orientation": f"""WITH RECURSIVE t AS (SELECT region, sample, avg(x) AS cx, avg(weight) AS w FROM {_SPOTS} GROUP BY ALL),
      e AS (SELECT a.region, a.sample, round(1 / (1 + abs(a.cx - b.cx) / 50), 6) AS same, round(10 * abs(a.w - b.w), 6) AS flip, row_number() OVER (PARTITION BY a.region ORDER BY a.sample) AS i, count(*) OVER (PARTITION BY a.region) AS n
        FROM t a JOIN t b ON a.region = b.region AND b.sample = a.sample + 1),
      r(region, i, n, path, score) AS (SELECT DISTINCT region, CAST(0 AS BIGINT), n, s, CAST(0 AS DOUBLE) FROM e, (VALUES ('0'), ('1')) v(s)
        UNION ALL SELECT r.region, e.i, r.n, r.path || s, r.score + CASE WHEN right(r.path, 1) = s THEN same ELSE flip END FROM r JOIN e ON e.region = r.region AND e.i = r.i + 1, (VALUES ('0'), ('1')) v(s))
      SELECT region, any_value(n) AS n_edges, arg_min(path, (-round(score, 9), reverse(path))) AS path, round(max(score), 4) AS score,
      round(abs(max(score) FILTER (right(path, 1) = '0') - max(score) FILTER (right(path, 1) = '1')), 4) AS margin FROM r WHERE i = n GROUP BY region""",
    "x34_signed_distance": f"""WITH {_PLACED} SELECT p.ix, p.iy, round(CASE WHEN p.bin_structure = 1 THEN -1 ELSE 1 END * min(sqrt((p.ix - q.ix) * (p.ix - q.ix) + (p.iy - q.iy) * (p.iy - q.iy))), 6) AS distance
      FROM bins p JOIN bins q ON (p.bin_structure = 1) <> (q.bin_structure = 1) GROUP BY p.ix, p.iy, p.bin_structure""",
    "x47_procrustes": f"WITH {_LAND}, {_FIT} SELECT cluster, round(degrees(atan2(b, a)), 3) AS rotation, round(sqrt(a * a + b * b), 3) AS scale, round(dx, 3) AS dx, round(dy, 3) AS dy, round(residual, 3) AS residual FROM f",
    "x36_projection": f"""WITH {_LAND}, {_FIT} SELECT cluster, count(*) AS n, round(avg(a * p.x - b * p.y * 20 + dx), 3) AS mean_x, round(avg(b * p.x + a * p.y * 20 + dy), 3) AS mean_y FROM {_SPOTS} p JOIN f USING (cluster) GROUP BY cluster""",
    "x47_consensus": f"""WITH {_LAND}, k AS (SELECT cluster, region AS id, x, y, u, v FROM l QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, region) <= 30),
      t AS (SELECT p.cluster, p.id AS a, q.id AS b, p.x AS x0, p.y AS y0, p.u AS u0, p.v AS v0, q.x - p.x AS px, q.y - p.y AS py, q.u - p.u AS qx, q.v - p.v AS qy FROM k p JOIN k q ON p.cluster = q.cluster AND p.id < q.id),
      c AS (SELECT *, (px * qx + py * qy) / (px * px + py * py) AS c, (px * qy - py * qx) / (px * px + py * py) AS d FROM t WHERE px * px + py * py > 0),
      g AS (SELECT cluster, a, b, c, d, u0 - c * x0 + d * y0 AS dx, v0 - d * x0 - c * y0 AS dy FROM c)
      SELECT cluster, a, b, count(*) FILTER (round(sqrt(power(c * x - d * y + dx - u, 2) + power(d * x + c * y + dy - v, 2)), 6) <= 60) AS inliers FROM g JOIN l USING (cluster) GROUP BY cluster, a, b""",
    "z8_coverage": f"""WITH {_LAND}, b AS (SELECT cluster, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my FROM l GROUP BY cluster),
      q AS (SELECT cluster, CAST(x >= mx AS INT) * 2 + CAST(y >= my AS INT) AS q, count(*) AS k FROM l JOIN b USING (cluster) GROUP BY ALL), t AS (SELECT cluster, q, k, sum(k) OVER (PARTITION BY cluster) AS t FROM q)
      SELECT cluster, CAST(max(t) AS BIGINT) AS n, count(*) AS quadrants, round(-sum(k / t * ln(k / t)) / ln(4), 6) AS evenness FROM t GROUP BY cluster""",
    "x20_border_depth": f"""WITH {_PLACED}, g AS (SELECT ix, iy, bin_structure AS s FROM bins WHERE bin_structure > 0), n AS (SELECT unnest(range(-1, {NX} + 1)) AS ix), m AS (SELECT unnest(range(-1, {NY} + 1)) AS iy),
      f AS (SELECT n.ix, m.iy, coalesce(g.s, 0) AS s FROM n CROSS JOIN m LEFT JOIN g ON g.ix = n.ix AND g.iy = m.iy)
      SELECT g.ix, g.iy, round(min(sqrt(power((g.ix - f.ix) * {X.step}, 2) + power((g.iy - f.iy) * {Y.step}, 2))), 4) AS depth FROM g JOIN f ON f.s <> g.s GROUP BY g.ix, g.iy""",
}
