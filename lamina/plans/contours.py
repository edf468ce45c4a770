"""Queries over contours that touch, overlap and enclose one another, and their SQL.

The contours are the occupied tiles of the tissue, each labelled with its dominant structure, and the middle half of each
cluster's cells as a box.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grid import Axis
from ..operators import contours, regions, structure
from ..sources import tables
from ..sources.scratch import materialize
from .structures import _BOXES, _CELLS, SPEC, SPEC_SQL, _bin

TX, TY = Axis(0.0, 5000.0, 10), Axis(0.0, 3000.0, 6)
STRETCH = 400.0


def _contours(spark, sf):
    """(id, label, ring)"""
    cells = tables.cells(spark, sf)
    tiles = structure.dominant_bins(structure.assign_structure(cells, SPEC), TX, TY)
    corner = lambda i, j: F.struct(((F.col("ix") + i) * TX.step).alias("x"), ((F.col("iy") + j) * TY.step).alias("y"))
    tiles = tiles.select(F.concat_ws(":", F.lit("t"), "ix", "iy").alias("id"), F.concat(F.lit("S"), F.col("bin_structure")).alias("label"), F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))
    boxes = regions.quantile_boxes(cells, "cluster", 0.0037).select(F.concat_ws(":", F.lit("b"), "region").alias("id"), F.lit("box").alias("label"), "ring")
    return materialize(tiles.unionByName(boxes))


def x16_contours(spark, sf):
    found = contours.topology(_contours(spark, sf), "id", STRETCH)
    return found.select(
        "a", "b", F.round("exact", 3).alias("exact"), F.round("area", 0).alias("area"), *[F.round(c, 6).alias(c) for c in ("fraction_a", "fraction_b", "jaccard")], "neighbours", "overlapping"
    )


def x16_enclosures(spark, sf):
    found = contours.enclosures(contours.topology(_contours(spark, sf), "id", STRETCH))
    return found.select("outer", "inner", F.round("covered", 6).alias("covered"), F.round("occupied", 6).alias("occupied"))


def a25_contour_summary(spark, sf):
    c = _contours(spark, sf)
    found = materialize(contours.topology(c, "id", STRETCH))
    s = contours.summary(c, "id", found, contours.enclosures(found))
    return s.select("id", "n_neighbours", F.round("contact", 3).alias("contact"), F.round("contact_fraction", 6).alias("contact_fraction"), "n_overlaps", "n_inside", "n_around")


def x16_near_contours(spark, sf):
    """Boxes and tiles whose outlines run within 60 of each other without touching."""
    c = _contours(spark, sf)
    found = contours.topology(c, "id", STRETCH, tolerance=60.0)
    return found.where("neighbours").groupBy((F.col("exact") > 0).alias("touching")).agg(F.count("*").alias("n"), F.round(F.sum("shared"), 2).alias("shared"))


def _labels(spark, sf):
    c = _contours(spark, sf)
    return c, materialize(contours.label_edges(c, "id", "label", contours.topology(c, "id", STRETCH)))


def x17_label_matrix(spark, sf):
    c, found = _labels(spark, sf)
    return contours.label_matrix(c.select("label").distinct(), found).select("a", "b", F.round("length", 3).alias("length"))


def x18_network(spark, sf):
    return contours.network_nodes(contours.filtered(_labels(spark, sf)[1], ["box"], 500.0, 2))


def p14_edges(spark, sf):
    found = contours.filtered(_labels(spark, sf)[1], ["box"], 500.0, 2, 3)
    return found.select("a", "b", "n", F.round("length", 3).alias("length"))


def a33_envelope(spark, sf):
    """Bounding box of all contours of a label."""
    v = _contours(spark, sf).select("label", F.explode("ring").alias("v"))
    return v.groupBy("label").agg(F.round(F.min("v.x"), 2).alias("x0"), F.round(F.min("v.y"), 2).alias("y0"), F.round(F.max("v.x"), 2).alias("x1"), F.round(F.max("v.y"), 2).alias("y1"))


NAMES = "x16_contours x16_enclosures a25_contour_summary x16_near_contours x17_label_matrix x18_network p14_edges a33_envelope".split()
QUERIES = {n: globals()[n] for n in NAMES}

_RECTS = f"""{_BOXES.format(e=0.0037)}, tb AS (SELECT ix, iy, sid FROM (
  SELECT {_bin("x", 0.0, 5000.0, 10)} AS ix, {_bin("y", 0.0, 3000.0, 6)} AS iy, s.sid, row_number() OVER (PARTITION BY {_bin("x", 0.0, 5000.0, 10)}, {_bin("y", 0.0, 3000.0, 6)} ORDER BY count(*) DESC, s.sid) AS k
  FROM {_CELLS} c JOIN {SPEC_SQL} s(sid, cl) ON c.cluster = s.cl WHERE x BETWEEN 0 AND 5000 AND y BETWEEN 0 AND 3000 GROUP BY 1, 2, 3) WHERE k = 1),
r AS (SELECT 't:' || ix || ':' || iy AS id, 'S' || sid AS label, ix * {TX.step} AS x0, (ix + 1) * {TX.step} AS x1, iy * {TY.step} AS y0, (iy + 1) * {TY.step} AS y1 FROM tb
  UNION ALL SELECT 'b:' || region, 'box', x0, x1, y0, y1 FROM boxes),
p AS (SELECT a.id AS a, b.id AS b, a.label AS la, b.label AS lb, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ab, 2 * (a.x1 - a.x0 + a.y1 - a.y0) AS pa, 2 * (b.x1 - b.x0 + b.y1 - b.y0) AS pb,
  greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) AS w, greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS h,
  CAST(a.x0 = b.x0 AS INT) + CAST(a.x0 = b.x1 AS INT) + CAST(a.x1 = b.x0 AS INT) + CAST(a.x1 = b.x1 AS INT) AS vx,
  CAST(a.y0 = b.y0 AS INT) + CAST(a.y0 = b.y1 AS INT) + CAST(a.y1 = b.y0 AS INT) + CAST(a.y1 = b.y1 AS INT) AS vy FROM r a JOIN r b ON a.id < b.id),
t AS (SELECT *, vx * h + vy * w AS shared, w * h AS area FROM p WHERE vx * h + vy * w > 0 OR w * h > 1e-9),
enc AS (SELECT CASE WHEN aa > ab THEN a ELSE b END AS "outer", CASE WHEN aa > ab THEN b ELSE a END AS "inner", area / least(aa, ab) AS covered, area / greatest(aa, ab) AS occupied FROM t
  WHERE area > 1e-9 AND abs(aa - ab) > 1e-9 AND area / least(aa, ab) >= 0.95),
le AS (SELECT least(la, lb) AS a, greatest(la, lb) AS b, count(*) AS n, sum(shared) AS length FROM t WHERE shared > 0 GROUP BY ALL),
fe AS (SELECT * FROM le WHERE a <> 'box' AND b <> 'box' AND length >= 500 AND n >= 2)"""
ORACLE_SQL = {
    "x16_contours": f"""WITH {_RECTS} SELECT a, b, round(shared, 3) AS exact, round(area, 0) AS area, round(shared / pa, 6) AS fraction_a, round(shared / pb, 6) AS fraction_b, round(shared / (pa + pb - shared), 6) AS jaccard,
      shared > 0 AS neighbours, area > 1e-9 AS overlapping FROM t""",
    "x16_enclosures": f'WITH {_RECTS} SELECT "outer", "inner", round(covered, 6) AS covered, round(occupied, 6) AS occupied FROM enc',
    "a25_contour_summary": f"""WITH {_RECTS}, s AS (SELECT a AS id, shared, area, pa AS len FROM t UNION ALL SELECT b, shared, area, pb FROM t),
      g AS (SELECT id, count(*) FILTER (shared > 0) AS n, sum(shared) AS c, count(*) FILTER (area > 1e-9) AS v, min(len) AS len FROM s GROUP BY id)
      SELECT r.id, coalesce(n, 0) AS n_neighbours, round(coalesce(c, 0), 3) AS contact, round(coalesce(c / len, 0), 6) AS contact_fraction, coalesce(v, 0) AS n_overlaps,
      (SELECT count(*) FROM enc WHERE "outer" = r.id) AS n_inside, (SELECT count(*) FROM enc WHERE "inner" = r.id) AS n_around FROM r LEFT JOIN g USING (id)""",
    "x17_label_matrix": f"""WITH {_RECTS}, l AS (SELECT DISTINCT label FROM r), e AS (SELECT a, b, length FROM le UNION ALL SELECT b, a, length FROM le WHERE a <> b)
      SELECT x.label AS a, y.label AS b, round(coalesce(length, 0), 3) AS length FROM l x CROSS JOIN l y LEFT JOIN e ON e.a = x.label AND e.b = y.label""",
    "x18_network": f"""WITH {_RECTS}, s AS (SELECT a AS node, b AS other, length FROM fe UNION ALL SELECT b, a, length FROM fe WHERE a <> b)
      SELECT node, count(DISTINCT other) FILTER (other <> node) AS n_neighbours, count(*) AS n_edges, round(sum(length), 2) AS strength, round(round(sum(length), 2) / count(*), 4) AS mean_boundary FROM s GROUP BY node""",
    "p14_edges": f"WITH {_RECTS} SELECT a, b, n, round(length, 3) AS length FROM fe ORDER BY fe.length DESC, n DESC, a, b LIMIT 3",
    "a33_envelope": f"WITH {_RECTS} SELECT label, round(min(x0), 2) AS x0, round(min(y0), 2) AS y0, round(max(x1), 2) AS x1, round(max(y1), 2) AS y1 FROM r GROUP BY label",
}
