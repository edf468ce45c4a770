"""Queries over registration, landmarks, volumes and instances, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grid import Axis
from ..functions.ordered import aggregate
from ..operators import decisions as D
from ..operators import matching as M
from ..operators import regions, tracks
from ..operators import registration as R
from ..sources import tables
from ..sources.scratch import materialize
from ..sources.tables import SQL
from .fields import _BOXES as _OBJECTS
from .fields import _objects
from .structures import _BOXES, _CELLS

LIMIT = 2_000.0


def _sides(spark, sf):
    """Regions of each cluster in odd and in even slices as the points of two slices to be aligned."""
    s = tables.spots(spark, sf)
    at = lambda odd: s.where(F.col("sample") % 2 == odd).groupBy("cluster", "region").agg(F.avg("x").alias("x"), (F.avg("y") * 20).alias("y"), F.count("*").alias("area")).withColumn("id", F.concat_ws(":", "cluster", "region"))
    return materialize(at(1)), materialize(at(0))


def z2_chamfer(spark, sf):
    a, b = _sides(spark, sf)
    return R.chamfer(a, b, ["cluster"], "id", 20.0, LIMIT).select("cluster", F.round("chamfer", 4).alias("chamfer"))


def z1_score(spark, sf):
    """Score of leaving two slices as they are, by cluster."""
    a, b = _sides(spark, sf)
    c, loss = R.chamfer(a, b, ["cluster"], "id", 20.0, LIMIT), R.layout_loss(a, b, ["cluster"], "id", "area", 20.0, LIMIT)
    score = R.label_free_score(F.lit(0.5), F.col("chamfer"), F.col("loss"), F.lit(1000.0))
    return c.join(loss, "cluster").select("cluster", F.round("loss", 4).alias("loss"), F.round(score, 5).alias("score"))


def x43_backend(spark, sf):
    t = aggregate(tables.spots(spark, sf, place=True), ["region"], F.count("*").alias("n"), means={"w": F.col("weight"), "x": F.col("x")})
    return t.groupBy(R.backend(F.col("w") > 0.0505, F.col("n") % 3 > 0, (F.col("x") - 525) / 2).alias("backend")).agg(F.count("*").alias("n"))


def x45_landmarks(spark, sf):
    a, b = _sides(spark, sf)
    found = R.mutual_landmarks(a, b, ["cluster"], "id", 20.0, LIMIT, 2.0, 25)
    return found.select("cluster", "a", "b", F.round("d", 4).alias("d"))


def x50_tear(spark, sf):
    """Regions of odd slices drawn to those of even ones by what the regions about them do."""
    a, b = _sides(spark, sf)
    moves = a.where("region % 3 = 0").join(b.select("id", F.col("x").alias("u"), F.col("y").alias("v")), "id").select("x", "y", (F.col("u") - F.col("x")).alias("dx"), (F.col("v") - F.col("y")).alias("dy"))
    moved = R.tear_field(a.select("id", "cluster", "x", "y"), "id", moves, 12.0, 15.0)
    return moved.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("x"), 3).alias("x"), F.round(F.avg("y"), 3).alias("y"))


def z14_padding(spark, sf):
    p = R.padding_points(tables.cells(spark, sf), ["slice"], 5, 50.0)
    return p.select("slice", "i", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def x53_volumes(spark, sf):
    """Parts of the voxels that hold points, by size."""
    p = tables.points(spark, sf)
    axis = {c: Axis(-1.0, 1.0, 25) for c in "xyz"}
    v = p.where(" and ".join(f"{c} >= -1 and {c} <= 1" for c in "xyz")).select(*[axis[c].clipped(c).alias(f"i{c}") for c in "xyz"])
    return R.volume_parts(v).groupBy("part").agg(F.max("n").alias("n"), F.sum("ix").alias("sum_x"))


def x39_support(spark, sf):
    s = tables.spots(spark, sf).groupBy("region", "cluster", "sample").agg(F.avg("x").alias("x"), F.avg("weight").alias("w"))
    n = s.select("region", "cluster", (F.col("sample") - 1).alias("sample"), F.col("x").alias("x2"), F.col("w").alias("w2"))
    m = s.join(n, ["region", "cluster", "sample"]).select("region", "sample", "cluster", (1 / (1 + F.abs(F.col("x") - F.col("x2")) / 50)).alias("same"), (20 * F.abs(F.col("w") - F.col("w2"))).alias("flip"))
    return R.bootstrap_support(m, ["region", "sample"], "cluster", "same", "flip")


def a35_tiles(spark, sf):
    """Features of tiles, standardised over all tiles."""
    x, y = Axis(0.0, 5000.0, 12), Axis(0.0, 3000.0, 8)
    c = tables.cells(spark, sf).where(x.inside("x") & y.inside("y")).withColumns({"ix": x.clipped("x").cast("bigint"), "iy": y.clipped("y").cast("bigint")})
    f = c.groupBy("ix", "iy").agg(F.count("*").cast("double").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return R.scaled_features(f, [], ["n", "mx", "my", "sx", "sy"]).select("ix", "iy", *[F.round(k, 5).alias(k) for k in ("n", "mx", "my", "sx", "sy")])


def x35_rows(spark, sf):
    t = tables.spots(spark, sf).groupBy("region", "cluster").agg(F.avg("x").alias("v")).where(F.col("cluster").isin("AF", "NO", "RF"))
    return R.scaled_features(t, ["region"], ["v"]).select("region", "cluster", F.round("v", 5).alias("v"))


def j16_fallback_links(spark, sf):
    """Links by distance and size for objects that overlap leaves alone on both sides."""
    o = materialize(_objects(spark, sf))
    close = materialize(tracks.links(o, "sample", "id", "cluster", 60.0, 1.6))
    return M.unmatched(close.where("iou >= 0.8"), close, "source", "target").select("source", "target", "score")


def z34_best_link(spark, sf):
    """The better of an object's links: overlap, then score, then name."""
    found = tracks.links(_objects(spark, sf), "sample", "id", "cluster", 30.0, 1.6)
    return M.first_of(found, ["source"], [-F.col("iou"), -F.col("score"), F.col("target")]).select("source", "target", "iou")


def d13_reasons(spark, sf):
    """Why candidate links are taken or not."""
    found = materialize(tracks.links(_objects(spark, sf), "sample", "id", "cluster", 30.0, 1.6))
    best = M.mutual_best(found, "source", "target", "score").select("source", "target", F.lit(True).alias("mutual"))
    c = found.join(best, ["source", "target"], "left")
    reason = D.acceptance(F.coalesce("mutual", F.lit(False)), F.col("score"), (1 - F.col("iou")) * 100, F.col("iou"), F.col("score"), 0.92, 12.0, 0.93, 5.0, (0.0, 0.95))
    return c.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def z33_instances(spark, sf):
    """Instances with a value of their own or, where it is missing, that of their quality row."""
    c = tables.cells(spark, sf).groupBy("owner").agg(F.max("x").alias("own"), F.count("*").alias("n"))
    own = c.select("owner", F.when(F.col("n") % 2 == 0, F.col("own")).alias("own"))
    row = c.where("n % 3 > 0").select("owner", (F.col("own") / 2).alias("row"))
    return own.join(row, "owner", "left").select("owner", F.round(F.coalesce("own", "row"), 1).alias("value"))


def z29_mask(spark, sf):
    """Bins whose middle lies in a cluster's box."""
    boxes = regions.quantile_boxes(tables.cells(spark, sf), "cluster", 0.0037)
    return regions.region_bins(boxes, "region", Axis(0.0, 5000.0, 25), Axis(0.0, 3000.0, 15)).groupBy("region").agg(F.count("*").alias("n"), F.sum("ix").alias("sum_x"), F.sum("iy").alias("sum_y"))


def x57_nearest_clusters(spark, sf):
    """The three clusters whose centroids are nearest to each cluster's."""
    from ..operators.structure import centroid_matrix

    m = centroid_matrix(tables.points(spark, sf), "xyz").where("a <> b")
    return M.top_k(m, ["a"], [F.col("distance"), F.col("b")], 3)


NAMES = "z2_chamfer z1_score x43_backend x45_landmarks x50_tear z14_padding x53_volumes x39_support a35_tiles x35_rows j16_fallback_links z34_best_link d13_reasons z33_instances z29_mask x57_nearest_clusters".split()
QUERIES = {n: globals()[n] for n in NAMES}

_SPOTS, _POINTS = SQL["spots"], SQL["points"]
_SIDES = f"""oa AS (SELECT cluster, region, cluster || ':' || region AS id, avg(x) AS x, avg(y) * 20 AS y, count(*) AS area FROM {_SPOTS} WHERE sample % 2 = 1 GROUP BY cluster, region),
ob AS (SELECT cluster, region, cluster || ':' || region AS id, avg(x) AS x, avg(y) * 20 AS y, count(*) AS area FROM {_SPOTS} WHERE sample % 2 = 0 GROUP BY cluster, region),
ab AS (SELECT p.cluster, p.id AS a, q.id AS b, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS d FROM oa p JOIN ob q ON p.cluster = q.cluster),
na AS (SELECT * FROM ab QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1), nb AS (SELECT * FROM ab QUALIFY row_number() OVER (PARTITION BY b ORDER BY d, a) = 1),
ch AS (SELECT cluster, avg(m) AS chamfer FROM (SELECT cluster, median(d) AS m FROM na GROUP BY cluster UNION ALL SELECT cluster, median(d) FROM nb GROUP BY cluster) GROUP BY cluster),
wa AS (SELECT id, least(area / sum(area) OVER (PARTITION BY cluster), 0.08) AS w FROM oa), wb AS (SELECT id, least(area / sum(area) OVER (PARTITION BY cluster), 0.08) AS w FROM ob),
lo AS (SELECT cluster, avg(l) AS loss FROM (SELECT cluster, sum(w * d) AS l FROM na JOIN wa ON id = a GROUP BY cluster UNION ALL SELECT cluster, sum(w * d) FROM nb JOIN wb ON id = b GROUP BY cluster) GROUP BY cluster)"""
_TILE = "SELECT CAST(least(floor(x / (5000.0::DOUBLE / 12)), 11) AS BIGINT) AS ix, CAST(least(floor(y / 375.0), 7) AS BIGINT) AS iy, CAST(count(*) AS DOUBLE) AS n, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy"
ORACLE_SQL = {
    "z2_chamfer": f"WITH {_SIDES} SELECT cluster, round(chamfer, 4) AS chamfer FROM ch",
    "x43_backend": f"""WITH t AS (SELECT avg(weight) AS w, count(*) AS n, (avg(x) - 525) / 2 AS r FROM {_SPOTS} GROUP BY region)
      SELECT CASE WHEN w > 0.0505 THEN 'label_free' WHEN n % 3 > 0 AND abs(r) <= 15 THEN 'contour' ELSE 'translation' END AS backend, count(*) AS n FROM t GROUP BY 1""",
    "x45_landmarks": f"""WITH {_SIDES}, m AS (SELECT na.* FROM na JOIN nb USING (a, b)), o AS (SELECT *, abs(d - median(d) OVER (PARTITION BY cluster)) AS o FROM m), s AS (SELECT *, median(o) OVER (PARTITION BY cluster) AS s FROM o),
      k AS (SELECT * FROM s WHERE o <= 2.0 * CAST(1.4826 AS DOUBLE) * s) SELECT cluster, a, b, round(d, 4) AS d FROM k QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY k.d, a) <= 25""",
    "x50_tear": f"""WITH {_SIDES}, mv AS (SELECT oa.x, oa.y, ob.x - oa.x AS dx, ob.y - oa.y AS dy FROM oa JOIN ob USING (id) WHERE oa.region % 3 = 0),
      n AS (SELECT oa.id, mv.dx, mv.dy, exp(-(power(oa.x - mv.x, 2) + power(oa.y - mv.y, 2)) / 72) AS w FROM oa JOIN mv ON power(oa.x - mv.x, 2) + power(oa.y - mv.y, 2) <= 144),
      g AS (SELECT id, sum(dx * w) / sum(w) AS dx, sum(dy * w) / sum(w) AS dy FROM n GROUP BY id), c AS (SELECT id, dx * least(1, 15 / sqrt(dx * dx + dy * dy)) AS dx, dy * least(1, 15 / sqrt(dx * dx + dy * dy)) AS dy FROM g)
      SELECT cluster, count(*) AS n, round(avg(x + coalesce(dx, 0)), 3) AS x, round(avg(y + coalesce(dy, 0)), 3) AS y FROM oa LEFT JOIN c USING (id) GROUP BY cluster""",
    "z14_padding": f"""WITH b AS (SELECT slice, min(x) - 50 AS lx, max(x) + 50 AS hx, min(y) - 50 AS ly, max(y) + 50 AS hy FROM {_CELLS} GROUP BY slice), i AS (SELECT *, unnest(range(20)) AS i FROM b), t AS (SELECT *, i // 5 AS s, (i % 5) / 5 AS t FROM i)
      SELECT slice, CAST(i AS INT) AS i, round(CASE s WHEN 0 THEN lx + (hx - lx) * t WHEN 1 THEN hx WHEN 2 THEN lx + (hx - lx) * (1 - t) ELSE lx END, 3) AS x, round(CASE s WHEN 0 THEN ly WHEN 1 THEN ly + (hy - ly) * t WHEN 2 THEN hy ELSE ly + (hy - ly) * (1 - t) END, 3) AS y FROM t""",
    "a35_tiles": f"""WITH f AS ({_TILE} FROM {_CELLS} WHERE x BETWEEN 0 AND 5000 AND y BETWEEN 0 AND 3000 GROUP BY 1, 2)
      SELECT ix, iy, {", ".join(f"round(({c} - avg({c}) OVER ()) / greatest(stddev_pop({c}) OVER (), 1e-6), 5) AS {c}" for c in ("n", "mx", "my", "sx", "sy"))} FROM f""",
    "x35_rows": f"""WITH t AS (SELECT region, cluster, avg(x) AS v FROM {_SPOTS} WHERE cluster IN ('AF', 'NO', 'RF') GROUP BY ALL) SELECT region, cluster, round((v - avg(v) OVER w) / greatest(stddev_pop(v) OVER w, 1e-6), 5) AS v FROM t WINDOW w AS (PARTITION BY region)""",
    "j16_fallback_links": f"WITH {_OBJECTS.replace('d / 30', 'd / 60').replace('d <= 30', 'd <= 60')} SELECT source, target, score FROM l WHERE source NOT IN (SELECT source FROM l WHERE iou >= 0.8) AND target NOT IN (SELECT target FROM l WHERE iou >= 0.8)",
    "z34_best_link": f"WITH {_OBJECTS} SELECT source, target, iou FROM l QUALIFY row_number() OVER (PARTITION BY source ORDER BY iou DESC, score DESC, target) = 1",
    "d13_reasons": f"""WITH {_OBJECTS}, c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) = 1 AND row_number() OVER (PARTITION BY target ORDER BY score DESC, source) = 1 AS mutual, (1 - iou) * 100 AS d FROM l)
      SELECT CASE WHEN NOT mutual THEN 'not_mutual_best' WHEN score < 0.92 THEN 'score_below_threshold' WHEN d > 12 THEN 'centroid_distance_above_threshold'
      WHEN iou >= 0.93 OR (d <= 5 AND score BETWEEN 0 AND 0.95) THEN 'mutual_high_score_local_overlap' ELSE 'insufficient_overlap' END AS reason, count(*) AS n FROM c GROUP BY 1""",
    "z33_instances": f"""WITH c AS (SELECT owner, max(x) AS own, count(*) AS n FROM {_CELLS} GROUP BY owner) SELECT owner, round(coalesce(CASE WHEN n % 2 = 0 THEN own END, CASE WHEN n % 3 > 0 THEN own / 2 END), 1) AS value FROM c""",
    "z29_mask": f"""WITH {_BOXES.format(e=0.0037)}, g AS (SELECT i % 25 AS ix, i // 25 AS iy FROM (SELECT unnest(range(375)) AS i)) SELECT region, count(*) AS n, CAST(sum(ix) AS BIGINT) AS sum_x, CAST(sum(iy) AS BIGINT) AS sum_y
      FROM g JOIN boxes ON (ix + 0.5) * 200 BETWEEN x0 AND x1 AND (iy + 0.5) * 200 BETWEEN y0 AND y1 GROUP BY region""",
    "x53_volumes": f"""WITH RECURSIVE v AS (SELECT DISTINCT {", ".join(f"CAST(least(floor(({c} + 1) / 0.08), 24) AS BIGINT) AS i{c}" for c in "xyz")} FROM {_POINTS} WHERE {" AND ".join(f"{c} BETWEEN -1 AND 1" for c in "xyz")}),
      k AS (SELECT *, format('{{:05d}}:{{:05d}}:{{:05d}}', iz, iy, ix) AS at FROM v), e AS (SELECT a.at AS a, b.at AS b FROM k a JOIN k b ON abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1),
      r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), p AS (SELECT a, min(b) AS part FROM r GROUP BY a)
      SELECT part, count(*) AS n, CAST(sum(ix) AS BIGINT) AS sum_x FROM k JOIN p ON p.a = k.at GROUP BY part""",
    "x57_nearest_clusters": f"""WITH c AS (SELECT cluster, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM {_POINTS} GROUP BY cluster),
      m AS (SELECT p.cluster AS a, q.cluster AS b, round(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)), 6) AS distance FROM c p JOIN c q ON p.cluster <> q.cluster)
      SELECT a, b, distance, row_number() OVER w AS rank FROM m WINDOW w AS (PARTITION BY a ORDER BY distance, b) QUALIFY row_number() OVER w <= 3""",
    "z1_score": f"WITH {_SIDES} SELECT cluster, round(loss, 4) AS loss, round(0.45 * 0.5 + 0.40 * exp(-chamfer / 15) + 0.15 * exp(-loss / 20), 5) AS score FROM ch JOIN lo USING (cluster)",
}
