"""Queries over interpolated outlines of fields, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grid import Axis
from ..operators import alpha, fields, isolines, levels, structure, superpixels, surfaces
from ..sources import tables
from ..sources.scratch import materialize
from ..sources.tables import SQL
from .fields import _smooth
from .structures import _CELLS, _PLACED, SPEC, X, Y

GENES = ["F", "O", "P", "none"]
K, RADIUS, LIMIT, SIGMA = 30, 60.0, 200.0, 5.0
ALPHA = 0.12
CUBE = (Axis(-0.4, 0.4, 12), Axis(-0.4, 0.4, 12), Axis(-0.4, 0.4, 12))


def x15_contours(spark, sf):
    """Outlines halfway between the bins of each structure and those of the others."""
    bins = structure.dominant_bins(structure.assign_structure(tables.cells(spark, sf), SPEC), X, Y)
    mask = bins.where("bin_structure > 0").select(F.col("bin_structure").alias("structure"), "ix", "iy", F.lit(1.0).alias("value"))
    ringed = levels.rings(materialize(levels.segments(mask, ["structure"], 0.5, X, Y, 0.0)), ["structure"])
    s = levels.ring_sizes(ringed, ["structure"])
    return s.groupBy("structure").agg(F.count("*").alias("n_rings"), F.count_if(F.col("area") < 0).alias("n_holes"), F.round(F.sum("area"), 2).alias("area"), F.round(F.sum("length"), 2).alias("length"), F.round(F.max("area"), 2).alias("largest"))


def x10_level_areas(spark, sf):
    """Areas where the smoothed density of a structure's cells passes three levels."""
    cells = structure.assign_structure(tables.cells(spark, sf), SPEC)
    h = cells.where("structure_id > 0").where(X.inside("x") & Y.inside("y")).groupBy("structure_id", X.clipped("x").alias("ix"), Y.clipped("y").alias("iy")).agg(F.count("*").cast("double").alias("value"))
    even = materialize(fields.smooth(h, ["structure_id"], {"ix": X.n, "iy": Y.n}, 1.5, ["value"]))
    top = even.groupBy("structure_id").agg(F.max("value").alias("top"))
    share = even.join(top, "structure_id").select("structure_id", "ix", "iy", F.round(F.col("value") / F.col("top"), 9).alias("value"))
    share = materialize(share)
    rows = None
    for level in (0.25, 0.5, 0.75):
        s = levels.ring_sizes(levels.rings(levels.segments(share, ["structure_id"], level, X, Y, 0.0), ["structure_id"]), ["structure_id"])
        one = s.groupBy("structure_id").agg(F.count("*").alias("n_rings"), F.round(F.sum("area"), 1).alias("area")).withColumn("level", F.lit(level))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def x12_isoline(spark, sf):
    """Outlines of where the most urgent cells prevail, with ten of them or more inside."""
    cells = tables.cells(spark, sf).select("cell_id", "x", "y", (F.col("cluster") == "1-URGENT").cast("int").alias("target"))
    field = isolines.target_field(cells, X, Y, K, RADIUS, LIMIT, SIGMA).select("ix", "iy", F.round("value", 9).alias("value"))
    one = materialize(field.withColumn("key", F.lit("urgent")))
    own = cells.where("target = 1").select(F.lit("urgent").alias("key"), F.col("cell_id").alias("id"), "x", "y")
    sizes, _ = isolines.level_isolines(one, own, ["key"], X, Y, 0.2, 10)
    return sizes.select("ring", F.round("area", 1).alias("area"), F.round("length", 1).alias("length"), "n_targets")


def x13_gene_isolines(spark, sf):
    """Outlines for each order status, its orders standing for molecules among all cells."""
    c = tables.cells(spark, sf)
    return isolines.gene_isolines(c.select(F.col("cell_id").alias("id"), "x", "y", F.col("slice").alias("gene")), c, X, Y, GENES, K, RADIUS, LIMIT, SIGMA, 0.33)


def x14_alpha(spark, sf):
    """Border of the triangles under a circumradius, by label."""
    edges = alpha.border(tables.points(spark, sf).select("cluster", "vec_id", "x", "y"), ["cluster"], "vec_id", ALPHA)
    s = alpha.sizes(edges, ["cluster"])
    return s.select("cluster", "n_edges", F.round("area", 6).alias("area"), F.round("length", 6).alias("length"))


def _voxels(spark, sf):
    """(half, ix, iy, iz, value): points in each voxel, by the parity of their label."""
    p = tables.points(spark, sf).where("x is not null and y is not null and z is not null")
    at = [F.floor((F.col(c) - a.low) / a.step).cast("int").alias(f"i{c}") for c, a in zip("xyz", CUBE, strict=True)]
    return p.where(" and ".join(f"{c} >= {a.low} and {c} < {a.high}" for c, a in zip("xyz", CUBE, strict=True))).groupBy((F.col("cluster").cast("int") % 2).alias("half"), *at).agg(F.count("*").cast("double").alias("value"))


def x53_mesh(spark, sf):
    """Surfaces about the voxels that hold points: counts, whether they are closed, area and volume."""
    s = surfaces.summary(materialize(surfaces.triangles(_voxels(spark, sf), ["half"], 0.6, CUBE, 0.0)), ["half"])
    return s.select("half", "n_faces", "n_vertices", "n_edges", "euler", "n_open_edges", F.round("area", 5).alias("area"), F.round("volume", 6).alias("volume"))


def x53_mesh_parts(spark, sf):
    """Connected surfaces of forty triangles or more."""
    mesh = surfaces.parts(surfaces.triangles(_voxels(spark, sf), ["half"], 0.6, CUBE, 0.0), ["half"])
    s = surfaces.summary(materialize(surfaces.large_parts(mesh, ["half"], 40)), ["half", "part"])
    return s.groupBy("half").agg(F.count("*").alias("n_parts"), F.max("n_faces").alias("largest"), F.round(F.sum("volume"), 6).alias("volume"))


IX, IY, STEP, COMPACT, ROUNDS = Axis(0.0, 1060.0, 48), Axis(0.0, 51.0, 32), 6, 20.0, 10


def _image(spark, sf):
    """Spots as a picture: discounts in red, slices in green, the share of one label in blue."""
    s = tables.spots(spark, sf).where(IX.inside("x") & IY.inside("y"))
    channels = [F.round(255 * c, 3).alias(n) for n, c in (("r", F.avg("weight") * 10), ("g", (F.avg("sample") - 1) / 6), ("b", F.avg((F.col("cluster") == "NO").cast("double"))))]
    return materialize(s.groupBy(IX.clipped("x").alias("ix"), IY.clipped("y").alias("iy")).agg(*channels))


def x54_superpixels(spark, sf):
    taken = superpixels.superpixels(_image(spark, sf), ["r", "g", "b"], STEP, COMPACT, ROUNDS)
    return taken.groupBy((F.col("seed") % superpixels.tiles.WIDE).alias("sx"), F.floor(F.col("seed") / superpixels.tiles.WIDE).alias("sy")).agg(F.count("*").alias("n"), F.round(F.avg("ix"), 4).alias("mx"), F.round(F.avg("iy"), 4).alias("my"))


def x54_superpixel_components(spark, sf):
    """Parts of like superpixels, by k-means of their ten standardised features."""
    image = _image(spark, sf)
    segments = materialize(superpixels.superpixels(image, ["r", "g", "b"], STEP, COMPACT, ROUNDS))
    table = materialize(superpixels.features(image, segments, IX.n, IY.n))
    labels = segments.join(superpixels.components_of(table, 4), "seed")
    return superpixels.cleaned(labels, 6).groupBy("component", "part").agg(F.count("*").alias("n"), F.round(F.avg("ix"), 4).alias("mx"), F.round(F.avg("iy"), 4).alias("my"))


NAMES = "x54_superpixels x54_superpixel_components x53_mesh x53_mesh_parts x15_contours x10_level_areas x12_isoline x13_gene_isolines x14_alpha".split()
QUERIES = {n: globals()[n] for n in NAMES}


def _outline_sql(field: str, key: str, level: str, x: Axis, y: Axis) -> str:
    """Tables of the outlines of ``field`` (key, ix, iy, value): ``st`` its steps, ``rg`` the ring of each, by a closure over the steps."""
    corner = " UNION ALL ".join(f"SELECT {key}, {i} AS c, ix - {dx} AS cx, iy - {dy} AS cy, value FROM {field}" for i, (dx, dy) in enumerate(levels.CORNERS))
    case = ", ".join(f"({i}, {s}, {e})" for i, steps in enumerate(levels.STEPS) for s, e in steps)
    side = lambda p: f"CASE {p} WHEN 0 THEN {{0}} WHEN 1 THEN {{1}} WHEN 2 THEN {{2}} ELSE {{3}} END"
    name = ["(cy + 1) * 4294967296 + (cx + 1) * 2", "(cy + 1) * 4294967296 + (cx + 2) * 2 + 1", "(cy + 2) * 4294967296 + (cx + 1) * 2", "(cy + 1) * 4294967296 + (cx + 1) * 2 + 1"]
    t = [f"(({level} - v{i}) / nullif(v{j} - v{i}, 0))" for i, j in levels.SIDES]
    px = [f"cx + {levels.CORNERS[i][0]} + {levels.CORNERS[j][0] - levels.CORNERS[i][0]} * {t[k]}" for k, (i, j) in enumerate(levels.SIDES)]
    py = [f"cy + {levels.CORNERS[i][1]} + {levels.CORNERS[j][1] - levels.CORNERS[i][1]} * {t[k]}" for k, (i, j) in enumerate(levels.SIDES)]
    ends = ", ".join(f"{side(p).format(*name)} AS {n}, {x.low} + ({side(p).format(*px)} + CAST(0.5 AS DOUBLE)) * {x.step} AS {n}_x, {y.low} + ({side(p).format(*py)} + CAST(0.5 AS DOUBLE)) * {y.step} AS {n}_y" for p, n in (("s", "a"), ("e", "b")))
    v = ", ".join(f"CAST(coalesce(max(value) FILTER (c = {i}), 0) AS DOUBLE) AS v{i}" for i in range(4))
    bits = " + ".join(f"CASE WHEN v{i} >= {level} THEN {1 << i} ELSE 0 END" for i in range(4))
    return f"""co AS ({corner}), sq AS (SELECT {key}, cx, cy, {v} FROM co GROUP BY {key}, cx, cy), sb AS (SELECT *, {bits} AS bits FROM sq),
      sc AS (SELECT *, CASE WHEN bits = 5 AND (v0 + v1 + v2 + v3) / 4 >= {level} THEN 16 WHEN bits = 10 AND (v0 + v1 + v2 + v3) / 4 >= {level} THEN 17 ELSE bits END AS kind FROM sb),
      st AS (SELECT {key}, {ends} FROM sc JOIN (VALUES {case}) q(kind, s, e) USING (kind)),
      cl({key}, a, b) AS (SELECT {key}, a, b FROM st UNION SELECT cl.{key}, cl.a, st.b FROM cl JOIN st ON st.{key} = cl.{key} AND st.a = cl.b), rn AS (SELECT {key}, a, min(b) AS ring FROM cl GROUP BY {key}, a),
      rg AS (SELECT {key}, ring, count(*) AS n, sum(a_x * b_y - b_x * a_y) / 2 AS area, sum(sqrt(power(b_x - a_x, 2) + power(b_y - a_y, 2))) AS length FROM st JOIN rn USING ({key}, a) GROUP BY {key}, ring)"""


def _inside_sql(points: str, key: str) -> str:
    """``hd``: how many ``points`` (key, id, x, y) each ring holds."""
    return f"""tn AS (SELECT p.{key}, p.id, ring, sum(CASE WHEN a_x + (p.y - a_y) * (b_x - a_x) / (b_y - a_y) < p.x THEN CASE WHEN b_y < a_y THEN 1 ELSE -1 END ELSE 0 END) AS turns
        FROM {points} p JOIN (SELECT st.*, ring FROM st JOIN rn USING ({key}, a)) w ON w.{key} = p.{key} AND (a_y > p.y) <> (b_y > p.y) GROUP BY p.{key}, p.id, ring),
      hd AS (SELECT {key}, ring, count(*) AS n_targets FROM tn WHERE turns <> 0 GROUP BY {key}, ring)"""


_NODES = f"nd AS (SELECT ix, iy, {X.low} + (ix + CAST(0.5 AS DOUBLE)) * {X.step} AS nx, {Y.low} + (iy + CAST(0.5 AS DOUBLE)) * {Y.step} AS ny FROM (SELECT unnest(range({X.n})) AS ix), (SELECT unnest(range({Y.n})) AS iy))"
_VALUE = "CASE WHEN count(*) FILTER (d2 = 0) > 0 THEN avg(target) FILTER (d2 = 0) ELSE sum(target / sqrt(d2)) FILTER (d2 > 0) / sum(1 / sqrt(d2)) FILTER (d2 > 0) END"
_D2 = "(nx - x) * (nx - x) + (ny - y) * (ny - y)"


def _field_sql(near: str, key: str) -> str:
    """``fd`` (key, ix, iy, value) from ``near`` (key, ix, iy, d2, target)."""
    return f"""bn AS (SELECT {key}, ix, iy, {_VALUE} AS target, CAST(1 AS DOUBLE) AS "on" FROM {near} GROUP BY {key}, ix, iy), {_smooth("bn", "ev", key, X.n, Y.n, ["target", '"on"'], SIGMA, "nearest")},
      fd AS (SELECT ev.{key}, ix, iy, round(ev.target / ev."on", 9) AS value FROM ev JOIN (SELECT {key}, ix, iy FROM bn) USING ({key}, ix, iy))"""




def _mesh_sql() -> str:
    """Tables of the surface of the voxel counts: ``tr`` its triangles with names and places of their vertices, ``ed`` its edges."""
    at = ", ".join(f"CAST(floor(({c} - {a.low}) / {a.step}) AS BIGINT) AS i{c}" for c, a in zip("xyz", CUBE, strict=True))
    inside = " AND ".join(f"{c} >= {a.low} AND {c} < {a.high}" for c, a in zip("xyz", CUBE, strict=True))
    corners = " UNION ALL ".join(f"SELECT half, {c} AS c, ix - {c & 1} AS cx, iy - {c >> 1 & 1} AS cy, iz - {c >> 2 & 1} AS cz, value FROM vx" for c in range(8))
    values = ", ".join(f"CAST(coalesce(max(value) FILTER (c = {c}), 0) AS DOUBLE)" for c in range(8))
    tets = " UNION ALL ".join(f"SELECT *, {t} AS tet, " + " + ".join(f"CASE WHEN v[{c + 1}] >= 0.6 THEN {1 << i} ELSE 0 END" for i, c in enumerate(cs)) + " AS bits FROM cu" for t, cs in enumerate(surfaces.TETRAHEDRA))
    table = ", ".join(str(r) for r in surfaces.triangle_table())
    ends = []
    for p in "abc":
        share = f"((CAST(0.6 AS DOUBLE) - v[{p}0 + 1]) / (v[{p}1 + 1] - v[{p}0 + 1]))"
        ends.append(f"concat_ws(':', cx + ({p}0 & 1), cy + ({p}0 >> 1 & 1), cz + ({p}0 >> 2 & 1), {p}1 - {p}0) AS {p}")
        for k, (n, a) in enumerate(zip("xyz", CUBE, strict=True)):
            ends.append(f"{a.low} + (c{n} + ({p}0 >> {k} & 1) + (({p}1 >> {k} & 1) - ({p}0 >> {k} & 1)) * {share} + CAST(0.5 AS DOUBLE)) * {a.step} AS {p}_{n}")
    return f"""vx AS (SELECT CAST(cluster AS INT) % 2 AS half, {at}, CAST(count(*) AS DOUBLE) AS value FROM {SQL["points"]} WHERE {inside} GROUP BY ALL), co AS ({corners}),
      cu AS (SELECT half, cx, cy, cz, [{values}] AS v FROM co GROUP BY half, cx, cy, cz), te AS ({tets}),
      tr AS (SELECT half, {", ".join(ends)} FROM te JOIN (VALUES {table}) q(tet, bits, a0, a1, b0, b1, c0, c1) USING (tet, bits)),
      ed AS (SELECT half, least(u, w) AS u, greatest(u, w) AS w, count(*) AS n FROM (SELECT half, a AS u, b AS w FROM tr UNION ALL SELECT half, b, c FROM tr UNION ALL SELECT half, c, a FROM tr) GROUP BY ALL)"""


def _superpixel_sql() -> str:
    """Tables of the rounds; the last are the pixels' seeds ``t<rounds>``."""
    bin_ = lambda c, a: f"CAST(least(floor(({c} - {a.low}) / {a.step}), {a.n - 1}) AS BIGINT)"
    far = " + ".join(f"power(p.{v} - s.{v}, 2)" for v in "rgb") + f" + {(COMPACT / STEP) ** 2!r} * (power(p.ix - s.ix, 2) + power(p.iy - s.iy, 2))"
    means = ", ".join(f"avg({v}) AS {v}" for v in ("r", "g", "b", "ix", "iy"))
    out = f"""im AS (SELECT {bin_("x", IX)} AS ix, {bin_("y", IY)} AS iy, round(255 * (avg(weight) * 10), 3) AS r, round(255 * ((avg(sample) - 1) / 6), 3) AS g, round(255 * avg(CASE WHEN cluster = 'NO' THEN 1.0 ELSE 0 END), 3) AS b
      FROM {SQL["spots"]} WHERE x BETWEEN {IX.low} AND {IX.high} AND y BETWEEN {IY.low} AND {IY.high} GROUP BY ALL), p AS (SELECT *, ix // {STEP} AS cx, iy // {STEP} AS cy FROM im), s0 AS (SELECT cx AS sx, cy AS sy, {means} FROM p GROUP BY cx, cy)"""
    for i in range(1, ROUNDS + 1):
        out += f""", t{i} AS (SELECT p.*, s.sx, s.sy FROM p JOIN s{i - 1} s ON abs(s.sx - cx) <= 1 AND abs(s.sy - cy) <= 1 QUALIFY row_number() OVER (PARTITION BY p.ix, p.iy ORDER BY round({far}, 9), s.sy, s.sx) = 1),
      s{i} AS (SELECT sx, sy, {means} FROM t{i} GROUP BY sx, sy)"""
    return out


_NX, _NY, _NZ = (f"((b_{p} - a_{p}) * (c_{q} - a_{q}) - (b_{q} - a_{q}) * (c_{p} - a_{p}))" for p, q in ("yz", "zx", "xy"))
_TRIPLE = "(a_x * (b_y * c_z - b_z * c_y) + a_y * (b_z * c_x - b_x * c_z) + a_z * (b_x * c_y - b_y * c_x)) / 6"
ORACLE_SQL = {
    "x54_superpixels": f"WITH {_superpixel_sql()} SELECT sx, sy, count(*) AS n, round(avg(ix), 4) AS mx, round(avg(iy), 4) AS my FROM t{ROUNDS} GROUP BY sx, sy",
    "x53_mesh": f"""WITH {_mesh_sql()}, f AS (SELECT half, count(*) AS n_faces, sum(sqrt({_NX} * {_NX} + {_NY} * {_NY} + {_NZ} * {_NZ})) / 2 AS area, sum({_TRIPLE}) AS volume FROM tr GROUP BY half),
      v AS (SELECT half, count(DISTINCT p) AS n_vertices FROM (SELECT half, unnest([a, b, c]) AS p FROM tr) GROUP BY half), e AS (SELECT half, count(*) AS n_edges, count(*) FILTER (n <> 2) AS n_open_edges FROM ed GROUP BY half)
      SELECT half, n_faces, n_vertices, n_edges, n_vertices - n_edges + n_faces AS euler, n_open_edges, round(area, 5) AS area, round(volume, 6) AS volume FROM f JOIN v USING (half) JOIN e USING (half)""",
    "x14_alpha": f"""WITH p AS (SELECT cluster, x, y, min(vec_id) AS id FROM {SQL["points"]} WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
      e AS (SELECT a.cluster, a.id AS a, b.id AS b, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy, sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2)) AS d FROM p a JOIN p b ON a.cluster = b.cluster AND a.id <> b.id),
      c AS (SELECT *, (px + qx) / 2 + (qy - py) / d * sqrt({ALPHA * ALPHA} - d * d / 4) AS cx, (py + qy) / 2 - (qx - px) / d * sqrt({ALPHA * ALPHA} - d * d / 4) AS cy FROM e WHERE d < {2 * ALPHA}),
      f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.cluster = c.cluster AND p.id <> c.a AND p.id <> c.b AND power(p.x - cx, 2) + power(p.y - cy, 2) < {ALPHA * ALPHA}))
      SELECT cluster, count(*) AS n_edges, round(sum(px * qy - qx * py) / 2, 6) AS area, round(sum(d), 6) AS length FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.cluster = f.cluster AND g.a = f.b AND g.b = f.a) GROUP BY cluster""",
    "x15_contours": f"""WITH RECURSIVE {_PLACED}, fd AS (SELECT bin_structure AS structure, ix, iy, 1.0 AS value FROM bins WHERE bin_structure > 0), {_outline_sql("fd", "structure", "CAST(0.5 AS DOUBLE)", X, Y)}
      SELECT structure, count(*) AS n_rings, count(*) FILTER (area < 0) AS n_holes, round(sum(area), 2) AS area, round(sum(length), 2) AS length, round(max(area), 2) AS largest FROM rg GROUP BY structure""",
    "x10_level_areas": f"""WITH RECURSIVE {_PLACED}, h AS (SELECT structure_id, ix, iy, CAST(count(*) AS DOUBLE) AS value FROM placed WHERE structure_id > 0 AND x BETWEEN {X.low} AND {X.high} AND y BETWEEN {Y.low} AND {Y.high} GROUP BY ALL),
      {_smooth("h", "ev", "structure_id", X.n, Y.n, ["value"], 1.5, "reflect")}, fd AS (SELECT structure_id || ':' || lv AS k, ix, iy, round(value / max(value) OVER (PARTITION BY structure_id), 9) / lv AS value FROM ev, (SELECT unnest([0.25::DOUBLE, 0.5, 0.75]) AS lv)),
      {_outline_sql("fd", "k", "CAST(1 AS DOUBLE)", X, Y)} SELECT CAST(split_part(k, ':', 1) AS INTEGER) AS structure_id, CAST(split_part(k, ':', 2) AS DOUBLE) AS level, count(*) AS n_rings, round(sum(area), 1) AS area FROM rg GROUP BY k""",
    "x12_isoline": f"""WITH RECURSIVE {_NODES}, ce AS (SELECT cell_id AS id, x, y, CASE WHEN cluster = '1-URGENT' THEN 1.0 ELSE 0.0 END::DOUBLE AS target FROM {_CELLS}),
      nr AS (SELECT 'urgent' AS key, ix, iy, target, {_D2} AS d2 FROM nd JOIN ce ON {_D2} <= {LIMIT * LIMIT} QUALIFY row_number() OVER (PARTITION BY ix, iy ORDER BY {_D2}, id) <= {K}),
      {_field_sql("nr", "key")}, {_outline_sql("fd", "key", "CAST(0.2 AS DOUBLE)", X, Y)}, tg AS (SELECT 'urgent' AS key, id, x, y FROM ce WHERE target = 1), {_inside_sql("tg", "key")}
      SELECT CAST(ring AS BIGINT) AS ring, round(area, 1) AS area, round(length, 1) AS length, n_targets FROM rg JOIN hd USING (key, ring) WHERE n_targets >= 10""",
    "x13_gene_isolines": f"""WITH RECURSIVE {_NODES}, gn(gene) AS (VALUES {", ".join(f"('{g}')" for g in GENES)}), ce AS (SELECT cell_id AS id, x, y, slice FROM {_CELLS}),
      al AS (SELECT gene, CAST(id AS VARCHAR) AS id, x, y, 0.0::DOUBLE AS target FROM gn, ce UNION ALL SELECT slice, CAST(id AS VARCHAR), x, y, 1.0 FROM ce WHERE slice IN (SELECT gene FROM gn)),
      nr AS (SELECT gene, ix, iy, target, {_D2} AS d2 FROM nd JOIN al ON {_D2} <= {LIMIT * LIMIT} QUALIFY row_number() OVER (PARTITION BY gene, ix, iy ORDER BY {_D2}, target DESC, id) <= {K}),
      {_field_sql("nr", "gene")}, {_outline_sql("fd", "gene", "CAST(0.33 AS DOUBLE)", X, Y)}, tg AS (SELECT slice AS gene, id, x, y FROM ce), {_inside_sql("tg", "gene")},
      kp AS (SELECT gene, count(*) AS n_rings, round(sum(area), 1) AS area, sum(n_targets) AS n_targets FROM rg JOIN hd USING (gene, ring) WHERE n_targets >= 10 GROUP BY gene)
      SELECT gene, CASE WHEN gene NOT IN (SELECT slice FROM ce) THEN 'no_molecules' WHEN n_rings IS NULL THEN 'no_contour' ELSE 'ok' END AS status, coalesce(n_rings, 0) AS n_rings, coalesce(area, 0) AS area, CAST(coalesce(n_targets, 0) AS BIGINT) AS n_targets FROM gn LEFT JOIN kp USING (gene)""",
}
