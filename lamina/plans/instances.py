"""Queries over instances within structures and their biology, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grid import Axis, histogram
from ..functions.quantiles import quantiles
from ..operators import alignment, biology, fields, instances, orientation, stacks, structure, tracks
from ..sources import tables
from ..sources.scratch import materialize
from ..sources.tables import SQL
from .structures import SPEC

X, Y = Axis(0.0, 5000.0, 100), Axis(0.0, 2500.0, 50)
SETTINGS = instances.Settings(density_sigma=25.0, density_threshold=0.6, closing=50.0, lumen_threshold=0.45, lumen_least_area=2500.0, least_area=25_000.0)


def _marked_cells(spark, sf):
    cells = structure.assign_structure(tables.cells(spark, sf), SPEC)
    return materialize(cells.select("cell_id", "slice", "x", "y", "structure_id", F.when(F.col("owner") % 16 == 0, 1).otherwise(0).alias("marker")))


def _masks(cells):
    """(slice, structure, ix, iy): the structure whose smoothed density, on the scale of its own upper quantile in the slice, is highest in a bin."""
    bins = histogram(cells.where("structure_id > 0"), X, Y, ["slice", "structure_id"])
    even = materialize(fields.smooth(bins, ["slice", "structure_id"], {"ix": X.n, "iy": Y.n}, 2.0, ["value"]))
    scale = quantiles(even, ["slice", "structure_id"], ["value"], [0.95]).select("slice", "structure_id", F.col("value")[0].alias("scale"))
    level = even.join(scale, ["slice", "structure_id"]).withColumn("level", F.round(F.col("value") / F.col("scale"), 9)).where("level >= 0.02")
    return materialize(level.groupBy("slice", "ix", "iy").agg(F.max_by("structure_id", F.struct("level", -F.col("structure_id"))).alias("structure")))


def x25_instances(spark, sf):
    cells = _marked_cells(spark, sf)
    rows, _ = instances.instances(cells, _masks(cells), X, Y, SETTINGS)
    plain = ["id", "slice", "structure", "number", "n_cells", "flags"]
    return rows.select(*plain, *[F.round(c, 6).alias(c) for c in ("area", "cx", "cy", "lumen_area", "lumen_cx", "lumen_cy", "ring_support", "marker_score", "contamination")])


def x26_instance_links(spark, sf):
    """Links of instances in neighbouring slices by their shapes, lumens and markers."""
    cells = _marked_cells(spark, sf)
    rows, bins = instances.instances(cells, _masks(cells), X, Y, SETTINGS)
    number = F.when(F.col("slice") == "F", 1).when(F.col("slice") == "O", 2).otherwise(3).alias("s")
    profile = F.array(F.col("markers").cast("double"), (F.col("n_cells") - F.col("markers")).cast("double")).alias("profile")
    own = materialize(rows.select("id", "slice", "structure", "instance", number, "cx", "cy", "area", "lumen_cx", "lumen_cy", profile))
    named = bins.join(own.select("id", "slice", "structure", "instance", "s"), ["slice", "structure", "instance"])
    found = tracks.instance_links(own, materialize(named.select("id", "structure", "s", "ix", "iy")), "s", "structure", 100.0, (0.0, 3.0))
    return found.select("source", "target", *[F.round(c, 6).alias(c) for c in found.columns[2:]])


SIGNATURES = {"growth": ("click", "view"), "transport": ("purchase",), "stress": ("error", "signup")}
PAIRS = [("click", "purchase"), ("view", "error"), ("signup", "click")]
BIN = 400.0


def _biology(spark, sf):
    """(tracks, instances, cells, molecules by cell): the middle halves of the cells of each slice and batch of owners are its instances, a batch's instances are one track."""
    cells = tables.cells(spark, sf)
    batch = F.col("owner") % 12
    keyed = materialize(cells.select("cell_id", "slice", "x", "y", "owner", batch.alias("track")))
    q = quantiles(keyed, ["slice", "track"], ["x", "y"], [0.3, 0.7])
    corner = lambda i, j: F.struct(F.col("x")[i].alias("x"), F.col("y")[j].alias("y"))
    z = F.when(F.col("slice") == "F", 0.0).when(F.col("slice") == "O", 10.0).otherwise(25.0)
    regions = q.select(F.concat_ws(":", "slice", "track").alias("region"), "track", "slice", z.alias("z"), F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"), F.lit(None).cast("double").alias("cx"), F.lit(None).cast("double").alias("cy"))
    regions = materialize(regions)
    by_owner = tables.transcripts(spark, sf).groupBy(F.col("cell").alias("owner"), "gene").agg(F.count("*").alias("n"))
    counts = materialize(keyed.select("cell_id", "owner").join(by_owner, "owner").select("cell_id", "gene", "n"))
    rows = materialize(biology.assigned(keyed, regions, BIN))
    return regions, keyed, counts, rows


def x29_assignments(spark, sf):
    regions, _, _, rows = _biology(spark, sf)
    return rows.groupBy("region", "track").agg(F.count("*").alias("n_cells"), F.round(F.avg("radial"), 5).alias("radial"), F.round(F.max("radial"), 5).alias("farthest"), F.round(F.avg("longitudinal"), 5).alias("longitudinal"))


def x29_entropy(spark, sf):
    _, _, counts, rows = _biology(spark, sf)
    e = biology.entropy(biology.cell_states(rows, counts, SIGNATURES))
    return e.select("track", "n_cells", "dominant_state", *[F.round(c, 5).alias(c) for c in ("state_entropy", "dominant_fraction", "radial_variance")])


def x29_axis(spark, sf):
    _, _, counts, rows = _biology(spark, sf)
    found = biology.axis_distortion(biology.cell_states(rows, counts, SIGNATURES), list(SIGNATURES), ("growth", "stress"))
    return found.select("track", "n_cells", *[F.round(c, 4).alias(c) for c in found.columns[2:]])


def x29_microenvironment(spark, sf):
    regions, cells, counts, rows = _biology(spark, sf)
    return biology.microenvironment(regions, rows, biology.ring_cells(cells, regions, 10.0, 30.0, BIN), counts, SIGNATURES)


def x29_communication(spark, sf):
    regions, cells, counts, rows = _biology(spark, sf)
    found = biology.communication(regions, rows, biology.ring_cells(cells, regions, 10.0, 30.0, BIN), counts, PAIRS)
    return found.select("track", "ligand", "receptor", "n_regions", F.round("mean_score", 6).alias("mean_score"), F.round("max_score", 6).alias("max_score"))


def x29_features(spark, sf):
    regions, _, counts, rows = _biology(spark, sf)
    area = (F.col("ring")[1]["x"] - F.col("ring")[0]["x"]) * (F.col("ring")[2]["y"] - F.col("ring")[1]["y"])
    tracks = regions.groupBy("track").agg(F.count("*").alias("n_slices"), F.median(area).alias("median_area")).withColumn("n_branches", F.col("track") % 3)
    found = biology.features(tracks, rows, counts, biology.cell_states(rows, counts, SIGNATURES), SIGNATURES)
    return found.select("track", "n_slices", "n_branches", "n_cells", "high_confidence", *[F.round(c, 5).alias(c) for c in (*[f"signature_{s}" for s in SIGNATURES], "state_entropy", "fission_score", "lumen_collapse")])


def _slice_pairs(spark, sf):
    """Regions' centres in each slice and in the one before it, by cluster."""
    s = tables.spots(spark, sf).groupBy("cluster", "region", "sample").agg(F.avg("x").alias("x"), (F.avg("y") * 20).alias("y"))
    before = s.select("cluster", "region", (F.col("sample") + 1).alias("sample"), F.col("x").alias("u"), F.col("y").alias("v"))
    return s.join(before, ["cluster", "region", "sample"])


def x51_stack(spark, sf):
    """Each slice's transform to the first frame of its stack, from the fits of neighbouring slices."""
    pairs = materialize(_slice_pairs(spark, sf))
    steps = materialize(alignment.procrustes(pairs, ["cluster", "sample"]))
    slices = tables.spots(spark, sf).select("cluster", "sample").distinct()
    whole = stacks.composed(stacks.identity_first(steps, slices, ["cluster"], "sample"), ["cluster"], "sample", 3)
    return whole.select("cluster", "sample", *[F.round(c, 4).alias(c) for c in ("rotation", "scale", "dx", "dy")])


def x38_two_best(spark, sf):
    """The two best orientations of each region's slices, and why the choice is in doubt."""
    t = tables.spots(spark, sf).groupBy("region", "sample").agg(F.avg("x").alias("cx"), F.avg("weight").alias("w"))
    nxt = t.select("region", (F.col("sample") - 1).alias("sample"), F.col("cx").alias("nx"), F.col("w").alias("nw"))
    near, flip = F.round(1 / (1 + F.abs(F.col("cx") - F.col("nx")) / 50), 6), F.round(10 * F.abs(F.col("w") - F.col("nw")), 6)
    e = t.join(nxt, ["region", "sample"]).select("region", "sample", near.alias("s00"), flip.alias("s01"), (flip / 2).alias("s10"), (near / 3).alias("s11"))
    best = orientation.two_best(e, ["region"], "sample")
    return best.select("region", "n_edges", "path", "second", *[F.round(c, 4).alias(c) for c in ("score", "second_score")], "reasons")


NAMES = "x51_stack x38_two_best x25_instances x26_instance_links x29_assignments x29_entropy x29_axis x29_microenvironment x29_communication x29_features".split()
QUERIES = {n: globals()[n] for n in NAMES}

_SUM = lambda s, t: f"coalesce(sum(n) FILTER (gene IN ({', '.join(repr(g) for g in SIGNATURES[s])})), 0) AS {t}{s}"
_BASE = f"""k AS (SELECT cell_id, slice, x, y, owner, owner % 12 AS track FROM {SQL["cells"]}),
  b AS (SELECT slice || ':' || track AS region, track, slice, CASE slice WHEN 'F' THEN 0.0 WHEN 'O' THEN 10.0 ELSE 25.0 END::DOUBLE AS z, quantile_cont(x, CAST(0.3 AS DOUBLE)) AS x0, quantile_cont(x, CAST(0.7 AS DOUBLE)) AS x1,
    quantile_cont(y, CAST(0.3 AS DOUBLE)) AS y0, quantile_cont(y, CAST(0.7 AS DOUBLE)) AS y1 FROM k GROUP BY slice, track),
  r AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM b),
  w AS (SELECT owner, gene, count(*) AS n FROM (SELECT cell AS owner, gene FROM {SQL["transcripts"]}) GROUP BY ALL), m AS (SELECT cell_id, gene, n FROM k JOIN w USING (owner)),
  h AS (SELECT cell_id, k.x, k.y, r.slice, z, region, r.track, least(1.0, sqrt(power(k.x - mx, 2) + power(k.y - my, 2)) / sqrt(power(x1 - mx, 2) + power(y1 - my, 2))) AS radial FROM k JOIN r ON k.slice = r.slice AND k.x >= x0 AND k.x < x1 AND k.y >= y0 AND k.y < y1
    QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY area, region) = 1),
  a AS (SELECT *, coalesce((z - min(z) OVER (PARTITION BY track)) / nullif(max(z) OVER (PARTITION BY track) - min(z) OVER (PARTITION BY track), 0), 0) AS longitudinal FROM h),
  g AS (SELECT cell_id, {", ".join(_SUM(s, "") for s in SIGNATURES)} FROM m GROUP BY cell_id), s AS (SELECT a.*, {", ".join(f"coalesce({s}, 0) AS {s}" for s in SIGNATURES)} FROM a LEFT JOIN g USING (cell_id)),
  t AS (SELECT *, CASE WHEN greatest({", ".join(SIGNATURES)}) <= 0 THEN 'unresolved' {" ".join(f"WHEN {s} = greatest({', '.join(SIGNATURES)}) THEN '{s}'" for s in SIGNATURES)} END AS state FROM s)"""
_ENTROPY = """n AS (SELECT track, state, count(*) AS n FROM t GROUP BY ALL), e AS (SELECT track, sum(n) AS total, max(n) AS most, 0 - sum(n / nn * log2(n / nn)) AS state_entropy FROM (SELECT *, sum(n) OVER (PARTITION BY track) AS nn FROM n) GROUP BY track)"""
_RING = """o AS (SELECT cell_id, region, r.track FROM (SELECT k.*, r.* EXCLUDE (slice, track), r.track AS rt, sqrt(power(greatest(x0 - k.x, k.x - x1, 0), 2) + power(greatest(y0 - k.y, k.y - y1, 0), 2)) AS d FROM k JOIN r ON k.slice = r.slice) q JOIN r USING (region)
    WHERE d > 10 AND d <= 30)"""


def _axis_sql() -> str:
    out = []
    for s in SIGNATURES:
        w = f"nullif(sum({s}), 0)"
        out += [f"sum({s} * radial) / {w} AS {s}_radial", f"sum({s} * longitudinal) / {w} AS {s}_along", f"CASE WHEN {w} IS NOT NULL THEN sqrt(greatest(sum({s} * longitudinal * longitudinal) / {w} - power(sum({s} * longitudinal) / {w}, 2), 0)) END AS {s}_spread", f"sum({s}) FILTER (longitudinal >= 0.75) / {w} AS {s}_apical"]
    names = [f"{s}_{p}" for s in SIGNATURES for p in ("radial", "along", "spread", "apical")]
    return f"""WITH {_BASE}, z AS (SELECT track, count(*) AS n_cells, {", ".join(out)} FROM t GROUP BY track)
      SELECT track, n_cells, {", ".join(f"round({n}, 4) AS {n}" for n in names)}, round(list_avg(list_filter([growth_spread, stress_spread, stress_apical], lambda v: v IS NOT NULL)), 4) AS distortion FROM z"""


_IN_OUT = "r2 AS (SELECT region, track FROM r)" + "".join(
    f", {name}_n AS (SELECT region, count(*) AS n_{name} FROM {table} GROUP BY region), {name}_g AS (SELECT region, gene, sum(n) AS n FROM (SELECT cell_id, region FROM {table}) JOIN m USING (cell_id) GROUP BY ALL), {name}_s AS (SELECT region, {', '.join(_SUM(s, name + '_') for s in SIGNATURES)} FROM {name}_g GROUP BY region)"
    for name, table in (("inside", "a"), ("ring", "o"))
)
ORACLE_SQL = {
    "x51_stack": f"""WITH RECURSIVE s AS (SELECT cluster, region, sample, avg(x) AS x, avg(y) * 20 AS y FROM {SQL["spots"]} GROUP BY ALL),
      p AS (SELECT a.cluster, a.sample, a.x, a.y, b.x AS u, b.y AS v FROM s a JOIN s b ON a.cluster = b.cluster AND a.region = b.region AND b.sample = a.sample - 1),
      m AS (SELECT *, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy, u - avg(u) OVER w AS du, v - avg(v) OVER w AS dv FROM p WINDOW w AS (PARTITION BY cluster, sample)),
      f AS (SELECT cluster, sample, sum(dx * du + dy * dv) / sum(dx * dx + dy * dy) AS a, sum(dx * dv - dy * du) / sum(dx * dx + dy * dy) AS b, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM m GROUP BY cluster, sample),
      t AS (SELECT cluster, sample, a, b, mu - a * mx + b * my AS tx, mv - b * mx - a * my AS ty FROM f),
      k AS (SELECT c.cluster, c.sample, coalesce(a, 1) AS a, coalesce(b, 0) AS b, coalesce(tx, 0) AS tx, coalesce(ty, 0) AS ty, row_number() OVER (PARTITION BY c.cluster ORDER BY c.sample) AS i FROM (SELECT DISTINCT cluster, sample FROM s) c LEFT JOIN t USING (cluster, sample)),
      r(cluster, sample, i, a, b, tx, ty) AS (SELECT cluster, sample, i, a, b, tx, ty FROM k WHERE i = 1 UNION ALL
        SELECT k.cluster, k.sample, k.i, r.a * k.a - r.b * k.b, r.a * k.b + r.b * k.a, r.a * k.tx - r.b * k.ty + r.tx, r.a * k.ty + r.b * k.tx + r.ty FROM r JOIN k ON k.cluster = r.cluster AND k.i = r.i + 1)
      SELECT cluster, sample, round(degrees(atan2(b, a)), 4) AS rotation, round(sqrt(a * a + b * b), 4) AS scale, round(tx, 4) AS dx, round(ty, 4) AS dy FROM r""",
    "x38_two_best": f"""WITH RECURSIVE t AS (SELECT region, sample, avg(x) AS cx, avg(weight) AS w FROM {SQL["spots"]} GROUP BY ALL),
      e AS (SELECT a.region, a.sample, round(1 / (1 + abs(a.cx - b.cx) / 50), 6) AS near, round(10 * abs(a.w - b.w), 6) AS flip, row_number() OVER (PARTITION BY a.region ORDER BY a.sample) AS i FROM t a JOIN t b ON a.region = b.region AND b.sample = a.sample + 1),
      c AS (SELECT region, count(*) AS n FROM e GROUP BY region), p(region, i, path, score) AS (SELECT region, 0, s, 0.0::DOUBLE FROM c, (SELECT unnest(['0', '1']) AS s) UNION ALL
        SELECT p.region, e.i, path || s, score + CASE path[-1] || s WHEN '00' THEN near WHEN '01' THEN flip WHEN '10' THEN flip / 2 ELSE near / 3 END FROM p JOIN e ON e.region = p.region AND e.i = p.i + 1, (SELECT unnest(['0', '1']) AS s)),
      o AS (SELECT p.region, n, path, score, row_number() OVER (PARTITION BY p.region ORDER BY score DESC, path) AS k FROM p JOIN c ON c.region = p.region AND c.n = p.i),
      b AS (SELECT region, n, max(path) FILTER (k = 1) AS path, max(path) FILTER (k = 2) AS second, max(score) FILTER (k = 1) AS score, max(score) FILTER (k = 2) AS ss FROM o GROUP BY region, n)
      SELECT region, n AS n_edges, path, second, round(score, 4) AS score, round(ss, 4) AS second_score, CASE WHEN (score - ss) / n < 0.05 THEN 'score_margin_below_threshold' ELSE '' END AS reasons FROM b""",
    "x29_assignments": f"WITH {_BASE} SELECT region, track, count(*) AS n_cells, round(avg(radial), 5) AS radial, round(max(radial), 5) AS farthest, round(avg(longitudinal), 5) AS longitudinal FROM a GROUP BY region, track",
    "x29_entropy": f"""WITH {_BASE}, {_ENTROPY}, v AS (SELECT track, coalesce(var_samp(radial), 0) AS rv FROM t GROUP BY track), d AS (SELECT track, state FROM n QUALIFY row_number() OVER (PARTITION BY track ORDER BY n DESC, state) = 1)
      SELECT track, CAST(total AS BIGINT) AS n_cells, state AS dominant_state, round(state_entropy, 5) AS state_entropy, round(most / total, 5) AS dominant_fraction, round(rv, 5) AS radial_variance FROM e JOIN v USING (track) JOIN d USING (track)""",
    "x29_axis": _axis_sql(),
    "x29_microenvironment": f"""WITH {_BASE}, {_RING}, {_IN_OUT} SELECT region, track, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}, " + ", ".join(f"CAST(coalesce({n}_{s}, 0) AS BIGINT) AS {n}_{s}" for s in SIGNATURES) for n in ("inside", "ring"))}
      FROM r2 LEFT JOIN inside_n USING (region) LEFT JOIN inside_s USING (region) LEFT JOIN ring_n USING (region) LEFT JOIN ring_s USING (region)""",
    "x29_communication": f"""WITH {_BASE}, {_RING}, {_IN_OUT}, p(ligand, receptor) AS (VALUES {", ".join(str(p) for p in PAIRS)}),
      c AS (SELECT r2.track, ligand, receptor, ln(1 + coalesce(i.n, 0) / greatest(coalesce(n_inside, 0), 1)) * ln(1 + coalesce(g.n, 0) / greatest(coalesce(n_ring, 0), 1)) * ln(1 + coalesce(n_ring, 0) / greatest(coalesce(n_inside, 0), 1)) AS score
        FROM r2 CROSS JOIN p LEFT JOIN inside_n USING (region) LEFT JOIN ring_n USING (region) LEFT JOIN inside_g i ON i.region = r2.region AND i.gene = receptor LEFT JOIN ring_g g ON g.region = r2.region AND g.gene = ligand)
      SELECT track, ligand, receptor, count(*) AS n_regions, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score FROM c GROUP BY ALL""",
    "x29_features": f"""WITH {_BASE}, {_ENTROPY}, q AS (SELECT track, count(*) AS n_slices, median(area) AS ma, track % 3 AS n_branches FROM r GROUP BY track), c AS (SELECT track, count(*) AS n_cells FROM a GROUP BY track),
      y AS (SELECT track, {", ".join(_SUM(s, "") for s in SIGNATURES)} FROM (SELECT cell_id, track FROM a) JOIN m USING (cell_id) GROUP BY track)
      SELECT track, n_slices, n_branches, coalesce(n_cells, 0) AS n_cells, n_slices >= 3 AND n_branches <= 0 AS high_confidence, {", ".join(f"round(coalesce(coalesce({s}, 0) / n_cells, 0), 5) AS signature_{s}" for s in SIGNATURES)},
      round(coalesce(state_entropy, 0), 5) AS state_entropy, round(n_branches / n_slices, 5) AS fission_score, round(1 / ln(1 + ma + 1), 5) AS lumen_collapse FROM q LEFT JOIN c USING (track) LEFT JOIN y USING (track) LEFT JOIN e USING (track)""",
}
