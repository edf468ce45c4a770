"""Queries over fields, tracks, patterns, latent spaces and streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grid import Axis
from ..operators import fields, latent, patterns, structure, tracks
from ..sources import tables
from ..sources.scratch import materialize
from ..sources.tables import SQL, read
from ..streaming.windows import run_sessions, run_windows
from .structures import _CELLS, _SPOTS, SPEC, SPEC_SQL, _bin

X, Y, SIGMA = Axis(0.0, 5000.0, 40), Axis(0.0, 3000.0, 30), 1.5
EX, EY = Axis(0.0, 1060.0, 24), Axis(0.0, 51.0, 16)


def x10_partition(spark, sf):
    cells = structure.assign_structure(tables.cells(spark, sf), SPEC)
    return fields.partition(cells, X, Y, SIGMA, 0.2).select(F.col("ix").cast("bigint").alias("ix"), F.col("iy").cast("bigint").alias("iy"), "structure_id")


def x31_enrichment(spark, sf):
    spots = tables.spots(spark, sf).select("x", "y", F.col("cluster").alias("gene"), F.col("weight").alias("value"))
    return fields.enrichment(spots, EX, EY, 1.0, 8.0).withColumns({"ix": F.col("ix").cast("bigint"), "iy": F.col("iy").cast("bigint")})


def x55_change(spark, sf):
    at = tables.spots(spark, sf).where(EX.inside("x") & EY.inside("y")).withColumns({"ix": EX.clipped("x").cast("bigint"), "iy": EY.clipped("y").cast("bigint")})
    image = lambda odd: at.where(F.col("sample") % 2 == odd).groupBy("ix", "iy").agg(F.avg("weight").alias("u"), F.count("*").cast("double").alias("v"))
    return fields.changed(image(1), image(0), ["u", "v"], 0.92)


def x54_otsu(spark, sf):
    return fields.otsu(tables.spots(spark, sf), "x", Axis(0.0, 1060.0, 64))


def _objects(spark, sf):
    s = tables.spots(spark, sf).withColumn("part", F.col("region") % 20)
    return tracks.boxes(s, ["cluster", "part", "sample"]).withColumn("id", F.concat_ws(":", "cluster", "part", "sample"))


def x26_links(spark, sf):
    return tracks.links(_objects(spark, sf), "sample", "id", "cluster", 30.0, 1.6)


def x26_tracks(spark, sf):
    return tracks.track(_objects(spark, sf), "sample", "id", "cluster", 30.0, 1.6).withColumn("mean_area", F.round("mean_area", 0))


def x27_track_table(spark, sf):
    o = materialize(_objects(spark, sf))
    t = tracks.track_table(o, tracks.links(o, "sample", "id", "cluster", 30.0, 1.6), "sample", "id")
    return t.select("track", "n_slices", "first_slice", F.round("min_iou", 5).alias("min_iou"), F.round("max_jump", 3).alias("max_jump"), F.round("area_cv", 5).alias("area_cv"), "n_branches", "n_weak", "quality", F.col("priority").cast("bigint").alias("priority"))


def x28_families(spark, sf):
    o = materialize(_objects(spark, sf))
    return tracks.families(o, tracks.links(o, "sample", "id", "cluster", 30.0, 1.6), "sample", "id", 0.93)


def x19_patterns(spark, sf):
    x, y = Axis(-1.0, 1.0, 20), Axis(-1.0, 1.0, 20)
    p = tables.points(spark, sf).where(x.inside("x") & y.inside("y"))
    window = p.select(x.clipped("x").alias("ix"), y.clipped("y").alias("iy"))
    window = window.withColumn("window", F.lit("all"))
    tests = p.select(F.col("cluster").alias("key")).distinct().select("key", F.lit("all").alias("window"), F.lit(None).cast("string").alias("pool"))
    found = patterns.pattern_tests(p.select(F.col("cluster").alias("key"), F.col("vec_id").alias("id"), "x", "y"), tests, window, x, y, [0.02, 0.04, 0.06, 0.08, 0.1])
    return found.select("key", "n_cells", "n_used", *[F.round(c, 6).alias(c) for c in ("di", "p_clustered", "p_regular", "ce", "p_ce")])


def x30_latent(spark, sf):
    t = tables.spots(spark, sf).groupBy("region").agg(F.avg("x").alias("a"), F.avg("y").alias("b"), F.avg("weight").alias("c"), F.stddev_pop("x").alias("d"))
    return latent.components_of(t, ["a", "b", "c", "d"]).select("region", *[F.round(f"pc{i}", 4).alias(f"pc{i}") for i in (1, 2, 3)])


def x7_label_groups(spark, sf):
    return latent.label_groups(structure.centroid_matrix(tables.points(spark, sf), "xyz"), 4)


def x37_band_signatures(spark, sf):
    """Share of each gene in the lower and upper third of its cell's depth."""
    t = tables.transcripts(spark, sf).where("k is not null")
    q = t.groupBy("cell").agg(F.percentile("k", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    band = F.when(F.col("k") <= F.col("q")[0], "low").when(F.col("k") >= F.col("q")[1], "high")
    n = t.join(q, "cell").withColumn("band", band).where("band is not null").groupBy("band", "gene").agg(F.count("*").alias("n"))
    return n.join(n.groupBy("band").agg(F.sum("n").alias("total")), "band").select("band", "gene", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def s_event_windows(spark, sf):
    return run_windows(spark, f"{sf}/events.parquet*")


def s_event_sessions(spark, sf):
    """Sessions of users with breaks of an hour or more between them."""
    return run_sessions(spark, f"{sf}/events.parquet*", "1 hour")


def a_rollup(spark, sf):
    return tables.cells(spark, sf).rollup("slice", "cluster").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("total"))


def u1_union(spark, sf):
    a = read(spark, sf, "customer").select(F.lit("c").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    b = read(spark, sf, "supplier").select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b).groupBy("kind", "nation").agg(F.count("*").alias("n"), F.max("balance").alias("top"))


NAMES = "x27_track_table x28_families x10_partition x31_enrichment x55_change x54_otsu x26_links x26_tracks x19_patterns x30_latent x7_label_groups x37_band_signatures s_event_windows s_event_sessions a_rollup u1_union".split()
QUERIES = {n: globals()[n] for n in NAMES}

_TX = SQL["transcripts"]


def _smooth(source: str, out: str, keys: str, nx: int, ny: int, values: list[str], sigma: float, mode: str) -> str:
    w = fields.kernel(sigma)
    r = len(w) // 2
    kern = f"{out}_w(k, w) AS (VALUES " + ", ".join(f"({i - r}, CAST({x!r} AS DOUBLE))" for i, x in enumerate(w)) + ")"

    def side(o: str, n: int) -> str:
        i = f"({o} + k)"
        return f"least(greatest({i}, 0), {n - 1})" if mode == "nearest" else f"CASE WHEN {i} < 0 THEN -{i} - 1 WHEN {i} >= {n} THEN {2 * n - 1} - {i} ELSE {i} END"

    sums = ", ".join(f"sum({v} * w) AS {v}" for v in values)
    return f"""{kern}, {out}_x AS (SELECT {keys}, o AS ix, iy, {sums} FROM {source} s JOIN (SELECT unnest(range({nx})) AS o) g ON true JOIN {out}_w ON s.ix = {side("o", nx)} GROUP BY {keys}, o, iy),
      {out} AS (SELECT {keys}, ix, o AS iy, {sums} FROM {out}_x s JOIN (SELECT unnest(range({ny})) AS o) g ON true JOIN {out}_w ON s.iy = {side("o", ny)} GROUP BY {keys}, ix, o)"""


_BOXES = f"""o AS (SELECT cluster || ':' || (region % 20) || ':' || sample AS id, cluster, sample, quantile_cont(x, 0.25) AS x0, quantile_cont(x, 0.75) AS x1, quantile_cont(y, 0.25) AS y0, quantile_cont(y, 0.75) AS y1
  FROM {_SPOTS} GROUP BY cluster, region % 20, sample), b AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM o WHERE (x1 - x0) * (y1 - y0) > 0),
m AS (SELECT a.id AS source, c.id AS target, greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0) AS i, a.area AS aa, c.area AS ca,
  sqrt((a.cx - c.cx) * (a.cx - c.cx) + (a.cy - c.cy) * (a.cy - c.cy)) AS d FROM b a JOIN b c ON a.cluster = c.cluster AND c.sample = a.sample + 1),
l AS (SELECT source, target, round(i / (aa + ca - i), 6) AS iou, round(0.5 * (i / (aa + ca - i)) + 0.3 * greatest(1 - d / 30, 0) + 0.2 / (greatest(aa, ca) / least(aa, ca)), 6) AS score FROM m
  WHERE (i / (aa + ca - i) >= 0.1 OR d <= 30) AND greatest(aa, ca) / least(aa, ca) <= 1.6)"""
_TRACKS = f"""{_BOXES}, o1 AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, target) = 1),
i1 AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, source) = 1), e AS (SELECT o1.source, o1.target, o1.iou, o1.score FROM o1 JOIN i1 USING (source, target)),
g AS (SELECT source AS u, target AS v FROM e UNION ALL SELECT target, source FROM e), r(u, v) AS (SELECT u, v FROM g UNION SELECT r.u, g.v FROM r JOIN g ON r.v = g.u),
t AS (SELECT b.*, coalesce(c, b.id) AS track FROM b LEFT JOIN (SELECT u, least(u, min(v)) AS c FROM r GROUP BY u) ON u = b.id),
rest AS (SELECT * FROM l WHERE (source, target) NOT IN (SELECT source, target FROM e))"""
_ROBUST = "(({v}) - median({v}) OVER ()) / greatest(quantile_cont({v}, 0.75) OVER () - quantile_cont({v}, 0.25) OVER (), 0.0001)"
ORACLE_SQL = {
    "x10_partition": f"""WITH h AS (SELECT s.sid AS structure_id, {_bin("x", 0.0, 5000.0, 40)} AS ix, {_bin("y", 0.0, 3000.0, 30)} AS iy, count(*) AS value FROM {_CELLS} c JOIN {SPEC_SQL} s(sid, cl) ON c.cluster = s.cl
      WHERE x BETWEEN 0 AND 5000 AND y BETWEEN 0 AND 3000 GROUP BY ALL), {_smooth("h", "f", "structure_id", 40, 30, ["value"], SIGMA, "reflect")},
      q AS (SELECT structure_id, quantile_cont(value, CAST(0.95 AS DOUBLE)) AS scale FROM f GROUP BY structure_id), l AS (SELECT f.*, round(value / scale, 9) AS level FROM f JOIN q USING (structure_id))
      SELECT ix, iy, structure_id FROM l WHERE level >= 0.2 QUALIFY row_number() OVER (PARTITION BY ix, iy ORDER BY level DESC, structure_id) = 1""",
    "x31_enrichment": f"""WITH h AS (SELECT cluster AS gene, {_bin("x", 0.0, 1060.0, 24)} AS ix, {_bin("y", 0.0, 51.0, 16)} AS iy, CAST(count(*) AS DOUBLE) AS n, sum(weight) AS v FROM {_SPOTS} WHERE x BETWEEN 0 AND 1060 AND y BETWEEN 0 AND 51 GROUP BY ALL),
      {_smooth("h", "f", "gene", 24, 16, ["n", "v"], 1.0, "nearest")}, e AS (SELECT f.gene, f.ix, f.iy, round(f.v / f.n, 9) AS enrichment FROM f JOIN h USING (gene, ix, iy) WHERE h.n >= 8),
      c AS (SELECT gene, quantile_cont(enrichment, CAST(0.75 AS DOUBLE)) AS cut FROM e GROUP BY gene) SELECT gene, ix, iy, round(enrichment, 6) AS enrichment FROM e JOIN c USING (gene) WHERE enrichment >= cut""",
    "x55_change": f"""WITH p AS (SELECT sample % 2 AS odd, {_bin("x", 0.0, 1060.0, 24)} AS ix, {_bin("y", 0.0, 51.0, 16)} AS iy, avg(weight) AS u, CAST(count(*) AS DOUBLE) AS v FROM {_SPOTS} WHERE x BETWEEN 0 AND 1060 AND y BETWEEN 0 AND 51 GROUP BY ALL),
      b AS (SELECT ix, iy, {_ROBUST.format(v="u")} AS u, {_ROBUST.format(v="v")} AS v FROM p WHERE odd = 1), a AS (SELECT ix, iy, {_ROBUST.format(v="u")} AS u, {_ROBUST.format(v="v")} AS v FROM p WHERE odd = 0),
      d AS (SELECT ix, iy, round((abs(a.u - b.u) + abs(a.v - b.v)) / 2, 9) AS change FROM a JOIN b USING (ix, iy)) SELECT ix, iy, round(change, 6) AS change FROM d WHERE change >= (SELECT quantile_cont(change, CAST(0.92 AS DOUBLE)) FROM d)""",
    "x54_otsu": f"""WITH h AS (SELECT {_bin("x", 0.0, 1060.0, 64)} AS b, count(*) AS n FROM {_SPOTS} WHERE x BETWEEN 0 AND 1060 GROUP BY ALL), m AS (SELECT b, n, (b + CAST(0.5 AS DOUBLE)) * {1060.0 / 64} AS mid FROM h),
      s AS (SELECT t.b AS t, sum(n) FILTER (m.b <= t.b) AS n0, sum(n) FILTER (m.b > t.b) AS n1, sum(n * mid) FILTER (m.b <= t.b) AS s0, sum(n * mid) FILTER (m.b > t.b) AS s1 FROM m, (SELECT b FROM h) t GROUP BY t.b)
      SELECT round(CAST((t + 1) * {1060.0 / 64} AS DOUBLE), 6) AS threshold FROM s WHERE n0 > 0 AND n1 > 0 ORDER BY round(CAST(n0 AS DOUBLE) * n1 * (s0 / n0 - s1 / n1) * (s0 / n0 - s1 / n1), 3) DESC, t LIMIT 1""",
    "x26_links": f"WITH {_BOXES} SELECT source, target, iou, score FROM l",
    "x26_tracks": f"""WITH RECURSIVE {_BOXES}, o1 AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, target) = 1),
      i1 AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, source) = 1), e AS (SELECT o1.source AS s, o1.target AS t FROM o1 JOIN i1 USING (source, target)),
      g AS (SELECT s AS u, t AS v FROM e UNION ALL SELECT t, s FROM e), r(u, v) AS (SELECT u, v FROM g UNION SELECT r.u, g.v FROM r JOIN g ON r.v = g.u), c AS (SELECT u, least(u, min(v)) AS c FROM r GROUP BY u)
      SELECT coalesce(c.c, b.id) AS track, count(DISTINCT sample) AS n_slices, min(sample) AS first_slice, max(sample) AS last_slice, round(round(avg(area), 2), 0) AS mean_area FROM b LEFT JOIN c ON c.u = b.id GROUP BY 1""",
    "x27_track_table": f"""WITH RECURSIVE {_TRACKS}, s AS (SELECT a.track, min(iou) AS mi, max(sqrt(power(a.cx - c.cx, 2) + power(a.cy - c.cy, 2))) AS mj, count(*) FILTER (score < 0.2) AS nw FROM e JOIN t a ON a.id = source JOIN t c ON c.id = target GROUP BY a.track),
      n AS (SELECT a.track, count(*) AS nb FROM rest JOIN t a ON a.id = source GROUP BY a.track), z AS (SELECT track, count(DISTINCT sample) AS ns, min(sample) AS fs, stddev_pop(area) / avg(area) AS cv FROM t GROUP BY track),
      q AS (SELECT *, CASE WHEN ns <= 1 THEN 'isolated' WHEN ns <= 2 OR coalesce(nw, 0) > 0 OR mi < 0.1 OR mj > 100 OR cv > 0.35 THEN 'review' ELSE 'good' END AS quality FROM z LEFT JOIN s USING (track) LEFT JOIN n USING (track))
      SELECT track, ns AS n_slices, fs AS first_slice, round(mi, 5) AS min_iou, round(mj, 3) AS max_jump, round(cv, 5) AS area_cv, coalesce(nb, 0) AS n_branches, coalesce(nw, 0) AS n_weak, quality,
      CAST(CASE quality WHEN 'review' THEN CASE WHEN mi < 0.05 THEN 1 ELSE 2 END WHEN 'isolated' THEN 3 ELSE CASE WHEN ns <= 3 THEN 4 ELSE 5 END END AS BIGINT) AS priority FROM q""",
    "x28_families": f"""WITH RECURSIVE {_TRACKS}, x AS (SELECT a.track AS a, c.track AS b, source, target FROM rest JOIN t a ON a.id = source JOIN t c ON c.id = target WHERE score >= 0.93 AND a.track <> c.track),
      y AS (SELECT a AS u, b AS v FROM x UNION SELECT b, a FROM x), f(u, v) AS (SELECT u, v FROM y UNION SELECT f.u, y.v FROM f JOIN y ON f.v = y.u), k AS (SELECT u AS track, least(u, min(v)) AS family FROM f GROUP BY u),
      w AS (SELECT t.*, coalesce(family, t.track) AS fam FROM t LEFT JOIN k USING (track)),
      mb AS (SELECT fam, track, CAST(split_part(track, ':', 2) AS INT) AS i, CAST(split_part(track, ':', 3) AS INT) AS j, split_part(track, ':', 1) AS c FROM w GROUP BY fam, track),
      d AS (SELECT fam AS family, count(*) AS n_members, string_agg(track, ';' ORDER BY c, i, j) AS members FROM mb GROUP BY fam), ns AS (SELECT fam AS family, count(DISTINCT sample) AS n_slices FROM w GROUP BY fam),
      ev AS (SELECT family, source, target FROM x JOIN k ON k.track = x.a), mo AS (SELECT family, max(n) AS mo FROM (SELECT family, source, count(*) AS n FROM ev GROUP BY ALL) GROUP BY family),
      mi AS (SELECT family, max(n) AS mi FROM (SELECT family, target, count(*) AS n FROM ev GROUP BY ALL) GROUP BY family), ne AS (SELECT family, count(*) AS n FROM ev GROUP BY family)
      SELECT family, n_members, members, n_slices, coalesce(n, 0) AS n_events, CASE WHEN n IS NULL THEN 'none' WHEN mo > 1 AND mi > 1 THEN 'complex' WHEN mo > 1 THEN 'candidate_split' WHEN mi > 1 THEN 'candidate_merge' ELSE 'candidate_branch' END AS event
      FROM d JOIN ns USING (family) LEFT JOIN ne USING (family) LEFT JOIN mo USING (family) LEFT JOIN mi USING (family)""",
    "x37_band_signatures": f"""WITH t AS (SELECT * FROM {_TX} WHERE k IS NOT NULL), q AS (SELECT cell, quantile_cont(CAST(k AS DOUBLE), {1 / 3!r}::DOUBLE) AS lo, quantile_cont(CAST(k AS DOUBLE), {2 / 3!r}::DOUBLE) AS hi FROM t GROUP BY cell),
      r AS (SELECT CASE WHEN k <= lo THEN 'low' WHEN k >= hi THEN 'high' END AS band, gene FROM t JOIN q USING (cell)), n AS (SELECT band, gene, count(*) AS n FROM r WHERE band IS NOT NULL GROUP BY band, gene)
      SELECT band, gene, round(n / sum(n) OVER (PARTITION BY band), 6) AS share FROM n""",
    "s_event_windows": "SELECT event_type AS gene, time_bucket(INTERVAL 1 hour, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "s_event_sessions": """WITH e AS (SELECT user_id AS cell, ts, value, ts - lag(ts) OVER w >= INTERVAL 1 hour OR lag(ts) OVER w IS NULL AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY cell ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM e)
      SELECT cell, min(ts) AS start, max(ts) + INTERVAL 1 hour AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY cell, no""",
    "a_rollup": f"SELECT slice, cluster, count(*) AS n, round(sum(x), 2) AS total FROM {_CELLS} GROUP BY ROLLUP (slice, cluster)",
    "u1_union": "SELECT kind, nation, count(*) AS n, max(balance) AS top FROM (SELECT 'c' AS kind, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 's', s_nationkey, s_acctbal FROM supplier) GROUP BY ALL",
}
