"""Queries over smaller relational steps of the analysis, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.grid import gaussian_mean, inverse_distance, k_nearest
from ..functions.ordered import aggregate
from ..operators import decisions as D
from ..operators import matching as M
from ..operators import profiles as P
from ..operators import regions, structure
from ..sources import tables
from ..sources.formats import molecules
from ..sources.scratch import materialize
from ..sources.tables import SQL, read
from .structures import _BOXES, _MATRIX

PALETTE = ["#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd"]


def j3_gene_counts(spark, sf):
    """Genes by gland: a cell lies in one gland and in the ring of another, so each count may go to two."""
    t = tables.transcripts(spark, sf)
    counts = t.groupBy("cell", "gene").agg(F.count("*").alias("n"))
    cells = t.select("cell").distinct()
    lookup = cells.select("cell", (F.col("cell") % 7).alias("gland"), F.lit("inside").alias("part")).unionByName(cells.select("cell", (F.col("cell") % 11).alias("gland"), F.lit("ring").alias("part")))
    return counts.join(lookup.dropDuplicates(["cell", "gland", "part"]), "cell").groupBy("gland", "part", "gene").agg(F.sum("n").alias("n"), F.count("*").alias("n_cells"))


def j4_multi_key(spark, sf):
    s = tables.spots(spark, sf)
    keys = ["region", "cluster", "sample", "weight"]  # the last a double; both sides hold the same values
    a = s.groupBy(*keys).agg(F.count("*").alias("n"))
    b = s.where("y > 25").groupBy(*keys).agg(F.count("*").alias("n_high"))
    return a.join(b, keys, "left").select(*keys, "n", F.coalesce("n_high", F.lit(0)).alias("n_high"))


def a12_mode(spark, sf):
    return M.mode(tables.spots(spark, sf).select("region", "cluster"), ["region"], "cluster")


def a18_members(spark, sf):
    p = read(spark, sf, "part").select("p_brand", F.concat(F.lit("c"), F.col("p_size").cast("string")).alias("label")).distinct()
    named = p.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct(C.natural_key("label").alias("o"), "label"))).alias("m"))
    return named.select("p_brand", F.array_join(F.transform("m", lambda x: x["label"]), ";").alias("members"))


def a27_normalised(spark, sf):
    t = tables.transcripts(spark, sf).groupBy("cell").agg(F.sum(F.when(F.col("gene") == "purchase", F.col("k"))).alias("e"), F.count_if(F.col("gene") == "click").alias("n"))
    return t.select("cell", F.round(C.ratio_or_zero("e", "n"), 6).alias("per_click"))


def a28_block_stats(spark, sf):
    """Distances between labels of one parity and the other's, in blocks."""
    m = structure.centroid_matrix(tables.points(spark, sf), "xyz").where("a <> b")
    block = F.when(F.col("a").cast("int") % 2 == F.col("b").cast("int") % 2, "same").otherwise("other")
    from ..operators.aggregates import summary

    return summary(m.withColumn("block", block), ["block"], "distance")


def a29_contingency(spark, sf):
    t = tables.cells(spark, sf)
    status = F.when(F.col("x") > 3000, "high").when(F.col("x") > 1000, "mid").otherwise("low")
    return t.groupBy("cluster").agg(*[F.count_if(status == s).alias(s) for s in ("low", "mid", "high")])


def w3_first_rows(spark, sf):
    s = tables.spots(spark, sf).groupBy("region", "cluster", "sample").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("w"))
    return M.first_of(s, ["region"], [-F.col("n"), -F.col("w"), F.col("cluster"), F.col("sample")])


def w6_fallback(spark, sf):
    s = tables.spots(spark, sf).groupBy("region", "sample").agg(F.round(F.avg("weight"), 6).alias("w"))
    return M.passing_or_nearest(s, ["region"], F.col("w") > 0.055, 2, [F.desc("w"), F.col("sample")])


def _objects(spark, sf):
    o = aggregate(tables.spots(spark, sf, place=True), ["cluster", "region"], F.min("sample").alias("first"), means={"mx": F.col("x"), "my": F.col("y")})
    return o.withColumns({c: C.rounded(c, 3) for c in ("mx", "my")})


def w11_ids(spark, sf):
    """Numbers by first slice and by structure first, which are two orders of the same objects."""
    one = M.global_rank(_objects(spark, sf), [F.col("first"), F.col("cluster"), F.col("mx"), F.col("my"), F.col("region")], "i")
    two = M.global_rank(one, [F.col("cluster"), F.col("first"), F.col("mx"), F.col("my"), F.col("region")], "j")
    return two.select("cluster", "region", F.format_string("gland_%04d", "i").alias("track_id"), F.format_string("gland_%04d", "j").alias("atlas_id"))


def o1_mixed_order(spark, sf):
    s = tables.spots(spark, sf).groupBy("cluster", "region").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 3).alias("w"))
    return M.global_rank(s, [F.desc("n"), F.col("cluster"), F.desc("w"), F.col("region")], "place")


def o5_chosen(spark, sf):
    """Half of the places to steady objects, what follows to branching ones, the rest in order of id (a top list)."""
    s = tables.spots(spark, sf).groupBy("region").agg(F.countDistinct("sample").alias("slices"), F.count_if(F.col("weight") > 0.09).alias("branches"))
    steady = M.top_k(s.where("slices >= 3 and branches <= 40").withColumn("g", F.lit(1)), ["g"], [F.desc("slices"), F.col("region")], 10)
    branching = s.where("branches > 40")
    order = lambda t, c: t.withColumn("o", c)
    return M.chosen_first([order(steady, F.col("rank").cast("double")), order(branching, -F.col("branches").cast("double")), order(s, F.col("region").cast("double"))], "region", "o", 20)


def u4_common(spark, sf):
    s = tables.cells(spark, sf)
    names = [s.where(F.col("slice") == x).where("x > 2000").select("cluster") for x in ("F", "O", "P")]
    return names[0].intersect(names[1]).intersect(names[2])


def f5_similarities(spark, sf):
    t = tables.spots(spark, sf).groupBy("region").agg(F.avg("x").alias("x"), F.avg("weight").alias("w"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    n = t.select((F.col("region") - 1).alias("region"), *[F.col(c).alias(f"{c}2") for c in ("x", "w", "sx", "sy")])
    j = t.join(n, "region")
    return j.select(
        "region", F.round(P.position_similarity(F.abs(F.col("x") - F.col("x2")), 200.0), 6).alias("position"), F.round(P.area_similarity(F.col("sx") / F.col("sx2"), 1.5), 6).alias("area"),
        F.round(P.shape_similarity(F.col("w"), F.col("w2"), F.col("sx") / F.col("sy"), F.col("sx2") / F.col("sy2")), 6).alias("shape"), F.round(D.wide_area_similarity(F.col("sx") / F.col("sy") / 30), 6).alias("wide"),
    )


def f10_colours(spark, sf):
    n = tables.cells(spark, sf).select("cluster").distinct().withColumn("i", F.substring("cluster", 1, 1).cast("int") + 3)
    c = n.withColumn("colour", P.palette_colour(F.col("i"), PALETTE)).withColumn("c", P.rgb(F.col("colour")))
    return c.select("cluster", "colour", "c.r", "c.g", "c.b")


def d8_flags(spark, sf):
    t = aggregate(tables.spots(spark, sf, place=True), ["region"], F.count_if(F.col("weight") > 0.098).alias("seeds"), F.countDistinct("cluster").alias("lumens"), F.count("*").alias("area"), means={"ring": F.col("weight")})
    return t.select("region", D.instance_flags(F.when(F.col("seeds") > 50, 0).otherwise(F.col("seeds")), F.col("ring"), F.col("lumens") - 3, F.col("area"), 0.05, 590).alias("flags"))


def d10_events(spark, sf):
    """Split, merge or both at the ends of candidate links, and the review priority of their families."""
    p = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    out, into = p.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("o")), p.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("i"))
    n = out.join(into, "node", "full").select("node", F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("i", F.lit(0)).alias("i"))
    split, merge = F.col("o") > 30, F.col("i") > 590
    kind = F.when(split & merge, "complex").when(split, "candidate_split").when(merge, "candidate_merge").otherwise("candidate_branch")
    motif = F.when(F.col("o") > 31, "complex").when(split, "candidate_split").otherwise("linear")
    return n.groupBy(kind.alias("event"), D.family_priority(motif, F.col("i") % 5, F.col("o") / 32).alias("priority")).agg(F.count("*").alias("n"))


def d12_classes(spark, sf):
    s = aggregate(tables.spots(spark, sf, place=True), ["region"], (F.count("*") % 2 == 0).alias("mutual"), means={"weight": F.col("weight")})
    return s.groupBy(D.correspondence_class(F.col("weight") * 14, F.col("mutual")).alias("class")).agg(F.count("*").alias("n"))


def d14_guard(spark, sf):
    t = aggregate(
        tables.spots(spark, sf, place=True), ["region"], F.countDistinct("y").alias("n"), F.stddev_pop("weight").alias("coverage"), F.countDistinct("cluster").alias("quadrants"),
        means={"residual": F.col("x"), "weight": F.col("weight")},
    )
    rule = D.seed_guard(F.col("region") % 9 > 0, F.col("residual") - 470, F.col("n") - 40, (F.col("weight") - 0.05) * 8000, F.col("coverage") * 1.6, F.col("quadrants") - 3, 125.0, 4)
    return t.select("region", rule.alias("rule"))


def d16_families(spark, sf):
    p = read(spark, sf, "part")
    name = F.concat(F.when(F.col("p_size") % 3 == 0, "T Cell ").when(F.col("p_size") % 5 == 0, "Fibro ").when(F.col("p_size") % 7 == 0, "Tumor ").otherwise("x "), F.col("p_brand"))
    return p.groupBy(D.label_family(name, P.FAMILIES).alias("family")).agg(F.count("*").alias("n"))


def d18_mesh(spark, sf):
    n = tables.spots(spark, sf).groupBy("cluster").agg(F.count("*").alias("n"))
    return n.select("cluster", D.mesh_size(F.col("n")).cast("bigint").alias("mesh"))


def d19_scores(spark, sf):
    t = tables.spots(spark, sf).groupBy("region").agg(F.countDistinct("sample").alias("slices"), F.count_if(F.col("weight") > 0.095).alias("branches"), F.stddev_pop("x").alias("area"))
    return t.select(
        "region", ((F.col("slices") >= 3) & (F.col("branches") <= 60)).alias("high_confidence"), F.round(F.col("branches") / F.greatest("slices", F.lit(1)), 6).alias("fission"),
        F.round(D.lumen_collapse(F.col("area")), 6).alias("collapse"),
    )


def d21_signatures(spark, sf):
    """Expression by state of the named signatures; genes of the events stand for the first five genes of all signatures in order."""
    from ..operators.aggregates import signature_states

    genes = [g for genes in P.SIGNATURES.values() for g in genes[:1]][:5]
    names = F.create_map(*[F.lit(x) for pair in zip(["click", "error", "purchase", "signup", "view"], genes, strict=True) for x in pair])
    t = tables.transcripts(spark, sf).groupBy("cell", names[F.col("gene")].alias("gene")).agg(F.count("*").alias("n"))
    return signature_states(t, "cell", "gene", "n", [(k, list(v)) for k, v in P.SIGNATURES.items()]).groupBy("state").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


def p11_flip(spark, sf):
    """Local heights turned over in odd slices and put about the slice's own height."""
    p = tables.points(spark, sf).withColumn("slice", F.col("cluster").cast("int"))
    s = p.groupBy("slice").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    z = F.when(F.col("slice") % 2 == 1, F.col("lo") + F.col("hi") - F.col("z")).otherwise(F.col("z")) - (F.col("lo") + F.col("hi")) / 2 + 10.0 * F.col("slice")
    return p.join(s, "slice").select("vec_id", F.round(z, 6).alias("z"))


def j7_knn_field(spark, sf):
    """A field at each point from its thirty nearest other points."""
    p = tables.points(spark, sf).select("vec_id", "x", "y", "z")
    near = k_nearest(p.select("vec_id", "x", "y"), p.select("vec_id", "x", "y"), "vec_id", "vec_id", 31, 0.1, 5.0).where("vec_id <> near_vec_id")
    # Where a point has thirty-one twins or more of smaller ids it isn't among its own nearest, and one is too many.
    near = near.withColumn("place", F.row_number().over(W.partitionBy("vec_id").orderBy("d2", "near_vec_id"))).where("place <= 30")
    with_z = near.join(p.select(F.col("vec_id").alias("near_vec_id"), "z"), "near_vec_id")
    return inverse_distance(with_z, "vec_id", "z").select("vec_id", F.round("z", 5).alias("z"))


def j10_gaussian_field(spark, sf):
    p = tables.points(spark, sf).select("vec_id", "x", "y", "z")
    near = k_nearest(p.select("vec_id", "x", "y"), p.select("vec_id", "x", "y"), "vec_id", "vec_id", 8, 0.05, 0.2)
    with_z = near.join(p.select(F.col("vec_id").alias("near_vec_id"), "z"), "near_vec_id")
    return gaussian_mean(with_z, "vec_id", ["z"], 0.1).select("vec_id", F.round("z", 5).alias("z"))


def j11_context(spark, sf):
    """Each region's four nearest other regions by centroid."""
    c = materialize(tables.spots(spark, sf).groupBy("region").agg(F.avg("x").alias("x"), (F.avg("y") * 20).alias("y")))
    near = k_nearest(c, c, "region", "region", 5, 10.0, 2000.0).where("region <> near_region")
    place = F.row_number().over(W.partitionBy("region").orderBy("d2", "near_region"))  # five rows a region
    return near.withColumn("place", place.cast("bigint")).where("place <= 4").select("region", "near_region", "place", F.round(F.sqrt("d2"), 5).alias("distance"))


def f5_surroundings(spark, sf):
    """How alike the surroundings of regions with neighbouring numbers are."""
    c = materialize(tables.spots(spark, sf).groupBy("region").agg(F.avg("x").alias("x"), (F.avg("y") * 20).alias("y"), F.count("*").alias("n")))
    near = k_nearest(c.select("region", "x", "y"), c.select("region", "x", "y"), "region", "region", 6, 10.0, 2000.0).where("region <> near_region")
    o = c.select(F.col("region").alias("near_region"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("n").alias("nn"))
    rows = near.join(o, "near_region").join(c, "region").select("region", (F.col("nx") - F.col("x")).alias("dx"), (F.col("ny") - F.col("y")).alias("dy"), (F.col("nn") / F.col("n")).alias("ratio"))
    s = P.surroundings(rows, "region")
    t = s.select((F.col("region") - 1).alias("region"), F.col("around").alias("other"))
    return s.join(t, "region").select("region", F.round(P.surroundings_similarity(F.col("around"), F.col("other")), 6).alias("similarity"))


def z13_turning(spark, sf):
    boxes = regions.quantile_boxes(tables.cells(spark, sf), "cluster", 0.0)
    e = boxes.select("region", F.posexplode(regions.edges(F.col("ring"))).alias("i", "e"))
    p = e.select("region", "i", F.col("e.a.x").alias("px"), F.col("e.a.y").alias("py"))
    return P.turning_angles(p, "region", "i").groupBy("region").agg(F.round(F.sum("turn"), 3).alias("total"), F.round(F.max("turn"), 3).alias("sharpest"))


def z38_spacing(spark, sf):
    return P.z_spacing(tables.spots(spark, sf).select((F.col("sample") * F.col("sample")).cast("double").alias("z")), "z")


def z19_compatible(spark, sf):
    """Pairs of regions with one structure, or where a side has none."""
    s = tables.spots(spark, sf).groupBy("region").agg(F.when(F.count("*") % 3 > 0, F.min("cluster")).alias("s"))
    n = s.groupBy("s").agg(F.count("*").alias("n"))
    a, b = n.select(F.col("s").alias("a"), F.col("n").alias("na")), n.select(F.col("s").alias("b"), F.col("n").alias("nb"))
    return a.join(b, (F.col("a") == F.col("b")) | F.col("a").isNull() | F.col("b").isNull()).select(F.coalesce("a", F.lit("none")).alias("a"), F.coalesce("b", F.lit("none")).alias("b"), (F.col("na") * F.col("nb")).alias("n"))


def z20_edge_score(spark, sf):
    """Weighted mean of similarities by slice step."""
    t = tables.spots(spark, sf).groupBy("region", "sample").agg(F.avg("weight").alias("v"), F.count("*").alias("n"))
    o = t.select("region", (F.col("sample") - 1).alias("sample"), F.col("v").alias("v2"), F.col("n").alias("n2"))
    w, c = F.least("n", "n2"), 1 - F.abs(F.col("v") - F.col("v2"))
    return t.join(o, ["region", "sample"]).groupBy("sample").agg(F.round(F.sum(w * c) / F.sum(w), 6).alias("score"), F.sum(w).alias("weight"))


def z35_edges(spark, sf):
    """Links with the lower slice first, and whether they cross objects."""
    t = tables.spots(spark, sf).groupBy("region").agg(F.min("sample").alias("s"), F.count("*").alias("n"))
    p = t.select("region", "n", (F.pmod(F.col("region") * 7 + F.col("n"), F.lit(97))).alias("other"))
    j = p.join(t.select(F.col("region").alias("other"), F.col("n").alias("m")), "other")
    swap = F.col("n") > F.col("m")
    return j.select(F.when(swap, F.col("other")).otherwise(F.col("region")).alias("source"), F.when(swap, F.col("region")).otherwise(F.col("other")).alias("target"), (F.col("region") != F.col("other")).alias("crosses"))


def z37_genes(spark, sf):
    return tables.transcripts(spark, sf).select("gene").where("gene is not null").distinct()


def p4_molecules(spark, sf):
    """Molecules of some genes at or over a quality; both conditions reach the scan."""
    t = tables.transcripts(spark, sf).select(F.col("cell").cast("string").alias("id"), "gene", F.col("qv").alias("quality"))
    return molecules(t, ["click", "view"], 20.0).groupBy("id", "gene").agg(F.count("*").alias("n"), F.round(F.max("quality"), 4).alias("best"))


def p2_labels(spark, sf):
    """Labels that stand for no cluster are left out, whatever their case."""
    name = F.when(F.col("p_size") % 5 == 0, " Unassigned").when(F.col("p_size") % 7 == 0, "NaN ").when(F.col("p_size") % 11 == 0, " ").otherwise(F.col("p_brand"))
    return read(spark, sf, "part").withColumn("label", name).where(C.is_cluster("label")).groupBy("label").agg(F.count("*").alias("n"))


def p5_finite(spark, sf):
    """Coordinates in micrometres of points that have any; division by zero stands for what a table lacks."""
    p = tables.points(spark, sf)
    odd = F.col("vec_id") % 10
    x = F.when(odd == 0, F.lit(float("nan"))).when(odd == 1, F.lit(float("inf"))).when(odd == 2, F.lit(None).cast("double")).otherwise(F.col("x") * 0.2125)
    return p.withColumn("x", x).where(C.finite("x")).groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.sum("x"), 5).alias("total"))


def z15_truthy(spark, sf):
    text = F.element_at(F.array(*[F.lit(v) for v in ("TRUE", " yes", "0", "1", "no", "y", "")]), (F.col("p_size") % 7 + 1).cast("int"))
    return read(spark, sf, "part").groupBy("p_brand").agg(F.count_if(C.truthy(text)).alias("n_true"), F.count("*").alias("n"))


NAMES = (
    "p4_molecules p2_labels p5_finite z15_truthy j3_gene_counts j4_multi_key a12_mode a18_members a27_normalised a28_block_stats a29_contingency w3_first_rows w6_fallback w11_ids o1_mixed_order o5_chosen u4_common f5_similarities f10_colours d8_flags d10_events "
    "d12_classes d14_guard d16_families d18_mesh d19_scores d21_signatures p11_flip j7_knn_field j10_gaussian_field j11_context f5_surroundings z13_turning z38_spacing z19_compatible z20_edge_score z35_edges z37_genes"
).split()
QUERIES = {n: globals()[n] for n in NAMES}

_CELLS, _SPOTS, _TX, _POINTS = SQL["cells"], SQL["spots"], SQL["transcripts"], SQL["points"]
_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"
_FIRST = f"SELECT cluster, region, min(sample) AS first, round(avg(x), 3) AS mx, round(avg(y), 3) AS my FROM {_SPOTS} GROUP BY cluster, region"
_STATES = ["LGR5", "MKI67", "MUC2", "BEST4", "CHGA"]
ORACLE_SQL = {
    "p4_molecules": f"SELECT CAST(cell AS VARCHAR) AS id, gene, count(*) AS n, round(max(qv), 4) AS best FROM {_TX} WHERE gene IN ('click', 'view') AND qv >= 20 GROUP BY ALL",
    "p2_labels": "SELECT p_brand AS label, count(*) AS n FROM part WHERE p_size % 5 <> 0 AND p_size % 7 <> 0 AND p_size % 11 <> 0 GROUP BY p_brand",
    "p5_finite": f"SELECT cluster, count(*) AS n, round(sum(x * CAST(0.2125 AS DOUBLE)), 5) AS total FROM {_POINTS} WHERE vec_id % 10 > 2 AND x IS NOT NULL GROUP BY cluster",
    "z15_truthy": "SELECT p_brand, count(*) FILTER (p_size % 7 IN (0, 1, 3, 5)) AS n_true, count(*) AS n FROM part GROUP BY p_brand",
    "j3_gene_counts": f"""WITH n AS (SELECT cell, gene, count(*) AS n FROM {_TX} GROUP BY ALL), l AS (SELECT DISTINCT cell, cell % 7 AS gland, 'inside' AS part FROM n UNION ALL SELECT DISTINCT cell, cell % 11, 'ring' FROM n)
      SELECT gland, part, gene, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_cells FROM n JOIN l USING (cell) GROUP BY gland, part, gene""",
    "j4_multi_key": f"SELECT region, cluster, sample, weight, count(*) AS n, count(*) FILTER (y > 25) AS n_high FROM {_SPOTS} GROUP BY ALL",
    "a12_mode": f"WITH n AS (SELECT region, cluster, count(*) AS n FROM {_SPOTS} GROUP BY ALL) SELECT region, cluster, n FROM n QUALIFY row_number() OVER (PARTITION BY region ORDER BY n DESC, cluster) = 1",
    "a18_members": "SELECT p_brand, string_agg('c' || p_size, ';' ORDER BY p_size) AS members FROM (SELECT DISTINCT p_brand, p_size FROM part) GROUP BY p_brand",
    "a27_normalised": f"SELECT cell, round(coalesce(sum(k) FILTER (gene = 'purchase') / nullif(count(*) FILTER (gene = 'click'), 0), 0), 6) AS per_click FROM {_TX} GROUP BY cell",
    "a28_block_stats": f"""WITH {_MATRIX}, b AS (SELECT CASE WHEN CAST(a AS INT) % 2 = CAST(b AS INT) % 2 THEN 'same' ELSE 'other' END AS block, distance AS d FROM m WHERE a <> b)
      SELECT block, count(*) AS n, round(min(d), 6) AS min, round(quantile_cont(d, CAST(0.05 AS DOUBLE)), 6) AS p05, round(median(d), 6) AS median, round(quantile_cont(d, CAST(0.9 AS DOUBLE)), 6) AS p90,
      round(quantile_cont(d, CAST(0.95 AS DOUBLE)), 6) AS p95, round(avg(d), 6) AS mean, round(max(d), 6) AS max FROM b GROUP BY block""",
    "a29_contingency": f"SELECT cluster, count(*) FILTER (x <= 1000) AS low, count(*) FILTER (x > 1000 AND x <= 3000) AS mid, count(*) FILTER (x > 3000) AS high FROM {_CELLS} GROUP BY cluster",
    "w3_first_rows": f"""WITH s AS (SELECT region, cluster, sample, count(*) AS n, round(sum(weight), 4) AS w FROM {_SPOTS} GROUP BY ALL)
      SELECT region, cluster, sample, n, w FROM s QUALIFY row_number() OVER (PARTITION BY region ORDER BY n DESC, w DESC, cluster, sample) = 1""",
    "w6_fallback": f"""WITH s AS (SELECT region, sample, round(avg(weight), 6) AS w FROM {_SPOTS} GROUP BY ALL), f AS (SELECT *, count(*) FILTER (w > 0.055) OVER (PARTITION BY region) >= 2 AS enough, row_number() OVER (PARTITION BY region ORDER BY w DESC, sample) AS k FROM s)
      SELECT region, sample, w FROM f WHERE CASE WHEN enough THEN w > 0.055 ELSE k <= 2 END""",
    "w11_ids": f"""WITH o AS ({_FIRST}) SELECT cluster, region, format('gland_{{:04d}}', row_number() OVER (ORDER BY first, cluster, mx, my, region)) AS track_id,
      format('gland_{{:04d}}', row_number() OVER (ORDER BY cluster, first, mx, my, region)) AS atlas_id FROM o""",
    "o1_mixed_order": f"""WITH s AS (SELECT cluster, region, count(*) AS n, round(sum(weight), 3) AS w FROM {_SPOTS} GROUP BY ALL) SELECT cluster, region, n, w, row_number() OVER (ORDER BY n DESC, cluster, w DESC, region) AS place FROM s""",
    "o5_chosen": f"""WITH s AS (SELECT region, count(DISTINCT sample) AS slices, count(*) FILTER (weight > 0.09) AS branches FROM {_SPOTS} GROUP BY region),
      p AS (SELECT 0 AS part, region, CAST(k AS DOUBLE) AS o FROM (SELECT region, row_number() OVER (ORDER BY slices DESC, region) AS k FROM s WHERE slices >= 3 AND branches <= 40) WHERE k <= 10
        UNION ALL SELECT 1, region, -CAST(branches AS DOUBLE) FROM s WHERE branches > 40 UNION ALL SELECT 2, region, CAST(region AS DOUBLE) FROM s),
      f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY region ORDER BY part, o) = 1) SELECT region, part FROM f ORDER BY f.part, o, region LIMIT 20""",
    "u4_common": f"""SELECT cluster FROM {_CELLS} WHERE slice = 'F' AND x > 2000 INTERSECT SELECT cluster FROM {_CELLS} WHERE slice = 'O' AND x > 2000 INTERSECT SELECT cluster FROM {_CELLS} WHERE slice = 'P' AND x > 2000""",
    "f5_similarities": f"""WITH t AS (SELECT region, avg(x) AS x, avg(weight) AS w, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM {_SPOTS} GROUP BY region)
      SELECT a.region, round(exp(-abs(a.x - b.x) / 50), 6) AS position, round(greatest(0, least(1, 1 - abs(ln(a.sx / b.sx)) / ln(1.5))), 6) AS area,
      round(0.6 * exp(-abs(a.w - b.w) / 0.25) + 0.4 * exp(-abs(ln((a.sx / a.sy) / (b.sx / b.sy)))), 6) AS shape,
      round(CASE WHEN a.sx / a.sy / 30 BETWEEN 0.1 AND 10 THEN 1 - abs(ln(a.sx / a.sy / 30)) / ln(10) ELSE 0 END, 6) AS wide FROM t a JOIN t b ON b.region = a.region + 1""",
    "f10_colours": f"""WITH n AS (SELECT DISTINCT cluster, CAST(substr(cluster, 1, 1) AS INT) + 3 AS i FROM {_CELLS}), c AS (SELECT cluster, ['#1f77b4', '#ff7f0e', '#2ca02c', '#d62728', '#9467bd'][(i - 1) % 5 + 1] AS colour FROM n)
      SELECT cluster, colour, CAST('0x' || substr(colour, 2, 2) AS INT) AS r, CAST('0x' || substr(colour, 4, 2) AS INT) AS g, CAST('0x' || substr(colour, 6, 2) AS INT) AS b FROM c""",
    "d8_flags": f"""WITH t AS (SELECT region, count(*) FILTER (weight > 0.098) AS s, avg(weight) AS r, count(DISTINCT cluster) AS l, count(*) AS n FROM {_SPOTS} GROUP BY region)
      SELECT region, concat_ws(';', CASE WHEN s > 50 OR s = 0 THEN 'no_lumen_seed' END, CASE WHEN r < 0.05 THEN 'weak_ring' END, CASE WHEN l - 3 > 1 THEN 'merged_candidate' END, CASE WHEN n < 590 THEN 'small_fragment' END) AS flags FROM t""",
    "d10_events": """WITH p AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem), o AS (SELECT a AS node, count(*) AS o FROM p GROUP BY a), i AS (SELECT b AS node, count(*) AS i FROM p GROUP BY b),
      n AS (SELECT node, coalesce(o, 0) AS o, coalesce(i, 0) AS i FROM o FULL JOIN i USING (node)), m AS (SELECT *, CASE WHEN o > 31 THEN 'complex' WHEN o > 30 THEN 'candidate_split' ELSE 'linear' END AS motif FROM n)
      SELECT CASE WHEN o > 30 AND i > 590 THEN 'complex' WHEN o > 30 THEN 'candidate_split' WHEN i > 590 THEN 'candidate_merge' ELSE 'candidate_branch' END AS event,
      CASE WHEN motif <> 'linear' AND (motif = 'complex' OR o / 32 >= 0.75) THEN 'high' WHEN motif <> 'linear' THEN 'medium' WHEN i % 5 < 3 THEN 'isolated/review' ELSE 'low' END AS priority, count(*) AS n FROM m GROUP BY 1, 2""",
    "d12_classes": f"""WITH s AS (SELECT avg(weight) * 14 AS score, count(*) % 2 = 0 AS mutual FROM {_SPOTS} GROUP BY region)
      SELECT CASE WHEN score >= 0.72 AND mutual THEN 'matched_anchor' WHEN score >= 0.55 AND mutual THEN 'matched_review' ELSE 'rejected' END AS class, count(*) AS n FROM s GROUP BY 1""",
    "d14_guard": f"""WITH t AS (SELECT region, avg(x) - 470 AS r, count(DISTINCT y) - 40 AS n, (avg(weight) - 0.05) * 8000 AS o, stddev_pop(weight) * 1.6 AS c, count(DISTINCT cluster) - 3 AS q FROM {_SPOTS} GROUP BY region)
      SELECT region, CASE WHEN region % 9 = 0 THEN 'not_accepted' WHEN r > 125 THEN 'residual_high' WHEN n < 4 THEN 'too_few_anchors' WHEN n < 6 THEN 'too_few_for_similarity' WHEN abs(o) >= 150 THEN 'rotation_flip'
      WHEN abs(o) > 15 AND n < 8 THEN 'rotated_few_anchors' WHEN abs(o) > 15 AND r > 120 THEN 'rotated_residual' WHEN abs(o) > 15 AND c < 0.05 THEN 'rotated_coverage' WHEN abs(o) > 15 AND q < 2 THEN 'rotated_quadrants' ELSE 'ok' END AS rule FROM t""",
    "d16_families": "SELECT CASE WHEN p_size % 3 = 0 THEN 'immune' WHEN p_size % 5 = 0 THEN 'stromal' WHEN p_size % 7 = 0 THEN 'tumor' ELSE 'other' END AS family, count(*) AS n FROM part GROUP BY 1",
    "d18_mesh": f"SELECT cluster, CAST(CASE WHEN count(*) >= 80000 THEN 450 WHEN count(*) >= 40000 THEN 550 WHEN count(*) >= 20000 THEN 650 WHEN count(*) >= 10000 THEN 800 ELSE 1200 END AS BIGINT) AS mesh FROM {_SPOTS} GROUP BY cluster",
    "d19_scores": f"""WITH t AS (SELECT region, count(DISTINCT sample) AS s, count(*) FILTER (weight > 0.095) AS b, stddev_pop(x) AS a FROM {_SPOTS} GROUP BY region)
      SELECT region, s >= 3 AND b <= 60 AS high_confidence, round(b / greatest(s, 1), 6) AS fission, round(1 / ln(2 + a), 6) AS collapse FROM t""",
    "d21_signatures": f"""WITH n AS (SELECT cell, {", ".join(f"count(*) FILTER (gene = '{e}') AS n{i}" for i, e in enumerate(["click", "error", "purchase", "signup", "view"]))} FROM {_TX} GROUP BY cell), m AS (SELECT *, greatest(n0, n1, n2, n3, n4) AS top FROM n)
      SELECT CASE WHEN top <= 0 THEN 'unresolved' WHEN n0 = top THEN 'stem_wnt' WHEN n1 = top THEN 'proliferation' WHEN n2 = top THEN 'goblet_secretory' WHEN n3 = top THEN 'absorptive_best4' ELSE 'endocrine_tuft' END AS state,
      count(*) AS n, CAST(sum(top) AS BIGINT) AS score FROM m GROUP BY 1""",
    "p11_flip": f"""WITH p AS (SELECT vec_id, z, CAST(cluster AS INT) AS s FROM {_POINTS}), m AS (SELECT s, min(z) AS lo, max(z) AS hi FROM p GROUP BY s)
      SELECT vec_id, round(CASE WHEN s % 2 = 1 THEN lo + hi - z ELSE z END - (lo + hi) / 2 + 10.0 * s, 6) AS z FROM p JOIN m USING (s)""",
    "j7_knn_field": f"""WITH k AS (SELECT a.vec_id, b.z, {_D2} AS d2, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_D2}, b.vec_id) AS k FROM {_POINTS} a JOIN {_POINTS} b ON a.vec_id <> b.vec_id)
      SELECT vec_id, round(CASE WHEN count(*) FILTER (d2 = 0) > 0 THEN avg(z) FILTER (d2 = 0) ELSE sum(z / sqrt(d2)) FILTER (d2 > 0) / sum(1 / sqrt(d2)) FILTER (d2 > 0) END, 5) AS z FROM k WHERE k <= 30 GROUP BY vec_id""",
    "j10_gaussian_field": f"""WITH k AS (SELECT a.vec_id, b.z, {_D2} AS d2, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_D2}, b.vec_id) AS k FROM {_POINTS} a JOIN {_POINTS} b ON {_D2} <= 0.04)
      SELECT vec_id, round(sum(z * exp(-d2 / 0.02)) / sum(exp(-d2 / 0.02)), 5) AS z FROM k WHERE k <= 8 GROUP BY vec_id""",
    "j11_context": f"""WITH c AS (SELECT region, avg(x) AS x, avg(y) * 20 AS y FROM {_SPOTS} GROUP BY region), k AS (SELECT a.region, b.region AS near_region, {_D2} AS d2, row_number() OVER (PARTITION BY a.region ORDER BY {_D2}, b.region) AS k FROM c a JOIN c b ON a.region <> b.region)
      SELECT region, near_region, k AS place, round(sqrt(d2), 5) AS distance FROM k WHERE k <= 4""",
    "z13_turning": f"WITH {_BOXES.format(e=0.0)} SELECT region, 360.0::DOUBLE AS total, 90.0::DOUBLE AS sharpest FROM boxes",
    "z38_spacing": f"WITH z AS (SELECT DISTINCT CAST(sample * sample AS DOUBLE) AS z FROM {_SPOTS}), s AS (SELECT z - lag(z) OVER (ORDER BY z) AS step FROM z) SELECT coalesce(median(step), 5.0) AS spacing FROM s",
    "z19_compatible": f"""WITH s AS (SELECT region, CASE WHEN count(*) % 3 > 0 THEN min(cluster) END AS s FROM {_SPOTS} GROUP BY region), n AS (SELECT s, count(*) AS n FROM s GROUP BY s)
      SELECT coalesce(x.s, 'none') AS a, coalesce(y.s, 'none') AS b, x.n * y.n AS n FROM n x JOIN n y ON x.s = y.s OR x.s IS NULL OR y.s IS NULL""",
    "z20_edge_score": f"""WITH t AS (SELECT region, sample, avg(weight) AS v, count(*) AS n FROM {_SPOTS} GROUP BY ALL)
      SELECT a.sample, round(sum(least(a.n, b.n) * (1 - abs(a.v - b.v))) / sum(least(a.n, b.n)), 6) AS score, CAST(sum(least(a.n, b.n)) AS BIGINT) AS weight FROM t a JOIN t b ON a.region = b.region AND b.sample = a.sample + 1 GROUP BY a.sample""",
    "z35_edges": f"""WITH t AS (SELECT region, count(*) AS n FROM {_SPOTS} GROUP BY region), p AS (SELECT region, n, (region * 7 + n) % 97 AS other FROM t), j AS (SELECT p.*, t.n AS m FROM p JOIN t ON t.region = p.other)
      SELECT CASE WHEN n > m THEN other ELSE region END AS source, CASE WHEN n > m THEN region ELSE other END AS target, region <> other AS crosses FROM j""",
    "z37_genes": f"SELECT DISTINCT gene FROM {_TX} WHERE gene IS NOT NULL",
}
