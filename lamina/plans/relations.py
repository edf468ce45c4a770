"""Queries over joins, aggregates, windows, samples, decisions and graphs, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.ordered import aggregate
from ..operators import aggregates as A
from ..operators import alignment
from ..operators import decisions as D
from ..operators import matching as M
from ..sources import tables
from ..sources.tables import SQL, read

GENES = ["click", "error", "purchase", "signup", "view"]
SIGNATURES = [("commerce", ["purchase", "signup"]), ("browse", ["click", "view"]), ("stress", ["error"])]


def j1_align_best_key(spark, sf):
    cells = tables.cells(spark, sf).withColumns({"barcode": F.concat(F.col("owner").cast("string"), F.lit("-1")), "alt": F.col("cell_id").cast("string")})
    clusters = read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    return M.align_best_key(cells, clusters, ["alt", "barcode"], "key").groupBy("segment").agg(F.count("*").alias("n"))


def j2_left(spark, sf):
    n = tables.cells(spark, sf).groupBy(F.col("owner").alias("c_custkey")).agg(F.count("*").alias("n"))
    return read(spark, sf, "customer").select("c_custkey", "c_nationkey").join(n, "c_custkey", "left").groupBy("c_nationkey").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_cells"), F.count_if(F.col("n").isNull()).alias("n_empty"))


def j5_semi_anti(spark, sf):
    cells, people = tables.cells(spark, sf), read(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("owner"))
    kept, lost = cells.join(people, "owner", "left_semi"), cells.join(people, "owner", "left_anti")
    return kept.groupBy("cluster").agg(F.count("*").alias("n_in")).join(lost.groupBy("cluster").agg(F.count("*").alias("n_out")), "cluster")


def j23_adjacent_slices(spark, sf):
    t = tables.spots(spark, sf).groupBy("cluster", "sample").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"))
    nxt = t.select("cluster", (F.col("sample") - 1).alias("sample"), F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("n").alias("nn"))
    return t.join(nxt, ["cluster", "sample"]).select("cluster", "sample", F.round(F.hypot(F.col("nx") - F.col("cx"), F.col("ny") - F.col("cy")), 6).alias("jump"), F.round(F.col("nn") / F.col("n"), 6).alias("growth"))


def _pairs(spark, sf):
    """Scored pairs of parts and suppliers."""
    return read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.round(F.sum("l_quantity"), 2).alias("score"), F.count("*").alias("n"))


def j17_mutual_best(spark, sf):
    return M.mutual_best(_pairs(spark, sf), "a", "b", "score").select("a", "b", "score")


def j16_fallback(spark, sf):
    p = _pairs(spark, sf)
    return M.unmatched(M.mutual_best(p, "a", "b", "score"), p, "a", "b").groupBy("b").agg(F.count("*").alias("n"))


def j19_greedy(spark, sf):
    return M.greedy_pairs(_pairs(spark, sf), "a", "b", [-F.col("score")]).select("a", "b", "score")


def j20_topk(spark, sf):
    return M.top_k(_pairs(spark, sf), ["b"], [F.desc("score"), F.col("a")], 3).select("b", "a", "score", "rank")


def j21_mutual_top3(spark, sf):
    return M.mutual_ranks(_pairs(spark, sf), "a", "b", "score", 3).select("a", "b", "rank_a", "rank_b")


def j24_key_match(spark, sf):
    return M.full_match(read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels").select("doc_id"), ["doc_id"])


def a5_spread(spark, sf):
    return A.spread(tables.spots(spark, sf), ["cluster", "sample"], "x")


def a8_quantiles(spark, sf):
    return A.summary(tables.spots(spark, sf), ["region"], "x")


def a9_weighted_axis(spark, sf):
    mean, std = A.weighted("x", "weight")
    tail = F.sum(F.when(F.col("x") > 900, F.col("weight"))) / F.sum("weight")
    return tables.spots(spark, sf).groupBy("region").agg(F.round(mean, 4).alias("mean"), F.round(std, 3).alias("std"), F.round(F.coalesce(tail, F.lit(0.0)), 6).alias("tail"))


def a13_state_mix(spark, sf):
    return A.state_mix(tables.transcripts(spark, sf), ["cell"], "gene")


def a16_gene_pivot(spark, sf):
    return A.pivot_sums(tables.transcripts(spark, sf), "cell", "gene", GENES, "k", [f"{g}_k" for g in GENES])


def a17_flag_union(spark, sf):
    t = tables.transcripts(spark, sf).where("qv > 15").withColumn("flags", F.concat_ws(";", "gene", F.when(F.col("k") > 50, "high"), F.when(F.col("qv") > 50, "bright")))
    return A.flag_union(t, ["cell"], "flags")


def _nation_edges(spark, sf):
    """Trade between nations of customers and suppliers."""
    line, orders = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    c, s = read(spark, sf, "customer"), read(spark, sf, "supplier")
    return (
        line.select("l_orderkey", "l_suppkey", "l_quantity").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select("c_nationkey", "s_nationkey", "l_quantity")
    )


def a22_pair_totals(spark, sf):
    return A.pair_totals(_nation_edges(spark, sf), "c_nationkey", "s_nationkey", "l_quantity")


def a23_dense_pairs(spark, sf):
    some = A.pair_totals(_nation_edges(spark, sf), "c_nationkey", "s_nationkey", "l_quantity")
    return A.dense_pairs(read(spark, sf, "nation").select(F.col("n_nationkey").alias("label")), some)


def a24_degrees(spark, sf):
    return A.degrees(_nation_edges(spark, sf), "c_nationkey", "s_nationkey", "l_quantity")


def a26_signature(spark, sf):
    counts = tables.transcripts(spark, sf).groupBy("cell", "gene").agg(F.count("*").alias("n"))
    return A.signature_states(counts, "cell", "gene", "n", SIGNATURES)


def a32_mad_filter(spark, sf):
    return A.within_mad(tables.spots(spark, sf).select("cluster", "x", "weight"), ["cluster"], "x", 1.0).groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("mean_x"))


def a34_region_table(spark, sf):
    return tables.spots(spark, sf).groupBy("region").agg(
        F.count("*").alias("pixels"), F.round(F.min("x"), 4).alias("x0"), F.round(F.max("x") + 1, 4).alias("x1"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"),
        F.round(F.avg("x"), 4).alias("cx"), F.round(F.avg("weight"), 6).alias("mean_score"), F.max("weight").alias("max_score"),
    )


def w1_rank(spark, sf):
    counts = aggregate(tables.spots(spark, sf, place=True), ["region"], sums={"total": F.col("x")}).withColumn("total", C.rounded("total", 2))
    return M.global_rank(counts, [F.desc("total"), F.col("region")], "place").withColumn("name", F.format_string("region_%04d", "place"))


def w2_pct_rank(spark, sf):
    return A.percent_rank_average(tables.transcripts(spark, sf).select("event_id", "gene", "k"), "k", ["gene"]).select("event_id", F.round("pct", 6).alias("pct"))


def w4_longitudinal(spark, sf):
    t = tables.spots(spark, sf).groupBy("region", "sample").agg(F.avg("x").alias("v"))
    w = W.partitionBy("region")
    low, high = F.min("v").over(w), F.max("v").over(w)
    return t.select("region", "sample", F.round(F.when(high > low, (F.col("v") - low) / (high - low)).otherwise(0.0), 6).alias("t"))


def w7_links(spark, sf):
    t = tables.spots(spark, sf).groupBy("region", "sample").agg(F.count("*").alias("n"))
    w = W.partitionBy("region").orderBy("sample")
    return t.select("region", "sample", F.lag("sample").over(w).alias("prev"), F.lead("sample").over(w).alias("next"))


def w8_row_zscore(spark, sf):
    t = tables.spots(spark, sf).groupBy("region", "cluster").agg(F.avg("x").alias("v"))
    return A.row_zscores(t, "region", "v").select("region", "cluster", F.round("z", 5).alias("z"))


def o4_markers(spark, sf):
    p = _pairs(spark, sf)
    return M.threshold_or_top(p, ["b"], F.col("score") > 120, [F.desc("score"), F.col("a")], 5).select("b", "a", "score", "rank")


def o6_sample(spark, sf):
    return M.hash_sample(tables.cells(spark, sf).select("cell_id", "cluster"), "cell_id", 500, 7)


def o7_stratified(spark, sf):
    return M.stratified_sample(tables.cells(spark, sf).select("cell_id", "cluster", "slice"), ["cluster", "slice"], "cell_id", 333, 7)


def o8_thinning(spark, sf):
    return M.evenly_spaced(tables.cells(spark, sf).select("cell_id", "cluster"), ["cluster"], "cell_id", 25)


def u3_set_overlap(spark, sf):
    t = tables.transcripts(spark, sf)
    sets = t.groupBy("cell").agg(F.collect_set("gene").alias("g"), F.collect_set(F.when(F.col("qv") > 40, F.col("gene"))).alias("h"))
    return sets.select("cell", F.size(F.array_intersect("g", "h")).cast("bigint").alias("n_both"), F.array_join(F.array_sort(F.array_except("g", "h")), ";").alias("only_low"), F.arrays_overlap("g", "h").alias("any_both"))


def f1_labels(spark, sf):
    raw = F.concat(F.lit(" "), F.element_at(F.array(F.lit("c"), F.lit("Cluster_"), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int")), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".0").otherwise(""), F.lit(" "))
    t = read(spark, sf, "part").withColumn("raw", raw)
    return t.groupBy(C.canonical_label("raw").alias("label"), C.loose_label("raw").alias("loose")).agg(F.count("*").alias("n"), F.min(C.natural_key("p_brand")).alias("first_brand"))


def f4_cosine(spark, sf):
    w = tables.transcripts(spark, sf).groupBy("cell", "gene").agg(F.sum("qv").alias("v"))
    cells = w.select("cell").distinct()
    pairs = cells.select(F.col("cell").alias("a"), (F.col("cell") + 1).alias("b"))
    return M.sparse_cosine(w, "cell", "gene", "v", pairs)


def f7_json(spark, sf):
    t = tables.transcripts(spark, sf)
    return t.groupBy("gene").agg(F.sum("k").alias("sum_k"), F.count_if(F.col("k").isNull()).alias("n_bad"), F.max(F.to_json(F.struct("gene", "k"))).alias("top"))


def g1_components(spark, sf):
    p = _pairs(spark, sf).select(F.col("a"), (-F.col("b") - 1).alias("b"))
    return M.components(p, "a", "b")


def d1_verdict(spark, sf):
    p = F.when(F.col("cluster") == "AF", 0.0).otherwise(0.06)
    t = aggregate(tables.spots(spark, sf, place=True), ["region"], means={"weight": F.col("weight"), "y": F.col("y"), "p": p})
    verdict, explained = D.structure_verdict(F.col("weight") * 10 - 0.45, (F.col("y") - 25) / 4, F.col("p"))
    return t.select("region", verdict.alias("verdict"), C.rounded(explained, 6).alias("explained"))


def d3_status(spark, sf):
    t = tables.spots(spark, sf).groupBy("region").agg((F.avg("weight") * 20 - 1).alias("rl"), ((F.avg("y") - 25) / 2).alias("csr"), (F.stddev_pop("weight") * 1.6).alias("p"), F.lit(0.04).alias("q"))
    return t.select("region", D.cluster_status(F.col("rl"), F.col("csr"), F.col("p"), F.col("q")).alias("status"))


def d6_quality(spark, sf):
    t = aggregate(
        tables.spots(spark, sf, place=True), ["region"], F.countDistinct("sample").alias("n_slices"), F.min("weight").alias("least"), F.max("x").alias("most"), F.stddev_pop("x").alias("spread"),
        F.count_if(F.col("weight") > 0.099).alias("n_high"), means={"mw": F.col("weight"), "mx": F.col("x")},
    )
    t = t.withColumns({"overlap": F.col("least") + F.col("mw"), "jump": F.col("most") - F.col("mx"), "cv": F.col("spread") / F.col("mx")})
    n_branch = F.when(F.col("n_high") > 60, 1).otherwise(0)
    quality = D.track_quality(F.col("n_slices"), F.col("overlap"), F.col("jump"), F.col("cv"), n_branch, F.lit(0), 0.0495, 550.0, 0.56)
    t = t.withColumn("quality", quality).withColumn("priority", D.track_priority(F.col("quality"), n_branch, F.col("overlap"), F.col("n_slices")))
    return t.select("region", "quality", F.col("priority").cast("bigint").alias("priority"))


def d9_motif(spark, sf):
    links = _pairs(spark, sf).select((F.col("b") % 40).alias("family"), F.col("a").alias("source"), F.col("b").alias("target"), F.when(F.col("score") > 90, "candidate_branch_merge").otherwise("link").alias("kind"))
    return D.motifs(links, "family", "source", "target", "kind")


def d20_boundary(spark, sf):
    t = tables.transcripts(spark, sf).groupBy("cell").agg(
        F.count_if(F.col("gene") == "click").alias("rec"), F.count_if(F.col("gene") == "view").alias("lig"), F.count("*").alias("n"), F.count_if(F.col("qv") > 30).alias("ring"), F.avg("qv").alias("dens")
    )
    return t.select("cell", F.round(D.boundary_interaction(F.col("rec"), F.col("n"), F.col("lig"), F.col("ring"), F.col("dens")), 6).alias("score"))


def x57_evidence(spark, sf):
    """Markers of each cluster from a wide table turned long, best five, and the clusters whose centroids are nearest."""
    wide = A.pivot_sums(tables.spots(spark, sf).withColumn("q", F.col("y").cast("bigint")), "region", "cluster", ["AF", "AO", "NF", "NO", "RF", "RO"], "q", ["AF", "AO", "NF", "NO", "RF", "RO"])
    long = wide.unpivot("region", ["AF", "AO", "NF", "NO", "RF", "RO"], "cluster", "log2fc")
    return M.top_k(long, ["cluster"], [F.desc("log2fc"), F.col("region")], 5).select("cluster", "region", "log2fc", "rank")


def x58_annotation(spark, sf):
    """Cell types by marker support: summed fold changes of positive hits, hits, and negative markers."""
    spec = spark.createDataFrame([("commerce", "purchase", 1), ("commerce", "signup", 1), ("commerce", "error", -1), ("browse", "click", 1), ("browse", "view", 1), ("browse", "purchase", -1)], "kind string, gene string, sign int")
    t = tables.transcripts(spark, sf).groupBy("cell", "gene").agg(F.log2(F.count("*")).alias("fc"))
    hit = t.join(F.broadcast(spec), "gene").groupBy("cell", "kind").agg(
        F.count_if(F.col("sign") > 0).alias("hits"), F.sum(F.when(F.col("sign") > 0, F.col("fc")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("sign") < 0, F.col("fc")).otherwise(0.0)).alias("neg")
    )
    scored = hit.withColumn("score", F.round(D.marker_score(F.col("hits"), F.col("pos"), F.col("neg")), 6))
    best = M.top_k(scored, ["cell"], [F.desc("score"), F.col("kind")], 2)
    lead = best.groupBy("cell").agg(F.max(F.when(F.col("rank") == 1, F.col("kind"))).alias("kind"), F.max("score").alias("score"), F.when(F.count("*") > 1, F.max("score") - F.min("score")).otherwise(0.0).alias("margin"))
    return lead.select("cell", "kind", "score", F.round(D.structure_confidence(F.col("score") / 20, F.col("margin") / 20), 6).alias("confidence"))


def x60_case_bundle(spark, sf):
    t = tables.cells(spark, sf).groupBy("slice", "cluster").agg(F.count("*").alias("n"))
    total = t.groupBy("slice").agg(F.sum("n").alias("total"))
    top = M.top_k(t, ["slice"], [F.desc("n"), F.col("cluster")], 3).groupBy("slice").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cluster"))), lambda s: s["cluster"]), ";").alias("top"))
    return total.join(top, "slice").select("slice", "total", "top")


def z28_drift(spark, sf):
    """Slope of the slices' centroids by order, taken off."""
    t = tables.spots(spark, sf).groupBy("sample").agg(F.avg("x").alias("cx"))
    return alignment.drift_free(t, "sample", "cx").select("sample", F.round("steady", 4).alias("steady_x"))


NAMES = [
    "j1_align_best_key", "j2_left", "j5_semi_anti", "j16_fallback", "j17_mutual_best", "j19_greedy", "j20_topk", "j21_mutual_top3", "j23_adjacent_slices", "j24_key_match",
    "a5_spread", "a8_quantiles", "a9_weighted_axis", "a13_state_mix", "a16_gene_pivot", "a17_flag_union", "a22_pair_totals", "a23_dense_pairs", "a24_degrees", "a26_signature", "a32_mad_filter", "a34_region_table",
    "w1_rank", "w2_pct_rank", "w4_longitudinal", "w7_links", "w8_row_zscore", "o4_markers", "o6_sample", "o7_stratified", "o8_thinning", "u3_set_overlap", "f1_labels", "f4_cosine", "f7_json",
    "g1_components", "d1_verdict", "d3_status", "d6_quality", "d9_motif", "d20_boundary", "x57_evidence", "x58_annotation", "x60_case_bundle", "z28_drift",
]
QUERIES = {n: globals()[n] for n in NAMES}

_CELLS, _SPOTS, _TX = SQL["cells"], SQL["spots"], SQL["transcripts"]
_PAIRS = "p AS (SELECT l_partkey AS a, l_suppkey AS b, round(sum(l_quantity), 2) AS score, count(*) AS n FROM lineitem GROUP BY ALL)"
_BEST = """o AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) = 1), i AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY b ORDER BY score DESC, a) = 1),
m AS (SELECT o.* FROM o JOIN i USING (a, b))"""
_EDGES = """e AS (SELECT c_nationkey AS c, s_nationkey AS s, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
ORACLE_SQL = {
    "j1_align_best_key": f"""WITH f AS (SELECT 0 AS i, c_mktsegment AS segment FROM {_CELLS} JOIN customer ON c_custkey = cell_id UNION ALL SELECT 1, c_mktsegment FROM {_CELLS} JOIN customer ON c_custkey = owner),
      b AS (SELECT i FROM f GROUP BY i ORDER BY count(*) DESC, i LIMIT 1) SELECT segment, count(*) AS n FROM f WHERE i = (SELECT i FROM b) GROUP BY segment""",
    "j2_left": f"SELECT c_nationkey, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_cells, count(*) FILTER (n IS NULL) AS n_empty FROM customer LEFT JOIN (SELECT owner, count(*) AS n FROM {_CELLS} GROUP BY 1) ON owner = c_custkey GROUP BY 1",
    "j5_semi_anti": f"SELECT cluster, count(*) FILTER (owner IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)) AS n_in, count(*) FILTER (owner NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)) AS n_out FROM {_CELLS} GROUP BY 1",
    "j16_fallback": f"WITH {_PAIRS}, {_BEST} SELECT b, count(*) AS n FROM p WHERE a NOT IN (SELECT a FROM m) AND b NOT IN (SELECT b FROM m) GROUP BY b",
    "j17_mutual_best": f"WITH {_PAIRS}, {_BEST} SELECT a, b, score FROM m",
    "j20_topk": f"WITH {_PAIRS} SELECT b, a, score, row_number() OVER w AS rank FROM p WINDOW w AS (PARTITION BY b ORDER BY score DESC, a) QUALIFY row_number() OVER w <= 3",
    "j21_mutual_top3": f"""WITH {_PAIRS}, r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank_a, row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS rank_b FROM p)
      SELECT * FROM r WHERE rank_a <= 3 AND rank_b <= 3""",
    "j23_adjacent_slices": f"""WITH t AS (SELECT cluster, sample, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM {_SPOTS} GROUP BY ALL)
      SELECT a.cluster, a.sample, round(sqrt((b.cx - a.cx) * (b.cx - a.cx) + (b.cy - a.cy) * (b.cy - a.cy)), 6) AS jump, round(b.n / a.n, 6) AS growth FROM t a JOIN t b ON a.cluster = b.cluster AND b.sample = a.sample + 1""",
    "j24_key_match": "SELECT count(*) FILTER (l.doc_id IS NULL) AS n_left_only, count(*) FILTER (d.doc_id IS NULL) AS n_right_only, count(*) FILTER (d.doc_id = l.doc_id) AS n_both FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id",
    "a5_spread": f"SELECT cluster, sample, count(x) AS n, round(avg(x), 6) AS mean, round(coalesce(stddev_samp(x), 0), 6) AS std, round(coalesce(var_samp(x), 0), 4) AS variance, round(stddev_pop(x) / avg(x), 6) AS cv FROM {_SPOTS} GROUP BY ALL",
    "a8_quantiles": "SELECT region, count(x) AS n, round(min(x), 6) AS min, "
    + ", ".join(f"round(quantile_cont(x, CAST({p} AS DOUBLE)), 6) AS {c}" for p, c in ((0.05, "p05"), (0.5, "median"), (0.9, "p90"), (0.95, "p95")))
    + f", round(avg(x), 6) AS mean, round(max(x), 6) AS max FROM {_SPOTS} GROUP BY region",
    "a9_weighted_axis": f"""WITH s AS (SELECT region, sum(weight) AS w, sum(x * weight) AS m1, sum(x * x * weight) AS m2, coalesce(sum(weight) FILTER (x > 900), 0) AS t FROM {_SPOTS} GROUP BY region)
      SELECT region, round(m1 / w, 4) AS mean, round(sqrt(greatest(m2 / w - (m1 / w) * (m1 / w), 0)), 3) AS std, round(t / w, 6) AS tail FROM s""",
    "a13_state_mix": f"""WITH n AS (SELECT cell, gene, count(*) AS n FROM {_TX} GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY cell) AS p FROM n)
      SELECT cell, arg_min(gene, (-n, gene)) AS dominant, round(max(p), 6) AS fraction, round(-sum(p * log2(p)), 6) AS entropy, round(CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0 END, 6) AS evenness FROM p GROUP BY cell""",
    "a16_gene_pivot": "SELECT cell, " + ", ".join(f"CAST(coalesce(sum(k) FILTER (gene = '{g}'), 0) AS BIGINT) AS {g}_k" for g in GENES) + f" FROM {_TX} GROUP BY cell",
    "a17_flag_union": f"""WITH f AS (SELECT DISTINCT cell, unnest(list_filter([gene, CASE WHEN k > 50 THEN 'high' END, CASE WHEN qv > 50 THEN 'bright' END], lambda x: x IS NOT NULL)) AS f FROM {_TX} WHERE qv > 15)
      SELECT cell, string_agg(f, ';' ORDER BY f) AS flags, count(*) AS n_flags FROM f GROUP BY cell""",
    "a22_pair_totals": f"WITH {_EDGES} SELECT least(c, s) AS a, greatest(c, s) AS b, count(*) AS n, round(sum(q), 4) AS total FROM e GROUP BY ALL",
    "a23_dense_pairs": f"""WITH {_EDGES}, t AS (SELECT least(c, s) AS a, greatest(c, s) AS b, count(*) AS n, round(sum(q), 4) AS total FROM e GROUP BY ALL)
      SELECT x.n_nationkey AS a, y.n_nationkey AS b, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM nation x JOIN nation y ON x.n_nationkey <= y.n_nationkey LEFT JOIN t ON t.a = x.n_nationkey AND t.b = y.n_nationkey""",
    "a24_degrees": f"""WITH {_EDGES}, b AS (SELECT c AS node, s AS other, q FROM e UNION ALL SELECT s, c, q FROM e WHERE c <> s)
      SELECT node, count(DISTINCT other) FILTER (other <> node) AS n_neighbours, count(*) AS n_edges, round(sum(q), 2) AS strength FROM b GROUP BY node""",
    "a26_signature": f"""WITH n AS (SELECT cell, count(*) FILTER (gene IN ('purchase', 'signup')) AS c, count(*) FILTER (gene IN ('click', 'view')) AS b, count(*) FILTER (gene = 'error') AS e FROM {_TX} GROUP BY cell)
      SELECT cell, CASE WHEN greatest(c, b, e) <= 0 THEN 'unresolved' WHEN c = greatest(c, b, e) THEN 'commerce' WHEN b = greatest(c, b, e) THEN 'browse' ELSE 'stress' END AS state, greatest(c, b, e) AS score FROM n""",
    "a32_mad_filter": f"""WITH m AS (SELECT cluster, median(x) AS med FROM {_SPOTS} GROUP BY cluster), d AS (SELECT cluster, x, abs(x - med) AS dev FROM {_SPOTS} JOIN m USING (cluster)), k AS (SELECT cluster, median(dev) AS mad FROM d GROUP BY cluster)
      SELECT cluster, count(*) AS n, round(avg(x), 4) AS mean_x FROM d JOIN k USING (cluster) WHERE dev <= CAST(1.4826 AS DOUBLE) * mad GROUP BY cluster""",
    "a34_region_table": f"""SELECT region, count(*) AS pixels, round(min(x), 4) AS x0, round(max(x) + 1, 4) AS x1, min(y) AS y0, max(y) + 1 AS y1, round(avg(x), 4) AS cx, round(avg(weight), 6) AS mean_score, max(weight) AS max_score FROM {_SPOTS} GROUP BY region""",
    "w1_rank": f"WITH t AS (SELECT region, round(sum(x), 2) AS total FROM {_SPOTS} GROUP BY region) SELECT region, total, row_number() OVER (ORDER BY total DESC, region) AS place, format('region_{{:04d}}', row_number() OVER (ORDER BY total DESC, region)) AS name FROM t",
    "w2_pct_rank": f"""WITH r AS (SELECT event_id, k, rank() OVER (PARTITION BY gene ORDER BY k) AS r, count(*) OVER (PARTITION BY gene, k) AS same, count(k) OVER (PARTITION BY gene) AS total FROM {_TX})
      SELECT event_id, round(CASE WHEN k IS NULL OR same = total THEN 0 ELSE (r + (same - 1) / 2) / total END, 6) AS pct FROM r""",
    "w4_longitudinal": f"""WITH t AS (SELECT region, sample, avg(x) AS v FROM {_SPOTS} GROUP BY ALL), w AS (SELECT *, min(v) OVER (PARTITION BY region) AS lo, max(v) OVER (PARTITION BY region) AS hi FROM t)
      SELECT region, sample, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 6) AS t FROM w""",
    "w7_links": f"WITH t AS (SELECT DISTINCT region, sample FROM {_SPOTS}) SELECT region, sample, lag(sample) OVER w AS prev, lead(sample) OVER w AS next FROM t WINDOW w AS (PARTITION BY region ORDER BY sample)",
    "w8_row_zscore": f"""WITH t AS (SELECT region, cluster, avg(x) AS v FROM {_SPOTS} GROUP BY ALL) SELECT region, cluster, round((v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w = 0 THEN 1 ELSE stddev_pop(v) OVER w END, 5) AS z FROM t WINDOW w AS (PARTITION BY region)""",
    "o4_markers": f"""WITH {_PAIRS}, f AS (SELECT *, score > 120 AS ok, bool_or(score > 120) OVER (PARTITION BY b) AS any_ok FROM p)
      SELECT b, a, score, row_number() OVER w AS rank FROM f WHERE ok OR NOT any_ok WINDOW w AS (PARTITION BY b ORDER BY score DESC, a) QUALIFY row_number() OVER w <= 5""",
    "o6_sample": f"SELECT cell_id, cluster FROM {_CELLS} ORDER BY sha256('7:' || cell_id), cell_id LIMIT 500",
    "o7_stratified": f"""WITH c AS (SELECT cluster, slice, count(*) AS n FROM {_CELLS} GROUP BY ALL), x AS (SELECT *, n * 333 / sum(n) OVER () AS exact FROM c),
      q AS (SELECT cluster, slice, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, cluster, slice) <= 333 - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM x),
      r AS (SELECT cell_id, cluster, slice, row_number() OVER (PARTITION BY cluster, slice ORDER BY sha256('7:' || cell_id), cell_id) AS k FROM {_CELLS}) SELECT cell_id, cluster, slice FROM r JOIN q USING (cluster, slice) WHERE k <= quota""",
    "o8_thinning": f"""WITH r AS (SELECT cell_id, cluster, row_number() OVER (PARTITION BY cluster ORDER BY cell_id) - 1 AS i, count(*) OVER (PARTITION BY cluster) AS n FROM {_CELLS})
      SELECT cell_id, cluster FROM r WHERE n <= 25 OR list_contains(list_transform(range(25), lambda k: k * (n - 1) // 24), i)""",
    "u3_set_overlap": f"""WITH s AS (SELECT cell, list(DISTINCT gene) AS g, coalesce(list(DISTINCT gene) FILTER (qv > 40), []) AS h FROM {_TX} GROUP BY cell)
      SELECT cell, CAST(len(list_intersect(g, h)) AS BIGINT) AS n_both, array_to_string(list_sort(list_filter(g, lambda v: NOT list_contains(h, v))), ';') AS only_low, len(list_intersect(g, h)) > 0 AS any_both FROM s""",
    "f1_labels": """WITH t AS (SELECT p_partkey, p_brand, CASE p_partkey % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'Cluster_' ELSE '' END || p_size || CASE WHEN p_partkey % 2 = 0 THEN '.0' ELSE '' END AS raw, p_size FROM part)
      SELECT regexp_replace(raw, '^(\\d+)\\.0$', '\\1') AS label, CAST(p_size AS VARCHAR) AS loose, count(*) AS n, min('Brand#' || lpad(substr(p_brand, 7), 12, '0')) AS first_brand FROM t GROUP BY 1, 2""",
    "f4_cosine": f"""WITH w AS (SELECT cell, gene, sum(qv) AS v FROM {_TX} GROUP BY ALL), n AS (SELECT cell, sqrt(sum(v * v)) AS n FROM w GROUP BY cell),
      d AS (SELECT a.cell AS a, sum(a.v * b.v) AS dot FROM w a JOIN w b ON b.cell = a.cell + 1 AND a.gene = b.gene GROUP BY a.cell)
      SELECT n.cell AS a, n.cell + 1 AS b, round(coalesce(dot, 0) / nullif(n.n * m.n, 0), 6) AS cosine FROM n LEFT JOIN d ON d.a = n.cell LEFT JOIN n m ON m.cell = n.cell + 1""",
    "f7_json": f"SELECT gene, CAST(sum(k) AS BIGINT) AS sum_k, count(*) FILTER (k IS NULL) AS n_bad, max('{{\"gene\":\"' || gene || '\",\"k\":' || k || '}}') AS top FROM {_TX} GROUP BY gene",
    # Labels fall to the least about them, one step at a time; components of these tables are far less than 16 steps wide.
    "g1_components": f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a AS u, -b - 1 AS v FROM p UNION ALL SELECT -b - 1, a FROM p UNION SELECT a, a FROM p UNION SELECT -b - 1, -b - 1 FROM p),
      r(u, c, k) AS (SELECT DISTINCT u, u, 0 FROM e UNION ALL SELECT e.u, min(r.c), max(r.k) + 1 FROM r JOIN e ON r.u = e.v WHERE r.k < 16 GROUP BY e.u)
      SELECT u AS node, min(c) AS component FROM r GROUP BY u""",
    "d1_verdict": f"""WITH t AS (SELECT region, avg(weight) * 10 - 0.45 AS di, (avg(y) - 25) / 4 AS dt, avg(CASE WHEN cluster = 'AF' THEN 0.0 ELSE CAST(0.06 AS DOUBLE) END) AS p FROM {_SPOTS} GROUP BY region)
      SELECT region, CASE WHEN dt <= 0 OR p > 0.05 THEN 'FAIL' WHEN di <= 0.10 THEN 'PASS' WHEN di <= 0.30 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict, round(CASE WHEN dt > 0 THEN 1 - greatest(di, 0) / dt END, 6) AS explained FROM t""",
    "d3_status": f"""WITH t AS (SELECT region, avg(weight) * 20 - 1 AS rl, (avg(y) - 25) / 2 AS csr, stddev_pop(weight) * 1.6 AS p FROM {_SPOTS} GROUP BY region)
      SELECT region, CASE WHEN rl >= 0.30 AND csr >= 0.30 AND p <= 0.05 THEN 'HOTSPOT' WHEN rl >= 0.15 AND p <= 0.05 THEN 'CLUSTERED' WHEN rl <= -0.15 THEN 'DISPERSED' ELSE 'RANDOM-LIKE' END AS status FROM t""",
    "d6_quality": f"""WITH t AS (SELECT region, count(DISTINCT sample) AS n, min(weight) + avg(weight) AS o, max(x) - avg(x) AS j, stddev_pop(x) / avg(x) AS cv, count(*) FILTER (weight > 0.099) > 60 AS br FROM {_SPOTS} GROUP BY region),
      q AS (SELECT *, CASE WHEN n <= 1 THEN 'isolated' WHEN n <= 2 OR br THEN 'review' WHEN o < 0.0495 OR j > 550 OR cv > 0.56 THEN 'review' ELSE 'good' END AS quality FROM t)
      SELECT region, quality, CAST(CASE quality WHEN 'review' THEN CASE WHEN br THEN 0 WHEN o < 0.05 THEN 1 ELSE 2 END WHEN 'isolated' THEN 3 ELSE CASE WHEN n <= 3 THEN 4 ELSE 5 END END AS BIGINT) AS priority FROM q""",
    "d9_motif": f"""WITH {_PAIRS}, l AS (SELECT b % 40 AS family, a, b, score > 90 AS br FROM p), o AS (SELECT family, max(k) AS mo FROM (SELECT family, a, count(DISTINCT b) AS k FROM l GROUP BY ALL) GROUP BY family),
      i AS (SELECT family, max(k) AS mi FROM (SELECT family, b, count(DISTINCT a) AS k FROM l GROUP BY ALL) GROUP BY family), x AS (SELECT family, bool_or(br) AS br FROM l GROUP BY family)
      SELECT family, CASE WHEN NOT br THEN 'linear' WHEN mo > 1 AND mi <= 1 THEN 'candidate_split' WHEN mi > 1 AND mo <= 1 THEN 'candidate_merge' ELSE 'complex' END AS motif FROM o JOIN i USING (family) JOIN x USING (family)""",
    "d20_boundary": f"""WITH t AS (SELECT cell, count(*) FILTER (gene = 'click') AS rec, count(*) FILTER (gene = 'view') AS lig, count(*) AS n, count(*) FILTER (qv > 30) AS ring, avg(qv) AS dens FROM {_TX} GROUP BY cell)
      SELECT cell, round(ln(1 + coalesce(rec / nullif(n, 0), 0)) * ln(1 + coalesce(lig / nullif(ring, 0), 0)) * ln(1 + dens), 6) AS score FROM t""",
    "x57_evidence": f"""WITH w AS (SELECT r.region, c.cluster, coalesce(s.q, 0) AS log2fc FROM (SELECT DISTINCT region FROM {_SPOTS}) r CROSS JOIN (VALUES ('AF'), ('AO'), ('NF'), ('NO'), ('RF'), ('RO')) c(cluster)
      LEFT JOIN (SELECT region, cluster, CAST(sum(CAST(y AS BIGINT)) AS BIGINT) AS q FROM {_SPOTS} GROUP BY ALL) s ON s.region = r.region AND s.cluster = c.cluster)
      SELECT cluster, region, log2fc, row_number() OVER k AS rank FROM w WINDOW k AS (PARTITION BY cluster ORDER BY log2fc DESC, region) QUALIFY row_number() OVER k <= 5""",
    "x58_annotation": f"""WITH s(kind, gene, sign) AS (VALUES ('commerce', 'purchase', 1), ('commerce', 'signup', 1), ('commerce', 'error', -1), ('browse', 'click', 1), ('browse', 'view', 1), ('browse', 'purchase', -1)),
      t AS (SELECT cell, gene, log2(count(*)) AS fc FROM {_TX} GROUP BY ALL), h AS (SELECT cell, kind, count(*) FILTER (sign > 0) AS hits, coalesce(sum(fc) FILTER (sign > 0), 0) AS pos, coalesce(sum(fc) FILTER (sign < 0), 0) AS neg FROM t JOIN s USING (gene) GROUP BY ALL),
      c AS (SELECT cell, kind, round(pos + 0.35 * hits - 0.65 * neg, 6) AS score FROM h), l AS (SELECT cell, arg_min(kind, (-score, kind)) AS kind, max(score) AS score, CASE WHEN count(*) > 1 THEN max(score) - min(score) ELSE 0 END AS margin FROM c GROUP BY cell)
      SELECT cell, kind, score, round(greatest(0.01, least(0.99, 1 / (1 + exp(-(2.2 * (score / 20) + 3 * least(margin / 20, 0.2) - 0.15))))), 6) AS confidence FROM l""",
    "x60_case_bundle": f"""WITH t AS (SELECT slice, cluster, count(*) AS n FROM {_CELLS} GROUP BY ALL), k AS (SELECT slice, cluster, row_number() OVER (PARTITION BY slice ORDER BY n DESC, cluster) AS r FROM t)
      SELECT slice, CAST(sum(n) AS BIGINT) AS total, any_value(top) AS top FROM t JOIN (SELECT slice, string_agg(cluster, ';' ORDER BY r) AS top FROM k WHERE r <= 3 GROUP BY slice) USING (slice) GROUP BY slice""",
    "z28_drift": f"WITH t AS (SELECT sample, avg(x) AS cx FROM {_SPOTS} GROUP BY sample), s AS (SELECT regr_slope(cx, sample) AS slope FROM t) SELECT sample, round(cx - slope * sample, 4) AS steady_x FROM t, s",
}
