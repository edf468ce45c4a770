"""Objects followed through slices: overlap links, scores, reciprocal matches, chains and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import natural_key
from ..functions.grid import within
from ..functions.quantiles import quantiles
from ..sources.scratch import materialize
from .decisions import track_priority, track_quality
from .matching import components, mutual_best


def boxes(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Middle half of each object's cells as a box with area and centre."""
    n = cells.groupBy(*keys).agg(F.count("*").alias("n"))
    t = quantiles(cells.select(*keys, "x", "y"), keys, ["x", "y"], [0.25, 0.75]).withColumnsRenamed({"x": "qx", "y": "qy"}).join(n, keys)
    t = t.select(*keys, "n", *[F.col(f"q{c}")[i].alias(f"{c}{i}") for c in "xy" for i in (0, 1)])
    return t.withColumns({"area": (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), "cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2}).where("area > 0")


def links(objects: DataFrame, slice_no: str, key: str, group: str, reach: float, max_ratio: float, bin_size: float | None = None) -> DataFrame:
    """Candidate links of objects of one group in neighbouring slices, with overlap and score.

    Weights: half overlap (intersection over union), three tenths centre distance, a fifth area ratio.
    """
    names = ["x0", "x1", "y0", "y1", "area", "cx", "cy"]
    a = objects.select(group, F.col(key).alias("source"), (F.col(slice_no) + 1).alias("_s"), *[F.col(c).alias(f"a_{c}") for c in names])
    b = objects.select(group, F.col(key).alias("target"), F.col(slice_no).alias("_s"), *[F.col(c).alias(f"b_{c}") for c in names])
    side = lambda c: F.greatest(F.least(f"a_{c}1", f"b_{c}1") - F.greatest(f"a_{c}0", f"b_{c}0"), F.lit(0.0))
    # Boxes that may link, the first widened by the reach, meet in the bins they touch; a pair counts in the bin of the upper of its lower corners.
    size = bin_size or 8 * reach
    cover = lambda n, by: {f"_b{c}": F.explode(F.sequence(F.floor((F.col(f"{n}_{c}0") - by) / size), F.floor((F.col(f"{n}_{c}1") + by) / size))) for c in "xy"}
    for c in "xy":
        a, b = a.withColumn(f"_b{c}", cover("a", reach)[f"_b{c}"]), b.withColumn(f"_b{c}", cover("b", 0.0)[f"_b{c}"])
    met = a.join(b, [group, "_s", "_bx", "_by"])
    for c in "xy":
        met = met.where(F.col(f"_b{c}") == F.floor(F.greatest(F.col(f"a_{c}0") - reach, F.col(f"b_{c}0")) / size))
    inter = side("x") * side("y")
    met = met.withColumn("iou", inter / (F.col("a_area") + F.col("b_area") - inter)).withColumn("distance", F.hypot(F.col("a_cx") - F.col("b_cx"), F.col("a_cy") - F.col("b_cy")))
    met = met.withColumn("ratio", F.greatest("a_area", "b_area") / F.least("a_area", "b_area")).where(((F.col("iou") >= 0.1) | (F.col("distance") <= reach)) & (F.col("ratio") <= max_ratio))
    score = 0.5 * F.col("iou") + 0.3 * F.greatest(1 - F.col("distance") / reach, F.lit(0.0)) + 0.2 / F.col("ratio")
    return met.select("source", "target", F.round("iou", 6).alias("iou"), F.round(score, 6).alias("score"))


def chains(objects: DataFrame, accepted: DataFrame, key: str, slice_no: str) -> DataFrame:
    """(track, n_slices, first_slice, last_slice, mean_area): objects joined by accepted links."""
    return track_of(objects, accepted, key).groupBy("track").agg(F.countDistinct(slice_no).alias("n_slices"), F.min(slice_no).alias("first_slice"), F.max(slice_no).alias("last_slice"), F.round(F.avg("area"), 2).alias("mean_area"))


def track(objects: DataFrame, slice_no: str, key: str, group: str, reach: float, max_ratio: float) -> DataFrame:
    objects = materialize(objects)
    found = materialize(links(objects, slice_no, key, group, reach, max_ratio))
    return chains(objects, mutual_best(found, "source", "target", "score"), key, slice_no)


def track_table(objects: DataFrame, found: DataFrame, slice_no: str, key: str, weak: float = 0.2) -> DataFrame:
    """(track, n_slices, first_slice, min_iou, max_jump, area_cv, n_branches, n_weak, quality, priority) of tracks.

    ``found`` are candidate links; those that are each other's best make the tracks, and others that touch a track's
    objects are its branches.
    """
    objects, found = materialize(objects), materialize(found)
    best = materialize(mutual_best(found, "source", "target", "score"))
    of = materialize(track_of(objects, best, key))
    at = of.select(F.col(key).alias("k"), "track", "cx", "cy")
    linked = best.join(at.withColumnsRenamed({"k": "source", "cx": "ax", "cy": "ay"}), "source").join(at.select(F.col("k").alias("target"), F.col("cx").alias("bx"), F.col("cy").alias("by")), "target")
    steps = linked.groupBy("track").agg(F.min("iou").alias("min_iou"), F.max(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))).alias("max_jump"), F.count_if(F.col("score") < weak).alias("n_weak"))
    others = found.join(best.select("source", "target"), ["source", "target"], "left_anti")
    branches = others.join(at.select(F.col("k").alias("source"), "track"), "source").groupBy("track").agg(F.count("*").alias("n_branches"))
    size = of.groupBy("track").agg(F.countDistinct(slice_no).alias("n_slices"), F.min(slice_no).alias("first_slice"), F.try_divide(F.stddev_pop("area"), F.avg("area")).alias("area_cv"))
    t = size.join(steps, "track", "left").join(branches, "track", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_branches", "n_weak")})
    quality = track_quality(F.col("n_slices"), F.col("min_iou"), F.col("max_jump"), F.col("area_cv"), F.lit(0), F.col("n_weak"), 0.1, 100.0, 0.35)
    t = t.withColumn("quality", quality)
    return t.withColumn("priority", track_priority(F.col("quality"), F.lit(0), F.col("min_iou"), F.col("n_slices")))


def track_of(objects: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """``objects`` with the track that accepted links put them in, named by its first object."""
    joined = components(accepted, "source", "target")
    return objects.join(joined, objects[key] == joined["node"], "left").withColumn("track", F.coalesce("component", F.col(key))).drop("node", "component")


def families(objects: DataFrame, found: DataFrame, slice_no: str, key: str, least: float) -> DataFrame:
    """(family, n_members, members, n_slices, n_events, event): tracks that strong links beyond the best ones join, and how they branch.

    Members are listed in natural order.
    """
    objects, found = materialize(objects), materialize(found)
    best = materialize(mutual_best(found, "source", "target", "score"))
    of = materialize(track_of(objects, best, key))
    at = of.select(F.col(key).alias("k"), "track")
    cross = found.where(F.col("score") >= least).join(best.select("source", "target"), ["source", "target"], "left_anti")
    cross = cross.join(at.withColumnsRenamed({"k": "source", "track": "a"}), "source").join(at.withColumnsRenamed({"k": "target", "track": "b"}), "target").where("a <> b").select("a", "b", "source", "target")
    cross = materialize(cross)
    joined = components(cross.select("a", "b"), "a", "b").withColumnsRenamed({"node": "track", "component": "family"})
    full = of.join(joined, "track", "left").withColumn("family", F.coalesce("family", "track"))
    index = full.groupBy("family").agg(F.collect_set("track").alias("m"), F.countDistinct(slice_no).alias("n_slices"))
    named = F.array_join(F.transform(F.array_sort(F.transform("m", lambda t: F.struct(natural_key(t).alias("o"), t.alias("t")))), lambda s: s["t"]), ";")
    events = cross.join(joined.withColumnRenamed("track", "a"), "a")
    splits = events.groupBy("family", "source").agg(F.count("*").alias("n")).groupBy("family").agg(F.max("n").alias("most_out"))
    merges = events.groupBy("family", "target").agg(F.count("*").alias("n")).groupBy("family").agg(F.max("n").alias("most_in"))
    n = events.groupBy("family").agg(F.count("*").alias("n_events"))
    split, merge = F.col("most_out") > 1, F.col("most_in") > 1
    event = F.when(F.col("n_events").isNull(), "none").when(split & merge, "complex").when(split, "candidate_split").when(merge, "candidate_merge").otherwise("candidate_branch")
    j = index.join(n, "family", "left").join(splits, "family", "left").join(merges, "family", "left")
    return j.select("family", F.size("m").cast("bigint").alias("n_members"), named.alias("members"), "n_slices", F.coalesce("n_events", F.lit(0)).alias("n_events"), event.alias("event"))


def instance_links(instances: DataFrame, bins: DataFrame, slice_no: str, group: str, reach: float, ratios: tuple[float, float], least_overlap: float = 0.1, lumen_weight: float = 0.4, marker_weight: float = 0.3) -> DataFrame:
    """(source, target, score, iou, distance, ratio, lumen_distance, marker_similarity) of instances of one group in neighbouring slices.

    ``instances`` has id, cx, cy, area, lumen_cx, lumen_cy and profile (an array of marker counts), ``bins`` the rasters (id,
    slice, group, ix, iy), so overlaps are those of the shapes themselves. Pairs share a bin or are within ``reach``; what
    the lumens and the marker profiles leave of the score is half overlap, three tenths distance, a fifth area ratio.
    Instances without a lumen are compared by their centres, and profiles of nothing by 0.
    """
    a, b = (bins.select("id", group, (F.col(slice_no) + k).alias("_s"), "ix", "iy") for k in (1, 0))
    shared = a.withColumnRenamed("id", "source").join(b.withColumnRenamed("id", "target"), [group, "_s", "ix", "iy"]).groupBy("source", "target").agg(F.count("*").alias("shared"))
    size = bins.groupBy("id").agg(F.count("*").alias("n"))
    own = instances.select("id", group, F.col(slice_no).alias("_s"), "cx", "cy", "area", F.coalesce("lumen_cx", "cx").alias("lx"), F.coalesce("lumen_cy", "cy").alias("ly"), F.col("lumen_cx").isNotNull().alias("hollow"), "profile").join(size, "id")
    at = lambda k: own.select("id", group, (F.col("_s") + k).alias("_s"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    close = within(at(1), at(0), reach, keys=(group, "_s")).select(F.col("l_id").alias("source"), F.col("r_id").alias("target"))
    pairs = shared.select("source", "target").union(close).distinct().join(shared, ["source", "target"], "left").fillna(0, ["shared"])
    p, q = (own.select(*[F.col(c).alias(f"{n}_{c}") for c in ("id", "cx", "cy", "area", "lx", "ly", "hollow", "profile", "n")]) for n in "pq")
    m = pairs.join(p.withColumnRenamed("p_id", "source"), "source").join(q.withColumnRenamed("q_id", "target"), "target")
    d = lambda x, y: F.hypot(F.col(f"p_{x}") - F.col(f"q_{x}"), F.col(f"p_{y}") - F.col(f"q_{y}"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with("p_profile", "q_profile", lambda s, t: s.cast("double") * t))
    norm = lambda c: F.sqrt(total(F.transform(c, lambda x: x.cast("double") * x)))
    m = m.withColumns({
        "iou": F.col("shared") / (F.col("p_n") + F.col("q_n") - F.col("shared")), "distance": d("cx", "cy"), "ratio": F.greatest("p_area", "q_area") / F.greatest(F.least("p_area", "q_area"), F.lit(1e-9)),
        "lumen_distance": F.when(F.col("p_hollow") & F.col("q_hollow"), d("lx", "ly")).otherwise(d("cx", "cy")), "marker_similarity": F.coalesce(F.try_divide(dot, norm("p_profile") * norm("q_profile")), F.lit(0.0)),
    }).where(((F.col("iou") >= least_overlap) | (F.col("distance") <= reach)) & (F.col("ratio") >= ratios[0]) & (F.col("ratio") <= ratios[1]))
    near = lambda c: F.greatest(F.lit(0.0), 1 - F.col(c) / max(reach, 1e-9))
    rest = max(0.0, 1 - lumen_weight - marker_weight)
    score = rest * (0.5 * F.col("iou") + 0.3 * near("distance") + 0.2 / F.col("ratio")) + lumen_weight * near("lumen_distance") + marker_weight * F.col("marker_similarity")
    return m.select("source", "target", F.round(score, 9).alias("score"), "iou", "distance", "ratio", "lumen_distance", "marker_similarity")
