"""Decision rules as column expressions. Thresholds are fixed values of the analysis and stand with their rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite, sigmoid


def structure_verdict(di_in: Column, di_tissue: Column, p_tissue: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """(verdict, explained fraction) of a structure from its clustering inside and in the whole tissue."""
    explained = F.when(di_tissue > 0, 1 - F.greatest(di_in, F.lit(0.0)) / di_tissue)
    verdict = F.when((di_tissue <= 0) | (p_tissue > alpha), "FAIL").when(di_in <= 0.10, "PASS").when(di_in <= 0.30, "PARTIAL").otherwise("FAIL")
    return verdict, explained


def cluster_status(di_rl: Column, di_csr: Column, p_rl: Column, p_regular: Column, alpha: float = 0.05) -> Column:
    """How a cluster lies within its structure (D3)."""
    return (
        F.when((di_rl >= 0.30) & (di_csr >= 0.30) & (p_rl <= alpha), "HOTSPOT").when((di_rl >= 0.15) & (p_rl <= alpha), "CLUSTERED")
        .when((di_rl <= -0.15) & (p_regular <= alpha), "DISPERSED").otherwise("RANDOM-LIKE")
    )


def split_level(verdict: Column, single: Column, can_split: Column, top_rl: Column) -> Column:
    """Whether a structure should be split (D2, D4): ``top_rl`` is the index of its strongest hotspot."""
    return (
        F.when(single, "NOT_NEEDED").when((verdict != "PASS") & can_split, "RECOMMENDED").when((verdict == "PASS") & can_split & (top_rl >= 2 * 0.30), "OPTIONAL")
        .when(verdict == "FAIL", "REVIEW").otherwise("NOT_NEEDED")
    )


def instance_flags(n_seeds: Column, ring: Column, n_lumens: Column, area: Column, least_ring: float, least_area: float) -> Column:
    """``;``-joined flags of an instance (D8): no_lumen_seed, weak_ring, merged_candidate, small_fragment."""
    flags = [F.when(n_seeds == 0, "no_lumen_seed"), F.when(ring < least_ring, "weak_ring"), F.when(n_lumens > 1, "merged_candidate"), F.when(area < least_area, "small_fragment")]
    return F.concat_ws(";", *flags)


def label_family(name: Column, families: list[tuple[str, list[str]]], default: str = "other") -> Column:
    """The first family one of whose keywords is in a label, case ignored."""
    out = F.lit(default)
    for family, words in reversed(families):
        found = F.lit(False)
        for w in words:
            found = found | F.lower(name).contains(w)
        out = F.when(found, family).otherwise(out)
    return out


#: Rows from which a coarser mesh is used, and its number of points a side.
MESHES = [(80_000, 450), (40_000, 550), (20_000, 650), (10_000, 800)]


def mesh_size(n: Column, full: int = 1200) -> Column:
    """Points a side of the mesh for ``n`` rows."""
    out = F.lit(full)
    for rows, size in reversed(MESHES):
        out = F.when(n >= rows, size).otherwise(out)
    return out


def lumen_collapse(area: Column) -> Column:
    """1 / ln(1 + area + 1)."""
    return 1 / F.log(2 + F.coalesce(area, F.lit(0.0)))


def seed_guard(accepted: Column, residual: Column, n: Column, rotation: Column, coverage: Column, quadrants: Column, limit: float, least: int) -> Column:
    """The first rule that an alignment fails, or ``ok``."""
    turned = F.abs(rotation) > 15
    return (
        F.when(~accepted, "not_accepted").when(~finite(residual), "residual_missing").when(residual > limit, "residual_high").when(n < least, "too_few_anchors").when(n < 6, "too_few_for_similarity")
        .when(F.abs(rotation) >= 150, "rotation_flip").when(turned & (n < 8), "rotated_few_anchors").when(turned & (residual > 120), "rotated_residual")
        .when(turned & (coverage < 0.05), "rotated_coverage").when(turned & (quadrants < 2), "rotated_quadrants").otherwise("ok")
    )


def wide_area_similarity(ratio: Column) -> Column:
    """1 - |ln r| / ln 10 within a factor of ten, else 0."""
    return F.when((ratio >= 0.1) & (ratio <= 10), 1 - F.abs(F.log(ratio)) / F.log(F.lit(10.0))).otherwise(0.0)


def eligible(n: Column, share: Column) -> Column:
    """Whether a cluster has cells enough to be tested."""
    return (n >= 100) & (share >= 0.01)


def track_quality(n_slices: Column, min_overlap: Column, max_jump: Column, area_cv: Column, n_branches: Column, n_weak: Column, good_overlap: float, jump: float, cv: float) -> Column:
    """good, review or isolated."""
    return (
        F.when(n_slices <= 1, "isolated").when((n_slices <= 2) | (n_branches > 0) | (n_weak > 0), "review")
        .when(finite(min_overlap) & (min_overlap < good_overlap), "review").when(finite(max_jump) & (max_jump > jump), "review")
        .when(finite(area_cv) & (area_cv > cv), "review").otherwise("good")
    )


def track_priority(quality: Column, n_branches: Column, min_overlap: Column, n_slices: Column) -> Column:
    """Order of review, 0 first."""
    review = F.when(n_branches > 0, 0).when(finite(min_overlap) & (min_overlap < 0.05), 1).otherwise(2)
    return F.when(quality == "review", review).when(quality == "isolated", 3).when(n_slices <= 3, 4).otherwise(5)


def motifs(links: DataFrame, family: str, source: str, target: str, kind: str) -> DataFrame:
    """(family, motif) of link families: linear, candidate_split, candidate_merge or complex."""
    out = links.groupBy(family, source).agg(F.countDistinct(target).alias("o")).groupBy(family).agg(F.max("o").alias("most_out"))
    into = links.groupBy(family, target).agg(F.countDistinct(source).alias("i")).groupBy(family).agg(F.max("i").alias("most_in"))
    branched = links.groupBy(family).agg(F.bool_or(F.col(kind) == "candidate_branch_merge").alias("branched"))
    split, merge = F.col("most_out") > 1, F.col("most_in") > 1
    motif = F.when(~F.col("branched"), "linear").when(split & ~merge, "candidate_split").when(merge & ~split, "candidate_merge").otherwise("complex")
    return out.join(into, family).join(branched, family).select(family, motif.alias("motif"))


def family_priority(motif: Column, n_slices: Column, support: Column) -> Column:
    """Review priority of a link family."""
    return F.when((motif != "linear") & ((motif == "complex") | (support >= 0.75)), "high").when(motif != "linear", "medium").when(n_slices < 3, "isolated/review").otherwise("low")


def correspondence_class(score: Column, mutual: Column) -> Column:
    """matched_anchor, matched_review or rejected."""
    return F.when((score >= 0.72) & mutual, "matched_anchor").when((score >= 0.55) & mutual, "matched_review").otherwise("rejected")


def acceptance(mutual: Column, score: Column, distance: Column, overlap: Column, ratio: Column, least_score: float, most_distance: float, least_overlap: float, close: float, ratios: tuple[float, float]) -> Column:
    """Why a pair of contours is taken, or the first rule that it breaks."""
    enough = (overlap >= least_overlap) | ((distance <= close) & ratio.between(*ratios))
    return (
        F.when(~mutual, "not_mutual_best").when(score < least_score, "score_below_threshold").when(distance > most_distance, "centroid_distance_above_threshold")
        .when(enough, "mutual_high_score_local_overlap").otherwise("insufficient_overlap")
    )


def structure_confidence(score: Column, margin: Column) -> Column:
    """Confidence between 0.01 and 0.99."""
    return F.greatest(F.lit(0.01), F.least(F.lit(0.99), sigmoid(2.2 * score + 3 * F.least(margin, F.lit(0.2)) - 0.15)))


def boundary_interaction(receptor: Column, n_cells: Column, ligand: Column, n_ring: Column, density: Column) -> Column:
    """Strength of a ligand-receptor pair across a boundary."""
    return F.log1p(F.coalesce(F.try_divide(receptor, n_cells), F.lit(0.0))) * F.log1p(F.coalesce(F.try_divide(ligand, n_ring), F.lit(0.0))) * F.log1p(density)


def marker_score(hits: Column, log2fc: Column, negative: Column) -> Column:
    """Support of a cell type by its markers."""
    return log2fc + 0.35 * hits - 0.65 * negative
