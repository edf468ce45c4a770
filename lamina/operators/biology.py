"""Biology of instances: which cells they hold and which ring them, their genes, states, axes, entropy and talk across their border.

``regions`` are the instances: region, track, slice, z, ring (corners), cx and cy (the lumen's middle; where null that of the
ring). ``cells`` are cell_id, slice, x, y; ``counts`` are cell_id, gene, n. Instances' cells are assigned once and every
table is an aggregate of the assignment, so a track of any size meets as sums only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import overlay
from .regions import centroid, contains, signed_area

#: Genes of each state; the state that sorts first in the mapping wins ties.
Signatures = dict[str, tuple[str, ...]]


def _box(ring: Column, c: str, reach: float, bin_size: float) -> Column:
    low, high = (f(F.transform(ring, lambda p: p[c])) for f in (F.array_min, F.array_max))
    return F.sequence(F.floor((low - reach) / bin_size).cast("int"), F.floor((high + reach) / bin_size).cast("int"))


def assigned(cells: DataFrame, regions: DataFrame, bin_size: float) -> DataFrame:
    """(cell_id, x, y, slice, z, region, track, radial, longitudinal): each cell in the smallest instance of its slice that holds it.

    ``radial`` is the distance to the lumen over the farthest corner's, at most 1; ``longitudinal`` the place of z between the
    first and the last slice of the track that has cells.
    """
    own = F.col("ring")
    middle = [F.coalesce(c, m) for c, m in zip((F.col("cx"), F.col("cy")), centroid(own), strict=True)]
    r = regions.withColumn("area", F.abs(signed_area(own))).withColumns({"mx": middle[0], "my": middle[1]})
    r = r.withColumn("far", F.greatest(F.array_max(F.transform("ring", lambda p: F.hypot(p["x"] - F.col("mx"), p["y"] - F.col("my")))), F.lit(1e-9)))
    spread = r.withColumn("_bx", F.explode(_box(own, "x", 0.0, bin_size))).withColumn("_by", F.explode(_box(own, "y", 0.0, bin_size)))
    placed = cells.select("cell_id", "slice", "x", "y").withColumns({"_bx": F.floor(F.col("x") / bin_size).cast("int"), "_by": F.floor(F.col("y") / bin_size).cast("int")})
    hit = placed.join(spread, ["slice", "_bx", "_by"]).where(contains(own, F.col("x"), F.col("y")))
    best = hit.groupBy("cell_id").agg(F.min(F.struct("area", "region", "track", "slice", "z", "x", "y", F.least(F.lit(1.0), F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")) / F.col("far")).alias("radial"))).alias("m"))
    rows = best.select("cell_id", *[F.col(f"m.{c}").alias(c) for c in ("x", "y", "slice", "z", "region", "track", "radial")])
    span = rows.groupBy("track").agg(F.min("z").alias("z0"), F.max("z").alias("z1"))
    along = F.coalesce(F.try_divide(F.col("z") - F.col("z0"), F.col("z1") - F.col("z0")), F.lit(0.0))
    return rows.join(span, "track").withColumn("longitudinal", along.cast("double")).drop("z0", "z1")


def ring_cells(cells: DataFrame, regions: DataFrame, inner: float, outer: float, bin_size: float) -> DataFrame:
    """(cell_id, region, track): cells of the slice outside an instance, farther than ``inner`` and within ``outer`` of its outline."""
    own = F.col("ring")
    spread = regions.select("region", "track", "slice", "ring").withColumn("_bx", F.explode(_box(own, "x", outer, bin_size))).withColumn("_by", F.explode(_box(own, "y", outer, bin_size)))
    placed = cells.select("cell_id", "slice", "x", "y").withColumns({"_bx": F.floor(F.col("x") / bin_size).cast("int"), "_by": F.floor(F.col("y") / bin_size).cast("int")})
    met = placed.join(spread, ["slice", "_bx", "_by"]).withColumn("_d", overlay.ring_distance(own, F.col("x"), F.col("y")))
    return met.where((F.col("_d") > inner) & (F.col("_d") <= outer) & ~contains(own, F.col("x"), F.col("y"))).select("cell_id", "region", "track")


def gene_counts(rows: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """(key, gene, n) of the molecules of the cells in ``rows``, which may name a cell several times."""
    return rows.select("cell_id", key).join(counts, "cell_id").groupBy(key, "gene").agg(F.sum("n").alias("n"))


def signature_sums(signatures: Signatures, gene: Column, n: Column) -> list[Column]:
    """Aggregates score_<signature>: molecules of its genes."""
    return [F.sum(F.when(gene.isin(*genes), n).otherwise(0)).alias(f"score_{s}") for s, genes in signatures.items()]


def cell_states(rows: DataFrame, counts: DataFrame, signatures: Signatures) -> DataFrame:
    """``rows`` with score_<signature> and ``state``, the signature of most molecules, "unresolved" without any."""
    scores = rows.select("cell_id").distinct().join(counts, "cell_id").groupBy("cell_id").agg(*signature_sums(signatures, F.col("gene"), F.col("n")))
    names = [f"score_{s}" for s in signatures]
    full = rows.join(scores, "cell_id", "left").fillna(0, names)
    top = F.greatest(F.lit(0), *names)
    state = F.coalesce(*[F.when((F.col(f"score_{s}") == top) & (top > 0), F.lit(s)) for s in signatures], F.lit("unresolved"))
    return full.withColumn("state", state)


def entropy(states: DataFrame) -> DataFrame:
    """(track, n_cells, state_entropy, dominant_state, dominant_fraction, radial_variance): how mixed the states of a track are; of equal counts the state that sorts first is dominant."""
    n = states.groupBy("track", "state").agg(F.count("*").alias("n"))
    total = n.groupBy("track").agg(F.sum("n").alias("total"), F.max_by("state", F.struct("n", F.expr("transform(split(state, ''), c -> -ascii(c))"))).alias("dominant_state"), F.max("n").alias("most"))
    p = F.col("n") / F.col("total")
    mixed = n.join(total.select("track", "total"), "track").groupBy("track").agg(F.sum(-p * F.log2(p)).alias("state_entropy"))
    spread = states.groupBy("track").agg(F.coalesce(F.var_samp("radial"), F.lit(0.0)).alias("radial_variance"))
    return total.join(mixed, "track").join(spread, "track").select("track", F.col("total").alias("n_cells"), "state_entropy", "dominant_state", (F.col("most") / F.col("total")).alias("dominant_fraction"), "radial_variance")


def axis_distortion(states: DataFrame, signatures: list[str], distorting: tuple[str, str]) -> DataFrame:
    """(track, n_cells, <signature>_radial, _along, _spread, _apical, distortion): where along its axes a track has its molecules.

    ``distortion`` is the mean of the spread of both ``distorting`` signatures and the apical share of the second; what is undefined is left out.
    """
    along = F.col("longitudinal")
    aggs = [F.count("*").alias("n_cells")]
    for s in signatures:
        w = F.col(f"score_{s}").cast("double")
        for name, v in (("w", w), ("r", w * F.col("radial")), ("a", w * along), ("q", w * along * along), ("t", F.when(along >= 0.75, w).otherwise(0.0))):
            aggs.append(F.sum(v).alias(f"_{name}_{s}"))
    g = states.groupBy("track").agg(*aggs)
    out = {}
    for s in signatures:
        mean = lambda c, s=s: F.try_divide(F.col(f"_{c}_{s}"), F.col(f"_w_{s}"))
        out |= {f"{s}_radial": mean("r"), f"{s}_along": mean("a"), f"{s}_spread": F.sqrt(F.greatest(mean("q") - mean("a") * mean("a"), F.when(mean("q").isNotNull(), 0.0))), f"{s}_apical": mean("t")}
    g = g.withColumns(out).select("track", "n_cells", *out)
    used = F.array_compact(F.array(f"{distorting[0]}_spread", f"{distorting[1]}_spread", f"{distorting[1]}_apical"))
    return g.withColumn("distortion", F.try_divide(F.aggregate(used, F.lit(0.0), lambda s, v: s + v), F.size(used)))


def microenvironment(regions: DataFrame, rows: DataFrame, rings: DataFrame, counts: DataFrame, signatures: Signatures) -> DataFrame:
    """(region, track, n_inside, n_ring, inside_<signature>, ring_<signature>) of each instance: what it holds and what surrounds it."""
    out = regions.select("region", "track")
    for name, some in (("inside", rows), ("ring", rings)):
        n = some.groupBy("region").agg(F.count("*").alias(f"n_{name}"))
        sums = gene_counts(some, counts, "region").groupBy("region").agg(*signature_sums(signatures, F.col("gene"), F.col("n")))
        out = out.join(n, "region", "left").join(sums.withColumnsRenamed({f"score_{s}": f"{name}_{s}" for s in signatures}), "region", "left")
    return out.fillna(0)


def communication(regions: DataFrame, rows: DataFrame, rings: DataFrame, counts: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(track, ligand, receptor, n_regions, mean_score, max_score): ln(1 + receptor a cell inside) * ln(1 + ligand a cell of the ring) * ln(1 + ring cells a cell inside), over a track's instances."""
    sizes = [some.groupBy("region").agg(F.count("*").alias(f"n_{name}")) for name, some in (("in", rows), ("ring", rings))]
    genes = [gene_counts(some, counts, "region") for some in (rows, rings)]
    base = regions.select("region", "track").join(sizes[0], "region", "left").join(sizes[1], "region", "left").fillna(0)
    table = F.array(*[F.struct(F.lit(a).alias("ligand"), F.lit(b).alias("receptor")) for a, b in pairs])
    each = base.withColumn("p", F.explode(table)).select("region", "track", "n_in", "n_ring", "p.ligand", "p.receptor")
    each = each.join(genes[0].withColumnsRenamed({"gene": "receptor", "n": "taken"}), ["region", "receptor"], "left").join(genes[1].withColumnsRenamed({"gene": "ligand", "n": "sent"}), ["region", "ligand"], "left").fillna(0, ["taken", "sent"])
    inside = F.greatest("n_in", F.lit(1))
    score = F.log1p(F.col("taken") / inside) * F.log1p(F.col("sent") / F.greatest("n_ring", F.lit(1))) * F.log1p(F.col("n_ring") / inside)
    return each.groupBy("track", "ligand", "receptor").agg(F.count("*").alias("n_regions"), F.avg(score).alias("mean_score"), F.max(score).alias("max_score"))


def features(tracks: DataFrame, rows: DataFrame, counts: DataFrame, states: DataFrame, signatures: Signatures, least_slices: int = 3, most_branches: int = 0) -> DataFrame:
    """A row for each track (track, n_slices, n_branches, median_area): molecules a cell by gene set, entropy, and the scores made of them."""
    n = rows.groupBy("track").agg(F.count("*").alias("n_cells"))
    sums = gene_counts(rows, counts, "track").groupBy("track").agg(*signature_sums(signatures, F.col("gene"), F.col("n")))
    f = tracks.join(n, "track", "left").join(sums, "track", "left").join(entropy(states).select("track", "state_entropy"), "track", "left")
    f = f.fillna(0, ["n_cells", *[f"score_{s}" for s in signatures]]).fillna(0.0, ["state_entropy"])
    per_cell = [F.coalesce(F.try_divide(F.col(f"score_{s}"), F.col("n_cells")), F.lit(0.0)).alias(f"signature_{s}") for s in signatures]
    sure = (F.col("n_slices") >= least_slices) & (F.col("n_branches") <= most_branches)
    return f.select(
        "track", "n_slices", "n_branches", "n_cells", *per_cell, "state_entropy", sure.alias("high_confidence"), (F.col("n_branches") / F.greatest("n_slices", F.lit(1))).alias("fission_score"),
        (1 / F.log1p(F.greatest("median_area", F.lit(0.0)) + 1)).alias("lumen_collapse"),
    )
