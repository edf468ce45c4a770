"""Quality of a structure partition: spatial concentration of structures in the tissue and of clusters in their structure.

All tests, of structures and of clusters, in the tissue and in a structure's own bins, against uniform patterns and
against random labelling, run as one table of tests (see :mod:`.patterns`). Only results, one row for each test, are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Axis, nearest
from ..functions.quantiles import quantiles
from .decisions import cluster_status, eligible, split_level, structure_verdict
from .patterns import pattern_tests

#: A cluster that lies nearer its structure's border than this share of the structure's median is at its edge.
EDGE_RATIO = 0.60


def tested_clusters(cells: DataFrame) -> DataFrame:
    """(structure_id, cluster, n, share, tested) of the clusters of each structure."""
    n = cells.where("structure_id > 0").groupBy("structure_id", "cluster").agg(F.count("*").alias("n"))
    total = n.groupBy("structure_id").agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return n.join(total, "structure_id").select("structure_id", "cluster", "n", F.round(share, 6).alias("share"), eligible(F.col("n"), share).alias("tested"))


def structure_tests(cells: DataFrame, bins: DataFrame, x: Axis, y: Axis, radii: list[float], n_sim: int = 49, max_points: int = 20_000, band: tuple[float, float] | None = None) -> DataFrame:
    """(scope, structure_id, cluster, null, n_cells, n_used, area, di, p_clustered, p_regular, ce, p_ce).

    ``cells`` has cell_id, x, y, cluster, structure_id and bin_structure; ``bins`` has ix, iy and bin_structure. Scopes:
    ``tissue`` and ``structure`` hold a structure's cells inside its own bins, ``cluster`` an eligible cluster's cells
    there, ``original`` all cells of a cluster over the tissue. The null is ``csr`` or, for clusters, ``rl`` too.
    """
    home = cells.where("structure_id > 0")
    inside = home.where("structure_id = bin_structure")
    tested = tested_clusters(inside).where("tested").select("structure_id", "cluster")
    whole = inside.select("cell_id", "x", "y", "structure_id", F.lit(None).cast("string").alias("cluster"))
    own = inside.select("cell_id", "x", "y", "structure_id", "cluster").join(F.broadcast(tested), ["structure_id", "cluster"], "left_semi").select(whole.columns)
    first = home.select("cell_id", "x", "y", "structure_id", "cluster")

    def scoped(rows: DataFrame, scope: str, window, null: str) -> DataFrame:
        return rows.withColumns({"scope": F.lit(scope), "null": F.lit(null), "window": window.cast("string")})

    at = F.col("structure_id")
    rows = scoped(whole, "tissue", F.lit("tissue"), "csr").unionByName(scoped(whole, "structure", at, "csr")).unionByName(scoped(first, "original", F.lit("tissue"), "csr"))
    rows = rows.unionByName(scoped(own, "cluster", at, "csr")).unionByName(scoped(own, "cluster", at, "rl"))
    rows = rows.withColumn("key", F.concat_ws("|", "scope", "null", F.col("structure_id").cast("string"), "cluster"))
    tests = rows.groupBy("key", "scope", "null", "window", "structure_id").agg(F.first("cluster").alias("cluster"))
    asked = tests.select("key", "window", F.when(F.col("null") == "rl", F.col("structure_id").cast("string")).alias("pool"))
    windows = bins.where("bin_structure > 0")
    windows = windows.select(F.lit("tissue").alias("window"), "ix", "iy").unionByName(windows.select(F.col("bin_structure").cast("string").alias("window"), "ix", "iy"))
    pools = inside.select(F.col("structure_id").cast("string").alias("pool"), F.col("cell_id").alias("id"), "x", "y")
    found = pattern_tests(rows.select("key", F.col("cell_id").alias("id"), "x", "y"), asked, windows, x, y, radii, n_sim, max_points, pools, band=band)
    return tests.drop("window").join(found, "key").drop("key")


def border_distances(bins: DataFrame, x: Axis, y: Axis) -> DataFrame:
    """(ix, iy, depth): how far a structure's bin lies from the nearest bin that isn't of its structure; bins beyond the raster count as such."""
    grid = bins.where("bin_structure > 0").select("ix", "iy", F.col("bin_structure").alias("s"))
    step = [F.struct((F.col("ix") + dx).alias("ix"), (F.col("iy") + dy).alias("iy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    # Only bins beside a structure, in or out of the raster, can be the nearest one of another kind.
    beside = grid.select("s", F.explode(F.array(*step)).alias("n")).select("s", "n.ix", "n.iy").distinct()
    other = beside.join(grid, ["s", "ix", "iy"], "left_anti")
    place = lambda t: t.select("s", F.concat_ws(":", "s", "ix", "iy").alias("id"), (F.col("ix") * x.step).alias("x"), (F.col("iy") * y.step).alias("y"), "ix", "iy")
    # Structures are set apart along x, so that one join serves them all.
    apart = lambda t: t.withColumn("x", F.col("x") + F.col("s") * (4 * (x.high - x.low) + 1))
    a, b = apart(place(grid)), apart(place(other))
    limit = ((x.high - x.low) ** 2 + (y.high - y.low) ** 2) ** 0.5 + x.step + y.step
    near = nearest(a, b.drop("ix", "iy", "s"), "id", "id", 2 * max(x.step, y.step), limit)
    return a.select("id", "ix", "iy").join(near, "id").select("ix", "iy", F.sqrt("d2").alias("depth"))


def cluster_quality(cells: DataFrame, bins: DataFrame, x: Axis, y: Axis, found: DataFrame) -> DataFrame:
    """(structure_id, cluster, di_csr, p_csr, di_rl, p_rl, status, edge_ratio, at_edge, role) of each eligible cluster."""
    c = found.where("scope = 'cluster'").groupBy("structure_id", "cluster").agg(
        *[F.max(F.when(F.col("null") == n, F.col(v))).alias(f"{a}_{n}") for n in ("csr", "rl") for v, a in (("di", "di"), ("p_clustered", "p"))],
        F.max(F.when(F.col("null") == "rl", F.col("p_regular"))).alias("p_regular"),
    )
    placed = cells.where("structure_id > 0 and structure_id = bin_structure").withColumns({"ix": x.clipped("x"), "iy": y.clipped("y")})
    deep = placed.join(border_distances(bins, x, y), ["ix", "iy"])
    by_cluster = quantiles(deep, ["structure_id", "cluster"], ["depth"], [0.5]).select("structure_id", "cluster", F.col("depth")[0].alias("own_depth"))
    by_structure = quantiles(deep, ["structure_id"], ["depth"], [0.5]).select("structure_id", F.col("depth")[0].alias("all_depth"))
    status = cluster_status(F.col("di_rl"), F.col("di_csr"), F.col("p_rl"), F.col("p_regular"))
    joined = c.join(by_cluster, ["structure_id", "cluster"]).join(by_structure, "structure_id").withColumn("edge_ratio", F.try_divide("own_depth", "all_depth"))
    return joined.select(
        "structure_id", "cluster", "di_csr", "p_csr", "di_rl", "p_rl", status.alias("status"), "edge_ratio", (F.col("edge_ratio") < EDGE_RATIO).alias("at_edge"),
        F.when(status == "HOTSPOT", "SUBDOMAIN").otherwise("").alias("role"),
    )


def before_after(found: DataFrame) -> DataFrame:
    """(structure_id, cluster, di_original, di_final, d_di): a cluster over the whole tissue and within its structure."""
    a = found.where("scope = 'original'").select("structure_id", "cluster", F.col("di").alias("di_original"), F.col("p_clustered").alias("p_original"))
    b = found.where("scope = 'cluster' and null = 'csr'").select("structure_id", "cluster", F.col("di").alias("di_final"))
    return a.join(b, ["structure_id", "cluster"], "left").withColumn("d_di", F.col("di_original") - F.col("di_final"))


def structure_quality(found: DataFrame, clusters: DataFrame, members: DataFrame) -> DataFrame:
    """(structure_id, n_cells, n_used, di_in, di_tissue, p_tissue, verdict, explained, n_hotspots, split) of each structure.

    ``found`` comes from :func:`structure_tests`, ``clusters`` from :func:`cluster_quality`, ``members`` has the clusters of each structure.
    """
    inner = found.where("scope = 'structure'").select("structure_id", F.col("di").alias("di_in"))
    outer = found.where("scope = 'tissue'").select("structure_id", "n_cells", "n_used", F.col("di").alias("di_tissue"), F.col("p_clustered").alias("p_tissue"))
    hot = clusters.groupBy("structure_id").agg(F.count_if(F.col("role") == "SUBDOMAIN").alias("n_hotspots"), F.max(F.when(F.col("role") == "SUBDOMAIN", F.col("di_rl"))).alias("top_rl"))
    size = members.groupBy("structure_id").agg(F.countDistinct("cluster").alias("n_members"))
    j = outer.join(inner, "structure_id").join(size, "structure_id").join(hot, "structure_id", "left").withColumn("n_hotspots", F.coalesce("n_hotspots", F.lit(0)))
    verdict, explained = structure_verdict(F.col("di_in"), F.col("di_tissue"), F.col("p_tissue"))
    single = F.col("n_members") == 1
    verdict = F.when(single, "PASS").otherwise(verdict)
    can_split = ~single & (F.col("n_hotspots") > 0) & (F.col("n_hotspots") < F.col("n_members"))
    level = split_level(verdict, single, can_split, F.col("top_rl"))
    return j.select("structure_id", "n_cells", "n_used", "di_in", "di_tissue", "p_tissue", verdict.alias("verdict"), explained.alias("explained"), "n_hotspots", level.alias("split"))
