"""Queries over label trees and the splits they guide, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grid import Axis
from ..operators import autosplit, fields, latent, structure
from ..sources import tables
from ..sources.scratch import materialize
from .structures import _MATRIX

X, Y = Axis(0.0, 5000.0, 40), Axis(0.0, 3000.0, 30)
RADII = [50.0, 100.0, 150.0]


def _points_matrix(spark, sf):
    return structure.centroid_matrix(tables.points(spark, sf), "xyz")


def x2_cophenetic(spark, sf):
    return latent.cophenetic_matrix(_points_matrix(spark, sf), "single").select("a", "b", F.round("distance", 6).alias("distance"))


def x8_tree(spark, sf):
    """Branch points of the tree of the points' labels."""
    root = autosplit.tree_of(latent.cophenetic_matrix(_points_matrix(spark, sf)))
    rows = [(b.name, round(b.height, 6), len(b.leaves), ",".join(sorted(b.leaves)), " | ".join(",".join(sorted(c.leaves)) for c in b.children)) for b in root.inner()]
    return spark.createDataFrame(rows, "branch string, height double, n_labels int, labels string, children string")


def x3_group_count(spark, sf):
    s = latent.count_scores(_points_matrix(spark, sf))
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("silhouette", "separation", "balance", "score")])


def x4_balanced_groups(spark, sf):
    return latent.balanced_groups(_points_matrix(spark, sf), 4)


def x9_hotspot_groups(spark, sf):
    """Labels with more points than the mean are taken as hotspots; the tree is cut until no branch mixes both kinds."""
    n = tables.points(spark, sf).groupBy("cluster").agg(F.count("*").alias("n"))
    hot = {r.cluster for r in n.crossJoin(F.broadcast(n.agg(F.avg("n").alias("mean")))).where("n > mean").collect()}
    root = autosplit.tree_of(latent.cophenetic_matrix(_points_matrix(spark, sf)))
    rows = [(name, ",".join(sorted(labels)), None if h is None else round(h, 6)) for name, labels, h in autosplit.hotspot_groups(root, "S", hot)]
    return spark.createDataFrame(rows, "name string, labels string, height double")


def _cells(spark, sf):
    return tables.cells(spark, sf).select("cell_id", "x", "y", "cluster")


def _partition(cells):
    """Bins of the groups of clusters by smoothed density, each group being a structure."""

    def run(groups):
        spec = [(i, f"S{i}", c) for i, g in enumerate(groups, 1) for c in g]
        return fields.partition(structure.assign_structure(cells, spec), X, Y, 1.5, 0.05)

    return run


def _explored(spark, sf):
    cells = _cells(spark, sf)
    root = autosplit.tree_of(latent.cophenetic_matrix(structure.centroid_matrix(cells)))
    return cells, autosplit.explore(cells, root, _partition(cells), X, Y, RADII)


def x21_explore(spark, sf):
    found = _explored(spark, sf)[1]
    return found.branches(spark).select("branch", "step", F.round("height", 6).alias("height"), "labels", *[F.round(c, 6).alias(c) for c in ("before", "after", "gain")], "place")


def x22_cut(spark, sf):
    cells, found = _explored(spark, sf)
    groups, _ = autosplit.by_count(found, 3)
    out = autosplit.cut_tree(cells, found, groups, _partition(cells), X, Y, RADII)
    return out.select("structure", "source", "kind", "label", *[F.round(c, 6).alias(c) for c in ("before", "after", "gain", "share_inside")])


NAMES = "x2_cophenetic x8_tree x3_group_count x4_balanced_groups x9_hotspot_groups x21_explore x22_cut".split()
QUERIES = {n: globals()[n] for n in NAMES}
ORACLE_SQL = {
    # The single-linkage height of two labels is the least, over chains between them, of the longest step.
    "x2_cophenetic": f"""WITH RECURSIVE {_MATRIX}, r(a, b, h, k) AS (
        SELECT a, b, distance, 0 FROM m UNION ALL
        SELECT a, b, h, k FROM (SELECT r.a, m.b, min(greatest(r.h, m.distance)) AS h, max(r.k) + 1 AS k FROM r JOIN m ON r.b = m.a WHERE r.k < 10 GROUP BY r.a, m.b))
      SELECT a, b, round(min(h), 6) AS distance FROM r GROUP BY a, b""",
}
