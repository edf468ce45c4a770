"""Profiles of objects: similarities of outlines and surroundings, signatures of genes, scores, colours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Genes of each state; fixed values.
SIGNATURES = {
    "stem_wnt": ("LGR5", "OLFM4", "ASCL2", "SOX9", "RNF43", "SMOC2", "FZD7", "TCF7L2"),
    "proliferation": ("MKI67", "UBE2C", "PCLAF", "STMN1", "TYMS", "TK1", "RRM2", "PBK", "CDC25C"),
    "goblet_secretory": ("MUC2", "ATOH1", "SPDEF", "REG4", "RETNLB", "CLCA1", "CLCA4", "ITLN1"),
    "absorptive_best4": ("BEST4", "AQP8", "OTOP2", "CA1", "CA2", "GUCA2A", "GUCA2B", "MS4A12"),
    "endocrine_tuft": ("CHGA", "CHGB", "INSM1", "PYY", "GCG", "SST", "TPH1", "POU2F3", "TRPM5", "IL17RB"),
    "stromal_niche": ("GREM1", "GREM2", "RSPO3", "WNT2B", "PDGFRA", "FAP", "COL1A1", "COL1A2", "ACTA2", "TAGLN", "VCAN"),
    "myeloid": ("LYZ", "CD68", "C1QA", "C1QB", "C1QC", "CD14", "CD163", "S100A9", "IL1B", "TYROBP"),
    "t_nk": ("PTPRC", "CD3D", "CD3E", "CD3G", "CD4", "CD8A", "CD8B", "NKG7", "GZMA", "GZMK", "TRAC"),
    "b_plasma": ("MS4A1", "CD79A", "CD79B", "BANK1", "POU2AF1", "SDC1", "TNFRSF17"),
    "mast_dc": ("KIT", "CPA3", "CMA1", "MS4A2", "CLEC9A", "IRF8", "LILRA4"),
    "endothelial_perivascular": ("PECAM1", "CD34", "AQP1", "RGS5", "ACTA2", "TAGLN", "PDGFRA"),
}
#: Keywords of label families, the first family that fits; fixed values.
FAMILIES = [
    ("tumor", ["tumor", "adenocarcinoma", "carcinoma", "neuroendocrine"]),
    ("stromal", ["fibro", "endothelial", "pericyte", "stroma", "smooth muscle", "mural"]),
    ("immune", ["t cell", "b cell", "plasma", "macrophage", "monocyte", "mast", "dendritic", "nk"]),
    ("epithelial", ["ciliated", "club", "alveolar", "epithelial", "bronchio"]),
]


def position_similarity(distance: Column, window: float) -> Column:
    """Falls by e over a quarter of the search window."""
    return F.exp(-F.greatest(distance, F.lit(0.0)) / max(window / 4, 1e-12))


def area_similarity(ratio: Column, most: float) -> Column:
    """1 at equal areas, 0 at a ratio of ``most`` or its inverse and beyond."""
    return F.when(ratio > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(F.log(ratio)) / math.log(most)))).otherwise(0.0)


def shape_similarity(compact_a: Column, compact_b: Column, aspect_a: Column, aspect_b: Column) -> Column:
    small = lambda a: F.greatest(a, F.lit(1e-12))
    return 0.6 * F.exp(-F.abs(compact_a - compact_b) / 0.25) + 0.4 * F.exp(-F.abs(F.log(small(aspect_a) / small(aspect_b))))


def surroundings_similarity(a: Column, b: Column) -> Column:
    """Best agreement of two objects' neighbours over all turns of the second's.

    Each is an array of (distance, gap, area) structs in order of angle. With fewer than three neighbours it is 0.
    """
    n = F.least(F.size(a), F.size(b))

    def mean(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / n

    def turned(shift: Column) -> Column:
        other = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(b, F.pmod(i - shift, n)))
        both = F.arrays_zip(F.slice(a, 1, n).alias("p"), other.alias("q"))
        small = lambda v: F.greatest(v, F.lit(1e-9))
        near = F.exp(-mean(F.transform(both, lambda x: F.abs(F.log(small(x["p"]["distance"]) / small(x["q"]["distance"]))))))
        gap = 1 - F.least(F.lit(1.0), mean(F.transform(both, lambda x: F.abs(x["p"]["gap"] - x["q"]["gap"]))) / 0.25)
        area = 1 - F.least(F.lit(1.0), mean(F.transform(both, lambda x: F.abs(x["p"]["area"] - x["q"]["area"]))) / math.log(4.0))
        return 0.45 * near + 0.35 * gap + 0.20 * area

    return F.when(n < 3, 0.0).otherwise(F.array_max(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), turned)))


def surroundings(near: DataFrame, key: str) -> DataFrame:
    """(key, around): neighbours of each object (dx, dy, area ratio) as (distance, gap, area) structs in order of angle, gaps as shares of a turn."""
    angle = F.atan2("dy", "dx")
    each = F.array_sort(F.collect_list(F.struct(angle.alias("angle"), F.hypot("dx", "dy").alias("d"), F.log("ratio").alias("area"))))
    s = near.groupBy(key).agg(each.alias("s"))
    following = lambda i: F.get("s", F.pmod(i + 1, F.size("s")))
    gap = lambda x, i: F.pmod(following(i)["angle"] - x["angle"] + 4 * math.pi, F.lit(2 * math.pi)) / (2 * math.pi)
    return s.select(key, F.transform("s", lambda x, i: F.struct(x["d"].alias("distance"), gap(x, i).alias("gap"), x["area"].alias("area"))).alias("around"))


def rgb(colour: Column) -> Column:
    """(r, g, b) of ``#rrggbb``."""
    at = lambda i: F.conv(F.substring(F.ltrim(colour, F.lit("#")), i, 2), 16, 10).cast("int")
    return F.struct(at(1).alias("r"), at(3).alias("g"), at(5).alias("b"))


def palette_colour(index: Column, palette: list[str]) -> Column:
    """Colour of a number from 1 on, the palette repeating."""
    return F.element_at(F.array(*[F.lit(c) for c in palette]), (F.pmod(index - 1, F.lit(len(palette))) + 1).cast("int"))


def z_spacing(levels: DataFrame, z: str, default: float = 5.0) -> DataFrame:
    """(spacing): the median step between distinct levels, of which there are as many as slices; ``default`` with fewer than two."""
    from pyspark.sql import Window as W

    d = levels.select(z).where(F.col(z).isNotNull()).distinct().withColumn("step", F.col(z) - F.lag(z).over(W.orderBy(z)))
    return d.agg(F.coalesce(F.percentile("step", 0.5), F.lit(default)).alias("spacing"))


def turning_angles(points: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, turn): the turn in degrees at each point of a closed line between the segments before and after it."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(order)  # the points of one outline
    ends = W.partitionBy(key)
    first, last = (f(F.struct("px", "py"), F.col(order)).over(ends) for f in (F.min_by, F.max_by))
    before, after = F.coalesce(F.lag(F.struct("px", "py")).over(w), last), F.coalesce(F.lead(F.struct("px", "py")).over(w), first)
    p = points.withColumns({"_b": before, "_a": after})
    heading = lambda x0, y0, x1, y1: F.atan2(y1 - y0, x1 - x0)
    turn = heading(F.col("px"), F.col("py"), F.col("_a.px"), F.col("_a.py")) - heading(F.col("_b.px"), F.col("_b.py"), F.col("px"), F.col("py"))
    return p.select(key, order, F.degrees(F.pmod(turn + 3 * math.pi, F.lit(2 * math.pi)) - math.pi).alias("turn"))
