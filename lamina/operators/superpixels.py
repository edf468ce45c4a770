"""Superpixels of an image table, their features, and components of like ones.

An image is a table (ix, iy, r, g, b) of its pixels, channels from 0 to 255. A pixel is offered only the seeds of its own
and the eight neighbouring cells of the seed grid, so a round is one join of bounded fan-out and one sum for each seed.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from . import tiles

#: Light absorbed by haematoxylin, eosin and DAB in red, green and blue; fixed values.
STAINS = [[0.65, 0.70, 0.29], [0.07, 0.99, 0.11], [0.27, 0.57, 0.78]]
#: Weights of red, green and blue in grey; fixed values.
GREY = (0.2125, 0.7154, 0.0721)
FEATURES = ["red", "green", "blue", "haematoxylin", "eosin", "dab", "density", "edge", "across", "down"]


def _inverse(m: list[list[float]]) -> list[list[float]]:
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return [[x / det for x in row] for row in ([e * i - f * h, c * h - b * i, b * f - c * e], [f * g - d * i, a * i - c * g, c * d - a * f], [d * h - e * g, b * g - a * h, a * e - b * d])]


def stains(r: Column, g: Column, b: Column) -> list[Column]:
    """Amounts of haematoxylin, eosin and DAB that give a colour (channels from 0 to 1)."""
    dark = [F.log(F.greatest(c, F.lit(1e-6))) / F.log(F.lit(1e-6)) for c in (r, g, b)]
    return [F.greatest(F.lit(0.0), sum(d * row[k] for d, row in zip(dark, _inverse(STAINS), strict=True))) for k in range(3)]


def edges(image: DataFrame, value: str, nx: int, ny: int) -> DataFrame:
    """(ix, iy, edge): strength of the gradient by 3 x 3 differences; beyond its border the image is mirrored.

    Every pixel gives its value to those that read it, and sums meet by pixel.
    """
    def readers(c: str, n: int) -> Column:
        own = [(F.col(c) - k, k) for k in (-1, 0, 1)]
        images = [F.struct(o.cast("int").alias("o"), F.lit(k).alias("k")) for o, k in own]
        images += [F.struct(F.when(F.col(c) == 0, 0).alias("o"), F.lit(-1).alias("k")), F.struct(F.when(F.col(c) == n - 1, n - 1).alias("o"), F.lit(1).alias("k"))]
        return F.explode(F.array(*images))

    spread = image.select("ix", "iy", value, readers("ix", nx).alias("x")).select("ix", "iy", value, "x", readers("iy", ny).alias("y"))
    spread = spread.where((F.col("x.o") >= 0) & (F.col("x.o") < nx) & (F.col("y.o") >= 0) & (F.col("y.o") < ny))
    even = lambda c: F.when(F.col(c) == 0, 0.5).otherwise(0.25)
    across, down = (F.sum(F.col(value) * F.col(f"{a}.k") * 0.5 * even(f"{b}.k")) for a, b in ("xy", "yx"))
    g = spread.groupBy(F.col("x.o").alias("ix"), F.col("y.o").alias("iy")).agg(across.alias("gx"), down.alias("gy"))
    return g.select("ix", "iy", F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) / 2).alias("edge"))


def superpixels(pixels: DataFrame, values: list[str], step: int, compactness: float, rounds: int = 10) -> DataFrame:
    """(ix, iy, seed): pixels (ix, iy and values) by the seed they are nearest to.

    Seeds start as the means of the cells of ``step`` by ``step`` pixels. Nearness is the squared difference of the values and
    (compactness / step) squared of the places; of equal seeds that of the lower row, then column. A seed that nobody takes is gone.
    """
    cell = lambda c: F.floor(F.col(c) / step).cast("int")
    own = [*values, "ix", "iy"]
    p = materialize(pixels.select("ix", "iy", *values, cell("ix").alias("cx"), cell("iy").alias("cy")))
    centre = lambda t: t.groupBy("sx", "sy").agg(*[F.avg(v).alias(f"m_{v}") for v in own])
    seeds = materialize(centre(p.withColumnsRenamed({"cx": "sx", "cy": "sy"})))
    steps = F.explode(F.array(*[F.struct((F.col("cx") + dx).alias("sx"), (F.col("cy") + dy).alias("sy")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])).alias("s")
    offered = p.select("ix", "iy", *values, steps).select("ix", "iy", *values, "s.sx", "s.sy")
    far = sum((F.col(v) - F.col(f"m_{v}")) * (F.col(v) - F.col(f"m_{v}")) for v in values)
    far = far + (compactness / step) ** 2 * sum((F.col(c) - F.col(f"m_{c}")) * (F.col(c) - F.col(f"m_{c}")) for c in ("ix", "iy"))
    taken = None
    for _ in range(rounds):
        best = offered.join(seeds, ["sx", "sy"]).groupBy("ix", "iy").agg(F.min(F.struct(F.round(far, 9).alias("d"), "sy", "sx")).alias("m"))
        taken = materialize(best.select("ix", "iy", F.col("m.sx").alias("sx"), F.col("m.sy").alias("sy")))
        seeds = materialize(centre(taken.join(p.select("ix", "iy", *values), ["ix", "iy"])))
    return taken.select("ix", "iy", (F.col("sy").cast("bigint") * tiles.WIDE + F.col("sx")).alias("seed"))


def features(image: DataFrame, segments: DataFrame, nx: int, ny: int) -> DataFrame:
    """(seed and the ten FEATURES) of each segment, standardised over the segments by mean and population deviation."""
    r, g, b = (F.col(c) / 255 for c in "rgb")
    grey = sum(w * c for w, c in zip(GREY, (r, g, b), strict=True))
    density = -sum(F.log(F.least(F.greatest(c, F.lit(1e-4)), F.lit(1.0))) for c in (r, g, b)) / 3
    full = image.select("ix", "iy", r.alias("red"), g.alias("green"), b.alias("blue"), *[s.alias(n) for s, n in zip(stains(r, g, b), FEATURES[3:6], strict=True)], density.alias("density"), grey.alias("_grey"))
    full = full.join(edges(full, "_grey", nx, ny), ["ix", "iy"])
    full = full.withColumns({"across": F.col("ix") / max(1, nx - 1), "down": F.col("iy") / max(1, ny - 1)})
    means = materialize(segments.join(full, ["ix", "iy"]).groupBy("seed").agg(*[F.avg(f).alias(f) for f in FEATURES]))
    scale = means.agg(*[x for f in FEATURES for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))])  # one row
    return means.crossJoin(F.broadcast(scale)).select("seed", *[((F.col(f) - F.col(f"m_{f}")) / F.greatest(F.col(f"s_{f}"), F.lit(1e-6))).alias(f) for f in FEATURES])


def components_of(table: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(seed, component) of segments with FEATURES, components 1 to ``n`` by k-means."""
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="_v").transform(table)
    model = KMeans(k=n, seed=seed, featuresCol="_v", predictionCol="_k").fit(vectors)
    return model.transform(vectors).select("seed", (F.col("_k") + 1).alias("component"))


def cleaned(labels: DataFrame, least: int) -> DataFrame:
    """(ix, iy, component, part): four-connected parts of each component with ``least`` pixels or more."""
    return tiles.large(labels.select("component", "ix", "iy"), ["component"], least)
