"""Stacks of slices: transforms between neighbours composed along the stack."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def composed(steps: DataFrame, keys: list[str], order: str, block: int = 64) -> DataFrame:
    """(keys, order, rotation, scale, dx, dy) that takes each slice to the first frame of its stack.

    ``steps`` has the similarity that takes a slice to the one before it: rotation in degrees, scale, dx, dy. Composition is
    associative, so slices go to blocks of ``block`` orders that are composed side by side; the blocks' own products are
    composed in the same way, and each slice gets that of the blocks before its own. A stack of n slices takes as many
    rounds as n has digits to the base of the block. Orders are whole numbers and need not be dense.
    """
    turn, size = F.radians("rotation"), F.col("scale")
    parts = steps.select(*keys, F.col(order).cast("bigint").alias("_o"), (size * F.cos(turn)).alias("ar"), (size * F.sin(turn)).alias("ai"), F.col("dx").alias("tr"), F.col("dy").alias("ti"))
    low = parts.agg(F.min("_o")).first()[0] or 0
    done = _prefixes(parts.withColumn("_o", F.col("_o") - low), keys, block).withColumn("_o", F.col("_o") + low)
    return done.select(*keys, F.col("_o").cast(steps.schema[order].dataType).alias(order), F.degrees(F.atan2("ai", "ar")).alias("rotation"), F.hypot("ar", "ai").alias("scale"), F.col("tr").alias("dx"), F.col("ti").alias("dy"))


def _prefixes(parts: DataFrame, keys: list[str], block: int) -> DataFrame:
    names = ["ar", "ai", "tr", "ti"]
    types = ", ".join([*(f"{k} {parts.schema[k].dataType.simpleString()}" for k in keys), "_b bigint, _o bigint", *(f"{n} double" for n in names), "last boolean"])

    def along(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                a, t = 1 + 0j, 0j
                for i, s in enumerate(r["s"]):
                    a, t = a * complex(s["ar"], s["ai"]), a * complex(s["tr"], s["ti"]) + t
                    rows.append((*(r[k] for k in keys), r["_b"], s["_o"], a.real, a.imag, t.real, t.imag, i == len(r["s"]) - 1))
            if rows:
                yield pd.DataFrame(rows, columns=[*keys, "_b", "_o", *names, "last"])

    blocks = parts.withColumn("_b", F.floor(F.col("_o") / block)).groupBy(*keys, "_b").agg(F.sort_array(F.collect_list(F.struct("_o", *names))).alias("s"))
    own = materialize(blocks.mapInPandas(along, types))
    total = own.where("last").select(*keys, F.col("_b").alias("_o"), *names)
    if total.groupBy(*keys).count().where("count > 1").isEmpty():
        return own.select(*keys, "_o", *names)
    whole = materialize(_prefixes(total, keys, block))
    # What comes before a block ends with the last block under it. There are a block's share of slices as many rows here.
    place = Window.partitionBy(*keys).orderBy("_o") if keys else Window.orderBy("_o")
    before = whole.select(*keys, F.col("_o").alias("_b"), F.lag(F.struct(*[F.col(n).alias(f"p{n}") for n in names])).over(place).alias("p"))
    j = own.join(before, [*keys, "_b"], "left")
    pr, pi, qr, qi = (F.coalesce(F.col(f"p.p{n}"), F.lit(v)) for n, v in zip(names, (1.0, 0.0, 0.0, 0.0), strict=True))
    a, b, c, d = (F.col(n) for n in names)
    return j.select(*keys, "_o", (pr * a - pi * b).alias("ar"), (pr * b + pi * a).alias("ai"), (pr * c - pi * d + qr).alias("tr"), (pr * d + pi * c + qi).alias("ti"))


def identity_first(steps: DataFrame, slices: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``steps`` and, for slices (keys, order) without one, such as the first of each stack, the transform that moves nothing."""
    still = slices.select(*keys, order).distinct().join(steps.select(*keys, order), [*keys, order], "left_anti")
    return steps.select(*keys, order, "rotation", "scale", "dx", "dy").unionByName(still.select(*keys, order, *[F.lit(v).alias(n) for n, v in (("rotation", 0.0), ("scale", 1.0), ("dx", 0.0), ("dy", 0.0))]))
