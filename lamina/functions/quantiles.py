"""Exact quantiles of groups of any size: a histogram finds the bins that hold the wanted ranks, and only those bins' rows are ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bins of a group at most, and the rows a bin should have at least: small groups get few bins.
BINS, LEAST_ROWS = 1024, 256
#: Groups of so many rows at most are sorted as arrays, which gives the same quantiles in one pass.
SMALL = 65_536


def _bin(value: Column, bins: int) -> Column:
    """Bin of a value between ``_lo`` and ``_hi`` of a group of ``_n`` rows."""
    n = F.least(F.lit(bins), F.greatest(F.lit(1), F.floor(F.col("_n") / LEAST_ROWS)))
    return F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((value - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * n), n - 1)).otherwise(0).cast("int")


def _ranks(probabilities: list[float]) -> Column:
    """Ranks (from 0) on either side of each quantile of ``_n`` values."""
    at = [F.lit(float(p)) * (F.col("_n") - 1) for p in probabilities]
    return F.array_distinct(F.array(*[f(a).cast("bigint") for a in at for f in (F.floor, F.ceil)]))


def quantiles(df: DataFrame, keys: list[str], values: list[str], probabilities: list[float], bins: int = BINS) -> DataFrame:
    """(keys, and for each of ``values`` an array of its quantiles, linearly interpolated); nulls are left out.

    Groups are counted first. Where none is large they are sorted as they are; else in three passes, each with partial sums: range and count of each group, counts of its equal bins (``bins`` at most), and counts of
    the distinct values within the bins that hold a wanted rank. Windows run over a group's bins and over the distinct
    values of one bin, never over a group's rows.
    """
    if (df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= SMALL:
        return _of_small_groups(df, keys, values, probabilities)
    named = F.explode(F.array(*[F.struct(F.lit(v).alias("_c"), F.col(v).cast("double").alias("_v")) for v in values])).alias("_e")
    long = df.select(*keys, named).select(*keys, "_e._c", "_e._v").where("_v is not null")
    group = [*keys, "_c"]
    span = long.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    binned = _same(long, span, group).withColumn("_b", _bin(F.col("_v"), bins))
    before = F.coalesce(F.sum("_k").over(W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = binned.groupBy(*group, "_b", "_n").agg(F.count("*").alias("_k")).withColumn("_before", before)
    wanted = F.filter(_ranks(probabilities), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_k")))
    chosen = counts.select(*group, "_b", "_n", "_before", wanted.alias("_ranks")).where(F.size("_ranks") > 0)
    within = _same(binned.drop("_n"), chosen, [*group, "_b"]).groupBy(*group, "_b", "_n", "_before", "_ranks", "_v").agg(F.count("*").alias("_k"))
    place = F.col("_before") + F.coalesce(F.sum("_k").over(W.partitionBy(*group, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = F.filter("_ranks", lambda r: (r >= F.col("_place")) & (r < F.col("_place") + F.col("_k")))
    found = within.withColumn("_place", place).select(*group, "_n", "_v", F.explode(held).alias("_r"))
    by_rank = found.groupBy(*group, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_m"))

    def at(p: float) -> Column:
        place = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = (F.element_at("_m", f(place).cast("bigint")) for f in (F.floor, F.ceil))
        return low + (high - low) * (place - F.floor(place))

    each = by_rank.select(*group, F.array(*[at(p) for p in probabilities]).alias("_q"))
    named = [F.max(F.when(F.col("_c") == v, F.col("_q"))).alias(v) for v in values]
    return each.groupBy(*keys).agg(*named) if keys else each.agg(*named)


def _of_small_groups(df: DataFrame, keys: list[str], values: list[str], probabilities: list[float]) -> DataFrame:
    held = df.groupBy(*keys).agg(*[F.sort_array(F.collect_list(F.col(v).cast("double"))).alias(v) for v in values])

    def at(v: str, p: float) -> Column:
        place = F.lit(float(p)) * (F.size(v) - 1)
        low, high = (F.get(v, f(place).cast("int")) for f in (F.floor, F.ceil))
        return low + (high - low) * (place - F.floor(place))

    some = F.lit(False)
    for v in values:
        some = some | (F.size(v) > 0)
    found = [F.when(F.size(v) > 0, F.array(*[at(v, p) for p in probabilities])).alias(v) for v in values]
    return (held.where(some) if keys else held).select(*keys, *found)


def at_ranks(df: DataFrame, keys: list[str], order: str, ranks: Column, bins: int = BINS) -> DataFrame:
    """``df``'s rows at ``ranks`` (an array of places from 0, of ``_n`` rows, in the order of a numeric column without repeats) of each group.

    As in :func:`quantiles`, a histogram finds the bins that hold the places, and only their rows are numbered.
    """
    v = F.col(order).cast("double")
    span = df.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count("*").alias("_n"))
    binned = _same(df, span, keys).withColumn("_b", _bin(v, bins))
    before = F.coalesce(F.sum("_k").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = binned.groupBy(*keys, "_b", "_n").agg(F.count("*").alias("_k")).withColumn("_before", before)
    wanted = F.filter(ranks.cast("array<bigint>"), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_k")))
    chosen = counts.select(*keys, "_b", "_before", wanted.alias("_ranks")).where(F.size("_ranks") > 0)
    place = F.col("_before") + F.row_number().over(W.partitionBy(*keys, "_b").orderBy(order)) - 1
    rows = _same(binned, chosen, [*keys, "_b"]).withColumn("_place", place.cast("bigint"))
    return rows.where(F.array_contains("_ranks", F.col("_place"))).select(*df.columns)


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null, null meeting null."""
    names = {k: f"_r{i}" for i, k in enumerate(keys)}
    other = right.withColumnsRenamed(names)
    on = None
    for k, r in names.items():
        same = left[k].eqNullSafe(other[r])
        on = same if on is None else on & same
    return left.join(other, on).drop(*names.values())
