"""Aggregations with exact semantics: weighted statistics, entropy, dominance, spread, outliers, pairs and degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import pair
from ..functions.quantiles import quantiles
from ..sources.scratch import materialize


def r6(c: Column) -> Column:
    return F.round(c, 6)


def weighted(value: str, weight: str) -> tuple[Column, Column]:
    """Weighted mean and population deviation in one pass, null where the weights sum to nothing."""
    w = F.sum(weight)
    mean = F.when(w > 0, F.sum(F.col(value) * F.col(weight)) / w)
    square = F.when(w > 0, F.sum(F.col(value) * F.col(value) * F.col(weight)) / w)
    return mean, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, sample deviation and variance (0 for one row), coefficient of variation."""
    mean = F.avg(value)
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), r6(mean).alias("mean"), r6(F.coalesce(F.stddev_samp(value), F.lit(0.0))).alias("std"), F.round(F.coalesce(F.var_samp(value), F.lit(0.0)), 4).alias("variance"),
        r6(F.try_divide(F.stddev_pop(value), mean)).alias("cv"),
    )


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Minimum, quantiles, mean and maximum with linear interpolation."""
    q = quantiles(df, keys, [value], [0.05, 0.5, 0.9, 0.95]).withColumnRenamed(value, "q")
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max")).join(q, keys)
    return out.select(*keys, "n", r6(F.col("min")).alias("min"), *[r6(F.col("q")[i]).alias(c) for i, c in enumerate(("p05", "median", "p90", "p95"))], r6(F.col("mean")).alias("mean"), r6(F.col("max")).alias("max"))


def shares(df: DataFrame, keys: list[str], state: str) -> DataFrame:
    """(keys, state, n, total): counts of states and of their group; the group's total comes from the counts, not from a second pass."""
    counts = df.groupBy(*keys, state).agg(F.count("*").alias("n"))
    return counts.join(counts.groupBy(*keys).agg(F.sum("n").alias("total")), keys)


def state_mix(df: DataFrame, keys: list[str], state: str) -> DataFrame:
    """Dominant state and its share, entropy in bits, and entropy as a share of the most possible (A13-A15). Ties go to the state that sorts first."""
    p = F.col("n") / F.col("total")
    rows = shares(df, keys, state)
    first = F.min(F.struct((-F.col("n")).alias("o"), F.col(state).alias("state"), p.alias("share")))
    bits = -F.sum(p * F.log2(p))
    out = rows.groupBy(*keys).agg(first.alias("d"), bits.alias("bits"), F.count("*").alias("k"))
    norm = F.when(F.col("k") > 1, F.col("bits") / F.log2("k")).otherwise(0.0)
    return out.select(*keys, F.col("d.state").alias("dominant"), r6(F.col("d.share")).alias("fraction"), r6(F.col("bits")).alias("entropy"), r6(norm).alias("evenness"))


def flag_union(df: DataFrame, keys: list[str], flags: str) -> DataFrame:
    """Distinct members of ``;``-joined lists, sorted and joined again."""
    each = df.select(*keys, F.explode(F.split(flags, ";")).alias("f")).where("f <> ''").distinct()
    return each.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("f")), ";").alias("flags"), F.count("*").alias("n_flags"))


def pair_totals(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """(a, b, n, total) by unordered pair."""
    lo, hi = pair(a, b)
    return df.groupBy(lo.alias("a"), hi.alias("b")).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))


def dense_pairs(labels: DataFrame, totals: DataFrame) -> DataFrame:
    """``totals`` with a zero row for every pair of ``labels`` (column label, a bounded label set) that it lacks."""
    a, b = labels.select(F.col("label").alias("a")), labels.select(F.col("label").alias("b"))
    return a.join(b, F.col("a") <= F.col("b")).join(totals, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


def degrees(edges: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """(node, n_neighbours, n_edges, strength) of an edge table; a self-loop counts once and is no neighbour."""
    one = edges.select(F.col(a).alias("node"), F.col(b).alias("other"), F.col(weight).alias("w"))
    two = edges.where(F.col(a) != F.col(b)).select(F.col(b).alias("node"), F.col(a).alias("other"), F.col(weight).alias("w"))
    sums = one.unionAll(two).groupBy("node", "other").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    return sums.groupBy("node").agg(F.count_if(F.col("node") != F.col("other")).alias("n_neighbours"), F.sum("n").alias("n_edges"), F.round(F.sum("w"), 2).alias("strength"))


def within_mad(df: DataFrame, keys: list[str], value: str, limit: float) -> DataFrame:
    """Rows within ``limit`` scaled median absolute deviations of their group's median."""
    med = quantiles(df, keys, [value], [0.5]).select(*keys, F.col(value)[0].alias("_med"))
    rows = materialize(df.join(med, keys).withColumn("_dev", F.abs(F.col(value) - F.col("_med"))))
    mad = quantiles(rows, keys, ["_dev"], [0.5]).select(*keys, F.col("_dev")[0].alias("_mad"))
    return rows.join(mad, keys).where(F.col("_dev") <= limit * 1.4826 * F.col("_mad")).drop("_med", "_dev", "_mad")


def pivot_sums(df: DataFrame, key: str, column: str, values: list[str], value: str, names: list[str]) -> DataFrame:
    """Long to wide with zero fill; the columns are given, so no pass is spent on finding them."""
    sums = [F.coalesce(F.sum(F.when(F.col(column) == v, F.col(value))), F.lit(0)).alias(n) for v, n in zip(values, names, strict=True)]
    return df.groupBy(key).agg(*sums)


def signature_states(counts: DataFrame, cell: str, gene: str, n: str, signatures: list[tuple[str, list[str]]]) -> DataFrame:
    """(cell, state, score): the signature with the highest sum over its genes, the first of equals, ``unresolved`` at zero or less."""
    sums = [F.sum(F.when(F.col(gene).isin(*genes), F.col(n)).otherwise(0)).alias(f"_s{i}") for i, (_, genes) in enumerate(signatures)]
    out = counts.groupBy(cell).agg(*sums)
    best = F.greatest(*[F.col(f"_s{i}") for i in range(len(signatures))])
    state = F.lit("unresolved")
    for i, (name, _) in reversed(list(enumerate(signatures))):
        state = F.when(F.col(f"_s{i}") == best, name).otherwise(state)
    return out.select(cell, F.when(best > 0, state).otherwise("unresolved").alias("state"), F.greatest(best, F.lit(0)).cast("bigint").alias("score"))


def percent_rank_average(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """``df`` with pct: rank over count where ties share their mean rank; 0 where the whole group is one value or null.

    Ranks come from cumulated counts of distinct values, so the window runs over values, not rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*keys).orderBy(value)
    ranked = counts.withColumn("_below", F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(W.partitionBy(*keys)))
    pct = F.when(F.col("_n") == F.col("_all"), 0.0).otherwise((F.col("_below") + (F.col("_n") + 1) / 2) / F.col("_all"))
    return df.join(ranked.select(*keys, value, pct.alias("pct")), [*keys, value], "left").withColumn("pct", F.coalesce("pct", F.lit(0.0)))


def row_zscores(df: DataFrame, key: str, value: str) -> DataFrame:
    """Values less their group's mean over its population deviation, a zero deviation counting as one."""
    stats = df.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(stats, key).withColumn("z", (F.col(value) - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))).drop("_m", "_s")
