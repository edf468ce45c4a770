"""Joins and matches: key alignment, reciprocal best, ranks, fallbacks, graphs, samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.quantiles import at_ranks
from ..sources.scratch import materialize


def align_best_key(left: DataFrame, right: DataFrame, keys: list[str], right_key: str) -> DataFrame:
    """Inner join on the variant of the left keys that gives most rows: each as it is, then without a ``-1`` end; the first wins ties.

    All variants are counted in one aggregate over both sides' key counts, then one join is made.
    """
    forms: list[tuple[str, Column]] = []
    for k in keys:
        t = F.trim(F.col(k).cast("string"))
        forms += [(k, t), (f"{k}-1", F.regexp_replace(t, "-1$", ""))]
    r = right.groupBy(F.trim(F.col(right_key).cast("string")).alias("_key")).agg(F.count("*").alias("_n"))
    each = left.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.alias("k")) for i, (_, c) in enumerate(forms)])).alias("f"))
    sizes = each.groupBy("f.i", "f.k").agg(F.count("*").alias("m")).join(r, F.col("k") == F.col("_key")).groupBy("i").agg(F.sum(F.col("m") * F.col("_n")).alias("rows"))
    best = max(sizes.collect(), key=lambda x: (x["rows"], -x.i), default=None)  # one row per form
    chosen = forms[best.i if best else 0][1]
    return left.withColumn("_key", chosen).join(right.withColumn("_key", F.trim(F.col(right_key).cast("string"))), "_key").drop("_key")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their rank (J20, W5). Spark limits groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def mutual_best(pairs: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """Pairs that are each other's best, ties to the smaller partner (J17). Both bests are aggregates; no group is sorted."""
    out = pairs.groupBy(a).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(b).alias("p"))).alias("m")).select(a, F.col("m.p").alias(b))
    into = pairs.groupBy(b).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(a).alias("p"))).alias("m")).select(b, F.col("m.p").alias(a))
    return pairs.join(out, [a, b], "left_semi").join(into, [a, b], "left_semi")


def mutual_ranks(pairs: DataFrame, a: str, b: str, score: str, k: int) -> DataFrame:
    """Pairs that are among each other's first ``k``, with both ranks."""
    ra = F.row_number().over(W.partitionBy(a).orderBy(F.desc(score), b)).cast("bigint")
    rb = F.row_number().over(W.partitionBy(b).orderBy(F.desc(score), a)).cast("bigint")
    return pairs.withColumn("rank_a", ra).where(F.col("rank_a") <= k).join(pairs.withColumn("rank_b", rb).where(F.col("rank_b") <= k).select(a, b, "rank_b"), [a, b])


def unmatched(pairs: DataFrame, candidates: DataFrame, a: str, b: str) -> DataFrame:
    """``candidates`` whose both ends are in no pair."""
    return candidates.join(pairs.select(a).distinct(), a, "left_anti").join(pairs.select(b).distinct(), b, "left_anti")


def greedy_pairs(pairs: DataFrame, a: str, b: str, order: list[Column], max_rounds: int = 200) -> DataFrame:
    """One-to-one pairs as a greedy pass in ``order`` would take them.

    A pair that is the first left at both of its ends is taken by the greedy pass whatever comes between, so whole
    rounds of such pairs are taken at once and their ends removed.
    """
    left = materialize(pairs.withColumn("_o", F.struct(*order, F.col(a), F.col(b))))
    taken = []
    for _ in range(max_rounds):
        first_a, first_b = left.groupBy(a).agg(F.min("_o").alias("_o")), left.groupBy(b).agg(F.min("_o").alias("_o"))
        now = materialize(left.join(first_a, [a, "_o"], "left_semi").join(first_b, [b, "_o"], "left_semi"))
        taken.append(now)
        left = materialize(left.join(now.select(a), a, "left_anti").join(now.select(b), b, "left_anti"))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, taken).drop("_o")
    raise RuntimeError("greedy pairing did not end")


def full_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(n_left_only, n_right_only, n_both) of two tables' keys."""
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(True)), right.select(*keys).distinct().withColumn("_r", F.lit(True))
    both = a.join(b, keys, "full")
    return both.agg(F.count_if(F.col("_r").isNull()).alias("n_left_only"), F.count_if(F.col("_l").isNull()).alias("n_right_only"), F.count_if(F.col("_l") & F.col("_r")).alias("n_both"))


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge table, component being its smallest member (G1).

    Labels fall to the least among neighbours, then to their label's own label, so long chains shorten by half a round.
    No join is a broadcast: a written table of labels is small in its file and many times that in the driver's memory.
    """
    pairs = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).distinct())
    label = materialize(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("c")))
    for _ in range(max_rounds):
        near = pairs.join(label.withColumnsRenamed({"u": "v", "c": "cv"}).hint("merge"), "v").groupBy("u").agg(F.min("cv").alias("m"))
        low = label.join(near.hint("merge"), "u").select("u", F.least("c", "m").alias("c"), F.col("c").alias("was"))
        low = materialize(low)
        own = low.select(F.col("u").alias("c"), F.col("c").alias("cc")).join(low.select("c").distinct().hint("merge"), "c")  # a row for each label still in use
        jump = low.join(own.hint("merge"), "c").select("u", "cc", "was")
        new = materialize(jump.select("u", F.col("cc").alias("c"), (F.col("cc") != F.col("was")).alias("moved")))
        label = new.select("u", "c")
        if new.where("moved").isEmpty():
            return label.select(F.col("u").alias("node"), F.col("c").alias("component"))
    raise RuntimeError("components did not settle")


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, the same for any partitioning: those of the smallest hashes."""
    return df.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256), key).limit(n)


def stratified_sample(df: DataFrame, strata: list[str], key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in proportion to strata, quotas by largest remainder, rows by hash order."""
    counts = df.groupBy(*strata).agg(F.count("*").alias("_c"))
    total = W.partitionBy()  # over strata, of which there are few
    exact = F.col("_c") * F.lit(n) / F.sum("_c").over(total)
    q = counts.withColumn("_exact", exact).withColumn("_base", F.floor("_exact"))
    left = F.lit(n) - F.sum("_base").over(total)
    order = F.row_number().over(W.orderBy(F.desc(F.col("_exact") - F.col("_base")), *strata))
    q = q.select(*strata, (F.col("_base") + F.when(order <= left, 1).otherwise(0)).alias("quota"))
    # The order is that of the hash's hexadecimal digits, so its first twelve of them, as a fraction, bound a quota's share; only what is under the bound is ranked.
    hash_ = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    share = F.conv(F.substring(hash_, 1, 12), 16, 10).cast("double") / float(1 << 48)
    few = df.join(q.join(counts, strata), strata).withColumn("_hash", hash_).where((share < (1.5 * F.col("quota") + 50) / F.col("_c")))
    rank = F.row_number().over(W.partitionBy(*strata).orderBy("_hash", key))
    return few.withColumn("_rank", rank).where(F.col("_rank") <= F.col("quota")).select(*df.columns)


def evenly_spaced(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """``n`` rows of each group at equal steps of rank, first and last included."""
    steps = F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(n).cast("bigint"), F.col("_n")) - 1)
    at = F.transform(steps, lambda k: F.when(F.col("_n") <= n, k).otherwise(F.floor(k * (F.col("_n") - 1) / F.lit(n - 1))))
    return at_ranks(df, keys, order, at)


def threshold_or_top(df: DataFrame, keys: list[str], passes: Column, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` passing rows of each group, or of all its rows where none passes."""
    rows = df.withColumn("_p", passes)
    any_ = rows.groupBy(*keys).agg(F.bool_or("_p").alias("_any"))
    return top_k(rows.join(any_, keys).where(F.col("_p") | ~F.col("_any")), keys, order, k).drop("_p", "_any")


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its place from 1 in an order over all rows (W1, W10): rows are sorted by ranges, numbered in each, and each range adds the rows before it."""
    parts = materialize(df.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_place", place).join(sizes.select("_part", before.alias("_before")), "_part").select(*df.columns, (F.col("_place") + F.col("_before")).cast("bigint").alias(name))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order, by an aggregate."""
    o = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), o).alias("_r")).select(*keys, "_r.*")


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n): the most frequent value of each group, the smallest of equals."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return first_of(n, keys, [-F.col("n"), F.col(value)])


def passing_or_nearest(df: DataFrame, keys: list[str], passes: Column, least: int, order: list[Column]) -> DataFrame:
    """Passing rows of each group, or its first ``least`` in ``order`` where fewer pass."""
    rows = df.withColumn("_p", passes)
    enough = rows.groupBy(*keys).agg((F.count_if("_p") >= least).alias("_enough"))
    rows = rows.join(enough, keys)
    return rows.where(F.col("_p") & F.col("_enough")).drop("_p", "_enough").unionByName(top_k(rows.where(~F.col("_enough")), keys, order, least).drop("_p", "_enough", "rank"))


def chosen_first(parts: list[DataFrame], key: str, order: str, most: int) -> DataFrame:
    """``most`` keys from lists of decreasing standing, each key once, in order within its list."""
    all_ = None
    for i, p in enumerate(parts):
        p = p.select(F.lit(i).alias("part"), F.col(key), F.col(order).alias("_o"))
        all_ = p if all_ is None else all_.unionByName(p)
    return all_.groupBy(key).agg(F.min(F.struct("part", "_o")).alias("m")).select(key, "m.part", "m._o").orderBy("part", "_o", key).limit(most).select(key, "part")


def sparse_cosine(weights: DataFrame, row: str, key: str, value: str, candidates: DataFrame) -> DataFrame:
    """(a, b, cosine) of candidate pairs of sparse rows; a missing key counts zero, an empty row gives null."""
    norm = weights.groupBy(row).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("n"))
    w = weights.select(row, key, value)
    dot = (
        candidates.join(w.withColumnsRenamed({row: "a", value: "va"}), "a").join(w.withColumnsRenamed({row: "b", value: "vb"}), ["b", key])
        .groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"))
    )
    with_norms = candidates.join(dot, ["a", "b"], "left").join(norm.withColumnsRenamed({row: "a", "n": "na"}), "a", "left").join(norm.withColumnsRenamed({row: "b", "n": "nb"}), "b", "left")
    return with_norms.select("a", "b", F.round(F.try_divide(F.coalesce("dot", F.lit(0.0)), F.col("na") * F.col("nb")), 6).alias("cosine"))
