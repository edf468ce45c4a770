"""Orientation of slices along a stack: the best of all choices of two states, from scores of neighbouring slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_orientation(edges: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, n_edges, path, score, margin) of each stack.

    ``edges`` has, for each pair of neighbouring slices in ``order``, the scores s00, s01, s10 and s11 of the states 0
    (as it is) and 1 (flipped) of both. ``path`` has a state for each slice; ties go to state 0. ``margin`` is the lead
    over the best path that ends in the other state. The recursion runs over one stack's edges, as many as it has slices.
    """
    each = F.array_sort(F.collect_list(F.struct(order, "s00", "s01", "s10", "s11"))).alias("e")

    def step(acc: Column, e: Column) -> Column:
        a0, a1 = acc["a"] + e["s00"], acc["b"] + e["s10"]
        b0, b1 = acc["a"] + e["s01"], acc["b"] + e["s11"]
        return F.struct(
            F.greatest(a0, a1).alias("a"), F.greatest(b0, b1).alias("b"),
            F.concat(F.when(a0 >= a1, acc["pa"]).otherwise(acc["pb"]), F.lit("0")).alias("pa"), F.concat(F.when(b0 >= b1, acc["pa"]).otherwise(acc["pb"]), F.lit("1")).alias("pb"),
        )

    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit("0").alias("pa"), F.lit("1").alias("pb"))
    run = edges.groupBy(*keys).agg(each).withColumn("r", F.aggregate("e", start, step))
    first = F.col("r.a") >= F.col("r.b")
    return run.select(*keys, F.size("e").cast("bigint").alias("n_edges"), F.when(first, F.col("r.pa")).otherwise(F.col("r.pb")).alias("path"), F.greatest("r.a", "r.b").alias("score"), F.abs(F.col("r.a") - F.col("r.b")).alias("margin"))


def two_best(edges: DataFrame, keys: list[str], order: str, least_margin: float = 0.05, support: DataFrame | None = None, least_support: float = 0.7) -> DataFrame:
    """(keys, n_edges, path, score, second, second_score, margin, reasons) of each stack: its two best paths of states and what makes the choice doubtful.

    ``margin`` is the difference of their scores an edge; of equal scores the path that sorts first is better. ``support``
    (keys, support) may say how often resampling gave the path. Each state carries its two best paths so far, so the second
    best of all is exact. ``reasons`` are joined by ";", empty for a safe choice.
    """
    each = F.array_sort(F.collect_list(F.struct(order, "s00", "s01", "s10", "s11"))).alias("e")

    def best(paths: Column) -> Column:
        return F.slice(F.array_sort(paths), 1, 2)

    def onward(paths: Column, score: Column, state: str) -> Column:
        return F.transform(paths, lambda p: F.struct((p["loss"] - score).alias("loss"), F.concat(p["path"], F.lit(state)).alias("path")))

    def step(acc: Column, e: Column) -> Column:
        return F.struct(*[best(F.concat(onward(acc["zero"], e[f"s0{s}"], s), onward(acc["one"], e[f"s1{s}"], s))).alias(name) for name, s in (("zero", "0"), ("one", "1"))])

    start = F.struct(*[F.array(F.struct(F.lit(0.0).alias("loss"), F.lit(s).alias("path"))).alias(name) for name, s in (("zero", "0"), ("one", "1"))])
    run = edges.groupBy(*keys).agg(each).withColumn("r", F.aggregate("e", start, step))
    run = run.select(*keys, F.size("e").cast("bigint").alias("n_edges"), best(F.concat("r.zero", "r.one")).alias("b"))
    run = run.select(*keys, "n_edges", F.col("b")[0]["path"].alias("path"), (-F.col("b")[0]["loss"]).alias("score"), F.col("b")[1]["path"].alias("second"), (-F.col("b")[1]["loss"]).alias("second_score"))
    run = run.withColumn("margin", (F.col("score") - F.col("second_score")) / F.col("n_edges"))
    run = run.join(support, keys, "left") if support is not None else run.withColumn("support", F.lit(None).cast("double"))
    doubts = [F.when(F.col("margin") < least_margin, F.lit("score_margin_below_threshold")), F.when(F.col("support") < least_support, F.lit("bootstrap_support_below_threshold"))]
    return run.withColumn("reasons", F.concat_ws(";", *doubts)).drop("support")
