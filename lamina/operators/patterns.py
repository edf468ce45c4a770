"""Point patterns by Monte Carlo: Ripley's L, a dispersion index and nearest-neighbour ratio against simulated nulls.

One simulation of one test is a row of its own, so simulations of a test run side by side on as many tasks as there are.
What a task holds is one pattern of at most ``max_points`` points and the windows' pixels, a raster of bounded size. The
statistics over simulations (means, leave-one-out ratios, p-values) are aggregates over those rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.grid import Axis
from ..sources.scratch import materialize

#: Measures of one pattern: mean squared L by radius as ordered pairs per pair, and the mean distance to the nearest other point.
MEASURED = "key string, sim int, pairs array<double>, near double"


def pair_counts(xy: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Ordered pairs within each radius. Points in order of x are compared at growing rank shifts until x alone is too far."""
    xy = xy[np.argsort(xy[:, 0], kind="stable")]
    out = np.zeros(len(radii))
    i = np.arange(len(xy))
    for shift in range(1, len(xy)):
        i = i[i + shift < len(xy)]
        i = i[xy[i + shift, 0] - xy[i, 0] <= radii[-1]]
        if not len(i):
            break
        d = np.hypot(*(xy[i + shift] - xy[i]).T)
        out += 2 * (d[:, None] <= radii[None, :]).sum(axis=0)
    return out


def nearest_distance(xy: np.ndarray) -> float:
    """Mean distance to the nearest other point."""
    xy = xy[np.argsort(xy[:, 0], kind="stable")]
    best = np.full(len(xy), np.inf)
    for shift in range(1, len(xy)):
        a, b = np.arange(len(xy) - shift), np.arange(shift, len(xy))
        gap = xy[b, 0] - xy[a, 0]
        live = (gap < best[a]) | (gap < best[b])
        if not live.any():
            break
        d = np.hypot(*(xy[b[live]] - xy[a[live]]).T)
        np.minimum.at(best, a[live], d)
        np.minimum.at(best, b[live], d)
    return float(best.mean())


def thinned(points: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """``points`` with at most ``most`` of each key, those of the smallest hashes of ``id``, and ``n_full``, their number before.

    Groups are counted by an aggregate. A threshold on the hash leaves a little more than ``most`` of a group, and only those are ranked.
    """
    n = points.groupBy(key).agg(F.count("*").alias("n_full"))
    order = F.xxhash64(F.lit(seed), "id")
    share = F.pmod(order, F.lit(1 << 40)) / float(1 << 40)
    few = points.join(n, key).where(share < (1.1 * most + 300) / F.col("n_full"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(order, "id"))
    return few.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def _measure(xy: np.ndarray, radii: np.ndarray) -> tuple[list[float], float]:
    return (pair_counts(xy, radii) / (len(xy) * (len(xy) - 1))).tolist(), nearest_distance(xy)


def _measured_points(rows: DataFrame, radii: np.ndarray) -> DataFrame:
    """Measures of patterns given as rows (key, sim, x, y)."""

    def run(names: tuple, p: pd.DataFrame) -> pd.DataFrame:
        pairs, near = _measure(p[["x", "y"]].to_numpy(float), radii)
        return pd.DataFrame({"key": [names[0]], "sim": [names[1]], "pairs": [pairs], "near": [near]})

    return rows.groupBy("key", "sim").applyInPandas(run, MEASURED)


def _measured_uniform(units: DataFrame, windows: dict[str, np.ndarray], x: Axis, y: Axis, radii: np.ndarray) -> DataFrame:
    """Measures of uniform patterns, one for each row (key, sim, window, n, seed)."""
    pixels = units.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for u in b.itertuples():
                rng = np.random.default_rng(u.seed % (1 << 63))
                at = pixels.value[u.window]
                at = at[rng.integers(0, len(at), u.n)] + rng.random((u.n, 2))
                out.append((u.key, u.sim, *_measure(np.column_stack([x.low + at[:, 0] * x.step, y.low + at[:, 1] * y.step]), radii)))
            yield pd.DataFrame(out, columns=["key", "sim", "pairs", "near"])

    return units.mapInPandas(run, MEASURED)


def pattern_tests(points: DataFrame, tests: DataFrame, windows: DataFrame, x: Axis, y: Axis, radii: list[float], n_sim: int = 49, max_points: int = 20_000, pools: DataFrame | None = None, least: int = 3, band: tuple[float, float] | None = None) -> DataFrame:
    """(key, n_cells, n_used, area, di, p_clustered, p_regular, ce, p_ce) of each test with ``least`` points or more.

    ``points`` has key, id, x, y. ``tests`` has key, window and pool: where pool is null, the null patterns are uniform in the
    window's pixels (``windows``: window, ix, iy); elsewhere they are as many points drawn from that pool (``pools``: pool, id,
    x, y), which is random labelling. The index is a mean over radii of observed to mean null L, less one; ``band`` bounds
    the radii that count. Both p-values compare it with each simulation's index against the other simulations.
    """
    spark = points.sparkSession
    r = np.array(sorted(radii), float)
    kept = materialize(thinned(points.select("key", "id", "x", "y"), "key", max_points).where(F.col("n_full") >= least))
    sizes = kept.groupBy("key").agg(F.count("*").alias("n_used"), F.first("n_full").alias("n_cells"))
    pixel_rows = windows.select("window", "ix", "iy").distinct().toPandas()  # as many as the rasters have bins
    held = {w: g[["ix", "iy"]].to_numpy(float) for w, g in pixel_rows.groupby("window")}
    areas = spark.createDataFrame([(w, len(p) * x.step * y.step) for w, p in held.items()], "window string, area double")
    known = materialize(tests.select("key", "window", "pool").join(sizes, "key").join(F.broadcast(areas), "window"))
    sims = F.explode(F.sequence(F.lit(1), F.lit(n_sim))).alias("sim")
    units = known.where("pool is null").select("key", "window", F.col("n_used").cast("int").alias("n"), sims).withColumn("seed", F.xxhash64("key", "sim"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = _measured_points(kept.select("key", F.lit(0).alias("sim"), "x", "y"), r)
    found = found.unionByName(_measured_uniform(units.repartition(parts, "key", "sim"), held, x, y, r))
    if pools is not None:
        drawn = known.where("pool is not null").select("key", "pool", "n_used", sims)
        total = pools.groupBy("pool").agg(F.count("*").alias("_all"))
        order = F.xxhash64("key", "sim", "id")
        share = F.pmod(order, F.lit(1 << 40)) / float(1 << 40)
        some = pools.join(total, "pool").join(F.broadcast(drawn), "pool").where(share < (1.1 * F.col("n_used") + 300) / F.col("_all"))
        rank = F.row_number().over(W.partitionBy("key", "sim").orderBy(order, "id"))
        found = found.unionByName(_measured_points(some.withColumn("_rank", rank).where(F.col("_rank") <= F.col("n_used")).select("key", "sim", "x", "y"), r))
    return _judged(materialize(found), known, r, n_sim, band or (0.0, float("inf")))


def _judged(measured: DataFrame, known: DataFrame, radii: np.ndarray, n_sim: int, band: tuple[float, float]) -> DataFrame:
    """The statistics of tests from the measures of their patterns, of which number 0 is the observed one."""
    used = [i for i, v in enumerate(radii) if band[0] <= v <= band[1]]
    rows = measured.join(known.select("key", "area"), "key").select("key", "sim", "near", "area", F.posexplode("pairs").alias("i", "share")).where(F.col("i").isin(used))
    level = rows.select("key", "sim", "i", F.sqrt(F.col("area") * F.col("share") / F.pi()).alias("level"))
    mean = level.where("sim > 0").groupBy("key", "i").agg(F.sum("level").alias("total"))
    others = F.when(F.col("sim") == 0, F.col("total") / n_sim).otherwise((F.col("total") - F.col("level")) / (n_sim - 1))
    index = level.join(mean, ["key", "i"]).groupBy("key", "sim").agg((F.avg(F.col("level") / F.greatest(others, F.lit(1e-12))) - 1).alias("di"))
    both = index.join(measured.select("key", "sim", "near"), ["key", "sim"])
    seen = both.where("sim = 0").select("key", F.col("di").alias("own"), F.col("near").alias("own_near"))
    share = lambda n: (1 + n) / F.lit(n_sim + 1)
    low, high = F.count_if(F.col("near") <= F.col("own_near")), F.count_if(F.col("near") >= F.col("own_near"))
    judged = both.where("sim > 0").join(seen, "key").groupBy("key", "own", "own_near").agg(
        share(F.count_if(F.col("di") >= F.col("own"))).alias("p_clustered"), share(F.count_if(F.col("di") <= F.col("own"))).alias("p_regular"),
        F.avg("near").alias("null_near"), F.least(F.lit(1.0), 2 * share(F.least(low, high))).alias("p_ce"),
    )
    return known.join(judged, "key").select(
        "key", "n_cells", "n_used", "area", F.col("own").alias("di"), "p_clustered", "p_regular", (F.col("own_near") / F.col("null_near")).alias("ce"), "p_ce"
    )
