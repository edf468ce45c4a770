"""Keyed rasters worked on tile by tile: parts, floods and distances of masks of any size.

A mask or field is a table (keys, ix, iy, ...) of its bins. Bins of one tile come together as one bounded array; tiles
tell one another only what stands at their borders, in rounds that end when nothing there changes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .matching import components

SIZE = 128
#: Bins in one row of the numbers that name bins, row by row.
WIDE = 1 << 31


def tiles(bins: DataFrame, keys: list[str], values: list[str], size: int = SIZE) -> DataFrame:
    """(keys, tx, ty, bins): the bins of each tile as an array of (at, values), ``at`` counting row by row within the tile."""
    at = (F.pmod("iy", F.lit(size)) * size + F.pmod("ix", F.lit(size))).cast("int").alias("at")
    place = [F.floor(F.col(f"i{c}") / size).cast("int").alias(f"t{c}") for c in "xy"]
    return bins.select(*keys, *place, F.struct(at, *values).alias("b")).groupBy(*keys, "tx", "ty").agg(F.sort_array(F.collect_list("b")).alias("bins"))


def _local_parts(at: np.ndarray, size: int) -> np.ndarray:
    """For each of the sorted bins of a tile the first bin of its four-connected part."""
    where = np.full(size * size, -1)
    where[at] = np.arange(len(at))
    right, up = where[np.minimum(at + 1, size * size - 1)], where[np.minimum(at + size, size * size - 1)]
    pairs = [np.flatnonzero((right >= 0) & (at % size < size - 1)), np.flatnonzero((up >= 0) & (at < size * (size - 1)))]
    a, b = np.concatenate(pairs), np.concatenate([right[pairs[0]], up[pairs[1]]])
    label = np.arange(len(at))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (label[a], label[b], a, b):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def parts(mask: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """(keys, ix, iy, part): four-connected parts of each key's mask, named by the number iy * WIDE + ix of their first bin.

    Tiles find their own parts; only parts that touch a bin across a tile's border are nodes of the graph that joins them.
    """
    fields = ", ".join(f"{k} {mask.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.to_dict("records"):
                at = np.array([b["at"] for b in row["bins"]])
                x, y = row["tx"] * size + at % size, row["ty"] * size + at // size
                name = (y.astype(np.int64) * WIDE + x)[_local_parts(at, size)]
                yield pd.DataFrame({**{k: [row[k]] * len(at) for k in keys}, "ix": x.astype("int32"), "iy": y.astype("int32"), "part": name})

    own = materialize(tiles(mask.select(*keys, "ix", "iy").distinct(), keys, [], size).mapInPandas(run, f"{fields}, ix int, iy int, part bigint"))
    node = lambda c: F.struct(*keys, c)
    step = lambda dx, dy: own.where((F.pmod("ix", F.lit(size)) == size - 1) if dx else (F.pmod("iy", F.lit(size)) == size - 1)).select(*keys, (F.col("ix") + dx).alias("ix"), (F.col("iy") + dy).alias("iy"), F.col("part").alias("from"))
    met = step(1, 0).unionByName(step(0, 1)).join(own, [*keys, "ix", "iy"])
    edges = materialize(met.select(node(F.col("from").alias("part")).alias("a"), node("part").alias("b")).distinct())
    if edges.isEmpty():
        return own
    whole = components(edges, "a", "b").select(F.col("node.*"), F.col("component.part").alias("whole"))
    return own.join(whole, [*keys, "part"], "left").select(*keys, "ix", "iy", F.coalesce("whole", "part").alias("part"))


def _flooded(at: list[int], level: list[float], marker: list[int | None], told: list[tuple[int, float, int, int]], size: int) -> dict[int, tuple[float, int, int]]:
    """(level, generation, label) of each bin of a tile that the flood reaches, from its markers and what the neighbours tell."""
    height = dict(zip(at, level, strict=True))
    heap = [(v, 0, m, p) for p, v, m in zip(at, level, marker, strict=True) if m is not None]
    fixed = {p for _, _, _, p in heap}

    def arrive(p: int, h: float, g: int, label: int) -> None:
        if p in height and p not in fixed:
            heap.append((h, g + 1, label, p) if height[p] <= h else (height[p], 0, label, p))

    for p, h, g, label in told:
        arrive(p, h, g, label)
    heapq.heapify(heap)
    done: dict[int, tuple[float, int, int]] = {}
    while heap:
        h, g, label, p = heapq.heappop(heap)
        if p in done:
            continue
        done[p] = (h, g, label)
        x = p % size
        for q, ok in ((p - 1, x > 0), (p + 1, x < size - 1), (p - size, True), (p + size, True)):
            if ok and q in height and q not in done and q not in fixed:
                heapq.heappush(heap, (h, g + 1, label, q) if height[q] <= h else (height[q], 0, label, q))
    return done


def flood(field: DataFrame, keys: list[str], size: int = SIZE, max_rounds: int = 200) -> DataFrame:
    """(keys, ix, iy, level, label): marker-controlled watershed of bins (keys, ix, iy, level, marker), marker null where there is none.

    Water rises from the markers. A bin is taken by the neighbour it is reached from at the lowest level, within a level
    in the fewest steps since the level was reached, of equal ones by the smallest label; markers keep their bins. That
    rule fixes the result whatever the tiles: a bin's (level, steps) is the least that its four neighbours' allow, and
    each of those comes strictly before it, so solving tiles anew from their borders until borders rest gives it.
    """
    types = ", ".join(f"{k} {field.schema[k].dataType.simpleString()}" for k in keys)
    held = materialize(tiles(field.select(*keys, "ix", "iy", F.col("level").cast("double").alias("level"), F.col("marker").cast("bigint").alias("marker")), keys, ["level", "marker"], size))

    def solved(f: pd.DataFrame) -> Iterator[tuple[dict, dict]]:
        for row in f.to_dict("records"):
            at, level, marker = ([b[c] for b in row["bins"]] for c in ("at", "level", "marker"))
            told = row["told"]
            yield row, _flooded(at, level, marker, [] if told is None else [(m["at"], m["level"], m["steps"], m["label"]) for m in told], size)

    def border(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for row, done in solved(f):
                key = [row[k] for k in keys]
                for p, (h, g, label) in done.items():
                    x, y = p % size, p // size
                    for edge, dx, dy, to in ((x == 0, -1, 0, p + size - 1), (x == size - 1, 1, 0, p - size + 1), (y == 0, 0, -1, p + size * (size - 1)), (y == size - 1, 0, 1, p - size * (size - 1))):
                        if edge:
                            rows.append((*key, row["tx"] + dx, row["ty"] + dy, to, h, g, label))
            if rows:
                yield pd.DataFrame(rows, columns=[*keys, "tx", "ty", "at", "level", "steps", "label"])

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row, done in solved(f):
                if not done:
                    continue
                p = np.array(list(done), dtype=np.int64)
                h, _, label = zip(*done.values(), strict=True)
                yield pd.DataFrame({**{k: [row[k]] * len(p) for k in keys}, "ix": (row["tx"] * size + p % size).astype("int32"), "iy": (row["ty"] * size + p // size).astype("int32"), "level": np.array(h, dtype=float), "label": np.array(label, dtype=np.int64)})

    tell = f"{types}, tx int, ty int, at int, level double, steps int, label bigint"
    messages = field.sparkSession.createDataFrame([], tell)
    seen = None
    for _ in range(max_rounds):
        told = messages.groupBy(*keys, "tx", "ty").agg(F.collect_list(F.struct("at", "level", "steps", "label")).alias("told"))
        with_told = held.join(told, [*keys, "tx", "ty"], "left")
        messages = materialize(with_told.mapInPandas(border, tell))
        now = messages.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*messages.columns)).alias("x"), F.sum("steps").alias("s")).first()
        if now == seen:
            return with_told.mapInPandas(whole, f"{types}, ix int, iy int, level double, label bigint")
        seen = now
    raise RuntimeError(f"the flood did not rest in {max_rounds} rounds")


def squared_distances(sources: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ix, iy, d2): from each target bin to the nearest source bin of its key, in squared bins; keys without sources are absent.

    A pass over columns gives every row the distance along each column, a pass over rows the least over columns. What comes
    together is one row of one raster.
    """
    types = ", ".join(f"{k} {sources.schema[k].dataType.simpleString()}" for k in keys)
    rows = targets.select(*keys, "iy").distinct()
    column = sources.groupBy(*keys, "ix").agg(F.sort_array(F.collect_set("iy")).alias("ys"))
    wanted = rows.groupBy(*keys).agg(F.sort_array(F.collect_set("iy")).alias("rows"))

    def along(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.to_dict("records"):
                ys, at = np.asarray(row["ys"]), np.asarray(row["rows"])
                k = np.searchsorted(ys, at)
                near = np.minimum(np.abs(at - ys[np.maximum(k - 1, 0)]), np.abs(at - ys[np.minimum(k, len(ys) - 1)]))
                yield pd.DataFrame({**{k: [row[k]] * len(at) for k in keys}, "iy": at.astype("int32"), "cx": np.full(len(at), row["ix"], dtype="int32"), "gap": near.astype("int64")})

    def across(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.to_dict("records"):
                c = np.array([(b["cx"], b["gap"]) for b in row["columns"]], dtype=np.int64)
                x = np.unique(np.asarray(row["xs"], dtype=np.int64))
                d2 = np.concatenate([((x[s : s + 512, None] - c[None, :, 0]) ** 2 + c[None, :, 1] ** 2).min(axis=1) for s in range(0, len(x), 512)])
                yield pd.DataFrame({**{k: [row[k]] * len(x) for k in keys}, "ix": x.astype("int32"), "iy": np.full(len(x), row["iy"], dtype="int32"), "d2": d2})

    gaps = column.join(wanted, keys).mapInPandas(along, f"{types}, iy int, cx int, gap bigint")
    by_row = gaps.groupBy(*keys, "iy").agg(F.collect_list(F.struct("cx", "gap")).alias("columns"))
    asked = targets.groupBy(*keys, "iy").agg(F.collect_set("ix").alias("xs"))
    return asked.join(by_row, [*keys, "iy"]).mapInPandas(across, f"{types}, ix int, iy int, d2 bigint")


def dilated(mask: DataFrame, keys: list[str], steps: list[tuple[int, int]]) -> DataFrame:
    """Bins that some step from a bin of the mask leads to."""
    near = F.explode(F.array(*[F.struct((F.col("ix") + dx).alias("ix"), (F.col("iy") + dy).alias("iy")) for dx, dy in steps])).alias("n")
    return mask.select(*keys, near).select(*keys, "n.ix", "n.iy").distinct()


def eroded(mask: DataFrame, keys: list[str], steps: list[tuple[int, int]]) -> DataFrame:
    """Bins all of whose steps lead into the mask."""
    near = F.explode(F.array(*[F.struct((F.col("ix") - dx).alias("ix"), (F.col("iy") - dy).alias("iy")) for dx, dy in steps])).alias("n")
    met = mask.select(*keys, "ix", "iy").distinct().select(*keys, near).groupBy(*keys, F.col("n.ix").alias("ix"), F.col("n.iy").alias("iy")).agg(F.count("*").alias("n"))
    return met.where(F.col("n") == len(steps)).select(*keys, "ix", "iy")


def disk(radius: int) -> list[tuple[int, int]]:
    return [(x, y) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1) if x * x + y * y <= radius * radius]


def holes(mask: DataFrame, keys: list[str], nx: int, ny: int, size: int = SIZE) -> DataFrame:
    """Bins of the parts of each key's complement that don't touch the border of the nx * ny raster."""
    every = mask.select(*keys).distinct().withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    rest = materialize(parts(every.join(mask.select(*keys, "ix", "iy"), [*keys, "ix", "iy"], "left_anti"), keys, size))
    return rest.join(at_border(rest, nx, ny).select(*keys, "part").distinct(), [*keys, "part"], "left_anti").select(*keys, "ix", "iy")


def at_border(bins: DataFrame, nx: int, ny: int) -> DataFrame:
    return bins.where((F.col("ix") == 0) | (F.col("iy") == 0) | (F.col("ix") == nx - 1) | (F.col("iy") == ny - 1))


def large(mask: DataFrame, keys: list[str], least: int, size: int = SIZE) -> DataFrame:
    """(keys, ix, iy, part) of parts of ``least`` bins or more."""
    found = materialize(parts(mask, keys, size))
    return found.join(found.groupBy(*keys, "part").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n"), [*keys, "part"], "left_semi")
