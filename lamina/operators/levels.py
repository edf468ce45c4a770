"""Level sets of gridded fields as interpolated outlines: marching squares in columns, rings joined by pointer doubling.

A field is a table (keys, ix, iy, value) of nodes. An outline crosses grid edges, and a crossing is named by its edge, so
the pieces of one outline meet by name however they are partitioned; no outline comes together in one task before it
is asked for as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Axis
from ..sources.scratch import materialize

#: Corners of a square, and its sides (bottom, right, top, left) as pairs of corners.
CORNERS = [(0, 0), (1, 0), (1, 1), (0, 1)]
SIDES = [(0, 1), (1, 2), (3, 2), (0, 3)]


def steps_of(inside: int, joined: bool) -> list[tuple[int, int]]:
    """Steps from side to side through a square whose corners ``inside`` (bits) reach the level, with these on the left.

    An outline leaves the square where, going round it, the corners go from outside to inside. Of two opposite corners
    each has an outline of its own, unless they are ``joined``; then the other two have.
    """
    on = [inside >> i & 1 for i in range(4)]
    ends = [i for i in range(4) if not on[i] and on[(i + 1) % 4]]  # the side after corner i
    starts = [i for i in range(4) if on[i] and not on[(i + 1) % 4]]
    if len(starts) < 2:
        return list(zip(starts, ends, strict=True))
    # Around a corner c lie the sides c - 1 and c; its outline runs from side c to side c - 1.
    return [(s, (s - 1) % 4 if not joined else (s + 1) % 4) for s in starts]


#: For each set of corners, and then for the two opposite pairs where they are joined, the steps.
STEPS = [steps_of(i, False) for i in range(16)] + [steps_of(5, True), steps_of(10, True)]


def _side(number: Column, of: list[Column]) -> Column:
    return F.element_at(F.array(*of), number + 1)


def segments(field: DataFrame, keys: list[str], level: float, x: Axis, y: Axis, outside: float) -> DataFrame:
    """(keys, a, b, ax, ay, bx, by): steps of the outlines of ``value >= level``, from crossing ``a`` to crossing ``b``, with what reaches the level on the left.

    Nodes stand in the middles of the axes' bins. Nodes that aren't in the field, beyond the grid too, have the value
    ``outside``, which is under the level, so every outline closes. Where opposite corners reach the level they are
    joined if the middle of all four does.
    """
    if outside >= level:
        raise ValueError("what is outside must be under the level")
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), (F.col("ix") - dx).alias("cx"), (F.col("iy") - dy).alias("cy")) for i, (dx, dy) in enumerate(CORNERS)])).alias("s")
    square = field.select(*keys, "ix", "iy", F.col("value").cast("double").alias("value"), corner).groupBy(*keys, F.col("s.cx").alias("cx"), F.col("s.cy").alias("cy"))
    v = [F.coalesce(F.max(F.when(F.col("s.c") == i, F.col("value"))), F.lit(float(outside))).alias(f"v{i}") for i in range(4)]
    q = square.agg(*v)
    bits = sum((F.when(F.col(f"v{i}") >= level, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(4)), F.lit(0))
    middle = (F.col("v0") + F.col("v1") + F.col("v2") + F.col("v3")) / 4 >= level
    case = F.when((bits == 5) & middle, 16).when((bits == 10) & middle, 17).otherwise(bits)
    table = F.array(*[F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in steps]) if steps else F.array().cast("array<struct<s:int,e:int>>") for steps in STEPS])
    q = q.where((bits > 0) & (bits < 15)).withColumn("step", F.explode(F.element_at(table, case + 1)))
    # An edge's name: its lower left node, counted from one beyond the grid, and whether it runs up.
    name = lambda dx, dy, up: F.shiftleft((F.col("cy") + (dy + 1)).cast("bigint"), 32) + (F.col("cx") + (dx + 1)) * 2 + up
    names = [name(0, 0, 0), name(1, 0, 1), name(0, 1, 0), name(0, 0, 1)]
    share = [(level - F.col(f"v{i}")) / F.nullif(F.col(f"v{j}") - F.col(f"v{i}"), F.lit(0.0)) for i, j in SIDES]
    at = lambda c, k: [x.low + (F.col("cx") + CORNERS[i][0] + (CORNERS[j][0] - CORNERS[i][0]) * t + 0.5) * x.step if k == 0 else y.low + (F.col("cy") + CORNERS[i][1] + (CORNERS[j][1] - CORNERS[i][1]) * t + 0.5) * y.step for (i, j), t in zip(SIDES, share, strict=True)]  # noqa: E731, ARG005
    out = [_side(F.col(f"step.{p}"), cols).alias(n) for p, n in (("s", "a"), ("e", "b")) for cols, n in ((names, n), (at("", 0), f"{n}x"), (at("", 1), f"{n}y"))]
    return q.select(*keys, *out).select(*keys, "a", "b", "ax", "ay", "bx", "by")


def rings(steps: DataFrame, keys: list[str], max_rounds: int = 40) -> DataFrame:
    """``steps`` with ``ring``, the least crossing of the closed outline each belongs to.

    Every crossing is left once and reached once. A round knows, for each crossing, the least of the next 2^n and
    where they end, so outlines of any length take as many rounds as their length has bits.
    """
    now = materialize(steps.select(*keys, F.col("a").alias("at"), F.col("b").alias("to"), F.least("a", "b").alias("low")))
    for _ in range(max_rounds):
        ahead = now.select(*keys, F.col("at").alias("to"), F.col("to").alias("far"), F.col("low").alias("far_low"))
        new = materialize(now.join(ahead, [*keys, "to"]).select(*keys, "at", F.col("far").alias("to"), F.least("low", "far_low").alias("low"), (F.col("far_low") < F.col("low")).alias("moved")))
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            return steps.join(now.select(*keys, F.col("at").alias("a"), F.col("low").alias("ring")), [*keys, "a"])
    raise RuntimeError("outlines did not close")


def vertices(ringed: DataFrame, keys: list[str], max_rounds: int = 40) -> DataFrame:
    """(keys, ring, place, x, y): the crossings of each ring in order, the least one first. Places are found by doubling too: the steps from each crossing to the first."""
    end = F.when(F.col("b") == F.col("ring"), F.lit(None)).otherwise(F.col("b"))
    now = materialize(ringed.select(*keys, "ring", F.col("a").alias("at"), end.alias("to"), F.lit(1).cast("bigint").alias("left"), F.col("ax").alias("x"), F.col("ay").alias("y")))
    for _ in range(max_rounds):
        ahead = now.select(*keys, F.col("at").alias("to"), F.col("to").alias("far"), F.col("left").alias("more"))
        now = materialize(now.join(ahead, [*keys, "to"], "left").select(*keys, "ring", "at", F.col("far").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"), "x", "y"))
        if now.where("to is not null").isEmpty():
            size = now.groupBy(*keys, "ring").agg(F.max("left").alias("n"))
            return now.join(size, [*keys, "ring"]).select(*keys, "ring", (F.col("n") - F.col("left")).alias("place"), "x", "y")
    raise RuntimeError("outlines did not close")


def outlines(ringed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ring, corners, area): a row for each ring, outer ones counter-clockwise and of positive area, holes of negative."""
    v = vertices(ringed, keys)
    corners = F.transform(F.sort_array(F.collect_list(F.struct("place", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return v.groupBy(*keys, "ring").agg(corners.alias("corners")).join(ring_sizes(ringed, keys).select(*keys, "ring", "area"), [*keys, "ring"])


def ring_sizes(ringed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ring, n, area, length, x0, x1, y0, y1) of each ring, as sums over its steps in any order."""
    cross = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    return ringed.groupBy(*keys, "ring").agg(
        F.count("*").alias("n"), (F.sum(cross) / 2).alias("area"), F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("length"),
        F.min("ax").alias("x0"), F.max("ax").alias("x1"), F.min("ay").alias("y0"), F.max("ay").alias("y1"),
    )


def enclosing(points: DataFrame, ringed: DataFrame, keys: list[str], point: str, bin_size: float) -> DataFrame:
    """(keys, point, ring, area) of every ring, outer or hole, around each point (keys, point, x, y).

    Points and steps meet by strips of y: a ring encloses a point if to its left as many steps more go one way than the
    other.
    """
    strip = lambda c: F.floor(c / bin_size)
    size = ring_sizes(ringed, keys).select(*keys, "ring", "area")
    walls = ringed.where("ay <> by").withColumn("_s", F.explode(F.sequence(strip(F.least("ay", "by")), strip(F.greatest("ay", "by")))))
    p = points.select(*keys, F.col(point).alias("_p"), F.col("x").alias("_x"), F.col("y").alias("_y"), strip(F.col("y")).alias("_s"))
    met = p.join(walls, [*keys, "_s"]).where((F.col("ay") > F.col("_y")) != (F.col("by") > F.col("_y")))
    cut = F.col("ax") + (F.col("_y") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    turns = F.sum(F.when(cut < F.col("_x"), F.when(F.col("by") < F.col("ay"), 1).otherwise(-1)).otherwise(0))
    found = met.groupBy(*keys, "_p", "ring").agg(turns.alias("turns")).where("turns <> 0")
    return found.join(size, [*keys, "ring"]).select(*keys, F.col("_p").alias(point), "ring", "area")


def parents(ringed: DataFrame, keys: list[str], bin_size: float) -> DataFrame:
    """(keys, ring, outer, area): the smallest outer ring around each hole's first crossing; an outer ring is its own."""
    sizes = materialize(ring_sizes(ringed, keys))
    first = ringed.where("a = ring").join(sizes.where("area < 0").select(*keys, "ring"), [*keys, "ring"]).select(*keys, F.col("ring").alias("hole"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    around = enclosing(first, ringed, keys, "hole", bin_size).where("area > 0")
    found = around.groupBy(*keys, "hole").agg(F.min(F.struct("area", "ring")).alias("m")).select(*keys, F.col("hole").alias("ring"), F.col("m.ring").alias("outer"))
    return sizes.join(found, [*keys, "ring"], "left").select(*keys, "ring", F.coalesce("outer", "ring").alias("outer"), "area")
