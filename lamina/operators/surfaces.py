"""Surfaces of volumes: where a field of voxels reaches a level, as triangles in columns, and what they enclose.

A field is a table (keys, ix, iy, iz, value) of nodes. Cubes are cut into six tetrahedra along their diagonal, alike in all
cubes, so neighbouring triangles meet in vertices that are named by the edge they lie on. Counts, volumes and the
check that a surface is closed are aggregates over names; no mesh comes together in one task.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import Axis
from ..sources.scratch import materialize
from .matching import components

#: Corners of a cube by their bits: 1 along x, 2 along y, 4 along z. Each tetrahedron goes from corner 0 to 7 by one axis after the other.
TETRAHEDRA = [(0, 1 << a, 1 << a | 1 << b, 7) for a, b, _ in permutations(range(3))]


def _at(corner: int) -> tuple[int, int, int]:
    return corner & 1, corner >> 1 & 1, corner >> 2 & 1


def _outward(triangle: list[tuple[int, int]], inside: list[int], outside: list[int]) -> bool:
    """Whether a triangle over the middles of edges turns its counter-clockwise side to the corners outside."""
    p, q, r = ([sum(c) / 2 for c in zip(*map(_at, e), strict=True)] for e in triangle)
    u, v = [b - a for a, b in zip(p, q, strict=True)], [b - a for a, b in zip(p, r, strict=True)]
    normal = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    mean = lambda some: [sum(c) / len(some) for c in zip(*map(_at, some), strict=True)]
    return sum(n * (b - a) for n, a, b in zip(normal, mean(inside), mean(outside), strict=True)) > 0


def triangle_table() -> list[tuple[int, ...]]:
    """(tetrahedron, corners over the level as bits, then the two corners of each of three edges) of all triangles, the low corner of an edge first."""
    rows = []
    for t, corners in enumerate(TETRAHEDRA):
        for bits in range(1, 15):
            inside, outside = [c for i, c in enumerate(corners) if bits >> i & 1], [c for i, c in enumerate(corners) if not bits >> i & 1]
            edge = lambda a, b: (min(a, b), max(a, b))
            if len(inside) == 2:
                (a, b), (c, d) = inside, outside
                found = [[edge(a, c), edge(a, d), edge(b, d)], [edge(a, c), edge(b, d), edge(b, c)]]
            else:
                one, rest = (inside[0], outside) if len(inside) == 1 else (outside[0], inside)
                found = [[edge(one, c) for c in rest]]
            for tri in found:
                tri = tri if _outward(tri, inside, outside) else tri[::-1]
                rows.append((t, bits, *(c for e in tri for c in e)))
    return rows


def triangles(field: DataFrame, keys: list[str], level: float, axes: tuple[Axis, Axis, Axis], outside: float) -> DataFrame:
    """(keys, a, b, c, ax .. cz): the triangles of the surface of ``value >= level``, counter-clockwise seen from outside.

    Nodes stand in the middles of the axes' bins; those that aren't in the field, beyond the grid too, have the value
    ``outside``, which is under the level, so every surface is closed. The table of triangles has 120 rows.
    """
    if outside >= level:
        raise ValueError("what is outside must be under the level")
    spread = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), *[(F.col(f"i{n}") - d).alias(n) for n, d in zip("xyz", _at(c), strict=True)]) for c in range(8)])).alias("s")
    cube = field.select(*keys, "ix", "iy", "iz", F.col("value").cast("double").alias("value"), spread).groupBy(*keys, *[F.col(f"s.{n}").alias(f"c{n}") for n in "xyz"])
    cube = cube.agg(F.array(*[F.coalesce(F.max(F.when(F.col("s.c") == c, F.col("value"))), F.lit(float(outside))) for c in range(8)]).alias("v"))
    cube = cube.where((F.array_max("v") >= level) & (F.array_min("v") < level))
    over = lambda corners: sum((F.when(F.col("v")[c] >= level, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(corners)), F.lit(0))
    tets = cube.withColumn("t", F.explode(F.array(*[F.struct(F.lit(t).alias("tet"), over(c).alias("bits")) for t, c in enumerate(TETRAHEDRA)])))
    names = ["tet", "bits", "a0", "a1", "b0", "b1", "c0", "c1"]
    table = F.broadcast(field.sparkSession.createDataFrame(triangle_table(), ", ".join(f"{n} int" for n in names)))
    met = tets.select(*keys, "cx", "cy", "cz", "v", "t.tet", "t.bits").join(table, ["tet", "bits"])
    out = []
    for p in "abc":
        low, high = F.col(f"{p}0"), F.col(f"{p}1")
        bit = lambda c, k: F.shiftright(c, k).bitwiseAND(F.lit(1))
        share = (level - F.element_at("v", low + 1)) / F.nullif(F.element_at("v", high + 1) - F.element_at("v", low + 1), F.lit(0.0))
        name: Column = F.lit(0).cast("bigint")
        for k, n in enumerate("zyx"):
            name = F.shiftleft(name, 20) + (F.col(f"c{n}") + bit(low, 2 - k) + 1)
        out.append((F.shiftleft(name, 3) + (high - low)).alias(p))
        out += [(axis.low + (F.col(f"c{n}") + bit(low, k) + (bit(high, k) - bit(low, k)) * share + 0.5) * axis.step).alias(f"{p}{n}") for k, (n, axis) in enumerate(zip("xyz", axes, strict=True))]
    return met.select(*keys, *out)


def _edges(mesh: DataFrame, keys: list[str]) -> DataFrame:
    e = mesh.select(*keys, F.explode(F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("w")) for p, q in ("ab", "bc", "ca")])).alias("e"))
    return e.select(*keys, "e.u", "e.w")


def summary(mesh: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_faces, n_vertices, n_edges, euler, n_open_edges, area, volume): edges of other than two triangles are open, and a closed surface has none."""
    p, q, r = ([F.col(f"{c}{n}") for n in "xyz"] for c in "abc")
    cross = lambda s, t: [s[1] * t[2] - s[2] * t[1], s[2] * t[0] - s[0] * t[2], s[0] * t[1] - s[1] * t[0]]
    minus = lambda s, t: [x - y for x, y in zip(s, t, strict=True)]
    n = cross(minus(q, p), minus(r, p))
    size = mesh.groupBy(*keys).agg(F.count("*").alias("n_faces"), (F.sum(F.sqrt(sum(x * x for x in n))) / 2).alias("area"), (F.sum(sum(x * y for x, y in zip(p, cross(q, r), strict=True))) / 6).alias("volume"))
    points = mesh.select(*keys, F.explode(F.array("a", "b", "c")).alias("v")).distinct().groupBy(*keys).agg(F.count("*").alias("n_vertices"))
    lines = _edges(mesh, keys).groupBy(*keys, "u", "w").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.count("*").alias("n_edges"), F.count_if(F.col("n") != 2).alias("n_open_edges"))
    both = size.join(points, keys).join(lines, keys)
    return both.select(*keys, "n_faces", "n_vertices", "n_edges", (F.col("n_vertices") - F.col("n_edges") + F.col("n_faces")).alias("euler"), "n_open_edges", "area", "volume")


def parts(mesh: DataFrame, keys: list[str]) -> DataFrame:
    """``mesh`` with ``part``, the least vertex of each connected surface."""
    node = lambda c: F.struct(*keys, F.col(c).alias("v"))
    mesh = materialize(mesh)
    found = components(_edges(mesh, keys).distinct().select(node("u").alias("u"), node("w").alias("w")), "u", "w")
    return mesh.join(found.select("node.*", F.col("component.v").alias("part")).withColumnRenamed("v", "a"), [*keys, "a"])


def large_parts(mesh: DataFrame, keys: list[str], least_faces: int) -> DataFrame:
    """``mesh`` (with ``part``) without surfaces of fewer triangles."""
    keep = mesh.groupBy(*keys, "part").agg(F.count("*").alias("n")).where(F.col("n") >= least_faces).drop("n")
    return mesh.join(keep, [*keys, "part"], "left_semi")


def vertices(mesh: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, x, y, z) of each vertex once."""
    v = mesh.select(*keys, F.explode(F.array(*[F.struct(F.col(p).alias("v"), *[F.col(f"{p}{n}").alias(n) for n in "xyz"]) for p in "abc"])).alias("p"))
    return v.groupBy(*keys, F.col("p.v").alias("v")).agg(*[F.min(f"p.{n}").alias(n) for n in "xyz"])


def smoothed(mesh: DataFrame, keys: list[str], rounds: int, share: float = 0.5) -> DataFrame:
    """``mesh`` whose vertices have gone ``rounds`` times by ``share`` towards the mean of their neighbours."""
    mesh = materialize(mesh)
    e = _edges(mesh, keys).distinct()
    both = materialize(e.unionByName(e.select(*keys, F.col("w").alias("u"), F.col("u").alias("w"))))
    at = vertices(mesh, keys)
    for _ in range(rounds):
        near = both.join(at.withColumnRenamed("v", "w"), [*keys, "w"]).groupBy(*keys, F.col("u").alias("v")).agg(*[F.avg(n).alias(f"m{n}") for n in "xyz"])
        at = materialize(at.join(near, [*keys, "v"]).select(*keys, "v", *[(F.col(n) + share * (F.col(f"m{n}") - F.col(n))).alias(n) for n in "xyz"]))
    out = mesh.drop(*[f"{p}{n}" for p in "abc" for n in "xyz"])
    for p in "abc":
        out = out.join(at.withColumnsRenamed({"v": p, **{n: f"{p}{n}" for n in "xyz"}}), [*keys, p])
    return out.select(mesh.columns)


def write_ply(mesh: DataFrame, path: str) -> None:
    """One PLY file a part (``mesh`` has ``part``), in the folder of its name: header, vertices, triangles (K6). Vertices are numbered by sorting, so no part is held in memory."""
    v = vertices(mesh, ["part"]).withColumn("no", F.row_number().over(Window.partitionBy("part").orderBy("v")) - 1)
    v = materialize(v)
    head = v.groupBy("part").agg(F.count("*").alias("nv")).join(mesh.groupBy("part").agg(F.count("*").alias("nf")), "part")
    text = ["ply", "format ascii 1.0", "element vertex %d", "property double x", "property double y", "property double z", "element face %d", "property list uchar int vertex_indices", "end_header"]
    lines = head.select("part", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("no"), F.format_string("\n".join(text), "nv", "nf").alias("value"))
    lines = lines.unionByName(v.select("part", F.lit(1).alias("kind"), F.col("no").cast("bigint").alias("no"), F.concat_ws(" ", "x", "y", "z").alias("value")))
    faces = mesh.select("part", "a", "b", "c")
    for p in "abc":
        faces = faces.join(v.select("part", F.col("v").alias(p), F.col("no").alias(f"n{p}")), ["part", p])
    lines = lines.unionByName(faces.select("part", F.lit(2).alias("kind"), F.col("na").cast("bigint").alias("no"), F.concat_ws(" ", F.lit("3"), "na", "nb", "nc").alias("value")))
    lines.repartition("part").sortWithinPartitions("part", "kind", "no", "value").select("part", "value").write.mode("overwrite").partitionBy("part").text(path)
