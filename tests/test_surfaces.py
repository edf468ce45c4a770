"""Surfaces of voxel fields: closed, of the right shape, and of the volume that their tetrahedra have."""

import math

import numpy as np
from pyspark.sql import functions as F

from lamina.functions.grid import Axis
from lamina.operators import surfaces

AXES = (Axis(0.0, 12.0, 12), Axis(0.0, 11.0, 11), Axis(0.0, 20.0, 10))


def table(spark, fields):
    rows = [(k, int(ix), int(iy), int(iz), float(v)) for k, f in fields.items() for (ix, iy, iz), v in np.ndenumerate(f) if v > 0]
    return spark.createDataFrame(rows, "k string, ix int, iy int, iz int, value double").repartition(3)


def brute_volume(field, level):
    """Sum over all tetrahedra of the part over the level, each cut by sampling its barycentric form exactly: corners' products."""
    f = np.zeros([n + 2 for n in field.shape])
    f[1:-1, 1:-1, 1:-1] = field
    total = 0.0
    for x, y, z in np.argwhere(np.ones([n - 1 for n in f.shape])):
        for corners in surfaces.TETRAHEDRA:
            v = [f[x + (c & 1), y + (c >> 1 & 1), z + (c >> 2 & 1)] for c in corners]
            over = [a for a in v if a >= level]
            under = [a for a in v if a < level]
            if len(over) == 4:
                share = 1.0
            elif len(over) == 1 or len(under) == 1:
                one, rest = (over[0], under) if len(over) == 1 else (under[0], over)
                share = math.prod((level - one) / (b - one) for b in rest)
                share = share if len(over) == 1 else 1 - share
            elif len(over) == 2:
                (a, b), (c, d) = over, under
                t = {(p, q): (level - p) / (q - p) for p in (a, b) for q in (c, d)}
                ac, ad, bc, bd = t[a, c], t[a, d], t[b, c], t[b, d]
                share = ac * ad + bc * bd * (1 - ac) + bd * ac * (1 - ad)  # a wedge as three tetrahedra
            else:
                share = 0.0
            total += share / 6
    return total


def test_closed_surfaces_and_volumes(spark, tmp_path):
    ix, iy, iz = np.mgrid[0:12, 0:11, 0:10]
    ball = np.maximum(0, 4 - np.sqrt((ix - 5.2) ** 2 + (iy - 5.1) ** 2 + (iz - 4.6) ** 2))
    ring = np.maximum(0, 1.6 - np.sqrt((np.hypot(ix - 5.3, iy - 5.2) - 3.2) ** 2 + (iz - 4.4) ** 2))
    noise = np.random.default_rng(1).random((12, 11, 10))
    fields = {"ball": ball, "ring": ring, "noise": noise}
    mesh = surfaces.triangles(table(spark, fields), ["k"], 0.55, AXES, 0.0).cache()
    rows = {r.k: r for r in surfaces.summary(mesh, ["k"]).collect()}
    for k, f in fields.items():
        assert rows[k].n_open_edges == 0 or k == "noise"
        assert 2 * rows[k].n_edges == 3 * rows[k].n_faces or k == "noise"
        assert math.isclose(rows[k].volume, 2 * brute_volume(f, 0.55), rel_tol=1e-9)
    assert rows["ball"].euler == 2 and rows["ring"].euler == 0
    assert 0.85 < rows["ball"].volume / (2 * 4 / 3 * math.pi * 3.45**3) < 1.0
    split = surfaces.parts(mesh.where("k <> 'noise'"), ["k"]).cache()
    assert split.groupBy("k").agg(F.countDistinct("part").alias("n")).where("n <> 1").count() == 0 and split.count() == rows["ball"].n_faces + rows["ring"].n_faces
    assert surfaces.large_parts(split, ["k"], rows["ring"].n_faces + 1).select("k").distinct().count() == (rows["ball"].n_faces > rows["ring"].n_faces)
    round_ = {r.k: r for r in surfaces.summary(surfaces.smoothed(split, ["k"], 3).drop("part"), ["k"]).collect()}
    for k in ("ball", "ring"):
        assert round_[k].euler == rows[k].euler and round_[k].n_open_edges == 0 and round_[k].area < rows[k].area
    surfaces.write_ply(split.where("k = 'ball'"), str(tmp_path / "ply"))
    (folder,) = (p for p in (tmp_path / "ply").iterdir() if p.name.startswith("part="))
    lines = "\n".join(f.read_text() for f in sorted(folder.glob("part-*"))).strip().split("\n")
    n, m = rows["ball"].n_vertices, rows["ball"].n_faces
    assert lines[0] == "ply" and lines[2] == f"element vertex {n}" and lines[6] == f"element face {m}" and len(lines) == 9 + n + m
    xyz = np.array([list(map(float, x.split())) for x in lines[9 : 9 + n]])
    faces = np.array([list(map(int, x.split()))[1:] for x in lines[9 + n :]])
    a, b, c = (xyz[faces[:, i]] for i in range(3))
    assert math.isclose(float((a * np.cross(b, c)).sum() / 6), rows["ball"].volume, rel_tol=1e-6)
