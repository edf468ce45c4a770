"""Superpixels and their features, held against numpy on a small image."""

import math

import numpy as np
from pyspark.sql import functions as F

from lamina.operators import superpixels as S

NX, NY, STEP = 23, 17, 6


def picture():
    rng = np.random.default_rng(6)
    iy, ix = np.mgrid[0:NY, 0:NX]
    base = np.where((ix - 9) ** 2 + (iy - 8) ** 2 < 30, 60, 200)
    return np.clip(base[..., None] + rng.integers(-20, 20, (NY, NX, 3)), 1, 254).astype(float)


def table(spark, image):
    return spark.createDataFrame([(int(x), int(y), *map(float, image[y, x])) for y in range(NY) for x in range(NX)], "ix int, iy int, r double, g double, b double").repartition(3)


def brute(image, compactness, rounds):
    pixels = [(x, y, *image[y, x]) for y in range(NY) for x in range(NX)]
    seeds, cells = {}, {}
    for p in pixels:
        cells.setdefault((p[1] // STEP, p[0] // STEP), []).append(p)
    seeds = {c: np.mean(v, axis=0) for c, v in cells.items()}
    for _ in range(rounds):
        taken = {}
        for p in pixels:
            near = [(p[1] // STEP + dy, p[0] // STEP + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
            d = lambda c, p=p: round(float(((np.array(p[2:]) - seeds[c][2:]) ** 2).sum() + (compactness / STEP) ** 2 * ((np.array(p[:2]) - seeds[c][:2]) ** 2).sum()), 9)
            taken[p[:2]] = min((d(c), c) for c in near if c in seeds)[1]
        groups = {}
        for p in pixels:
            groups.setdefault(taken[p[:2]], []).append(p)
        seeds = {c: np.mean(v, axis=0) for c, v in groups.items()}
    return taken


def test_superpixels_features_and_components(spark):
    image = picture()
    df = table(spark, image)
    segments = S.superpixels(df, ["r", "g", "b"], STEP, 20.0, 3).cache()
    got = {(r.ix, r.iy): (r.seed // S.tiles.WIDE, r.seed % S.tiles.WIDE) for r in segments.collect()}
    assert got == brute(image, 20.0, 3)
    rgb = image / 255
    grey = rgb @ np.array(S.GREY)
    padded = np.pad(grey, 1, mode="symmetric")
    smooth = lambda a, axis: 0.25 * np.take(a, range(a.shape[axis] - 2), axis) + 0.5 * np.take(a, range(1, a.shape[axis] - 1), axis) + 0.25 * np.take(a, range(2, a.shape[axis]), axis)
    gx, gy = smooth((padded[:, 2:] - padded[:, :-2]) / 2, 0), smooth((padded[2:] - padded[:-2]) / 2, 1)
    stain = np.maximum(0, (np.log(np.maximum(rgb, 1e-6)) / math.log(1e-6)) @ np.linalg.inv(np.array(S.STAINS)))
    iy, ix = np.mgrid[0:NY, 0:NX]
    layers = [*np.moveaxis(rgb, 2, 0), *np.moveaxis(stain, 2, 0), -np.log(np.clip(rgb, 1e-4, 1)).mean(axis=2), np.sqrt((gx**2 + gy**2) / 2), ix / (NX - 1), iy / (NY - 1)]
    names = sorted(set(got.values()))
    rows = np.array([[np.mean([layer[y, x] for (x, y), s in got.items() if s == n]) for layer in layers] for n in names])
    want = (rows - rows.mean(axis=0)) / np.maximum(rows.std(axis=0), 1e-6)
    features = S.features(df, segments, NX, NY).cache()
    found = {(r.seed // S.tiles.WIDE, r.seed % S.tiles.WIDE): [r[f] for f in S.FEATURES] for r in features.collect()}
    assert np.allclose(np.array([found[n] for n in names]), want, atol=1e-6)
    components = S.components_of(features, 2)
    labels = segments.join(components, "seed").cache()
    dark = labels.where("ix = 9 and iy = 8").first().component
    assert labels.where("ix > 20").where(F.col("component") == dark).count() == 0
    clean = S.cleaned(labels, 10)
    assert clean.groupBy("component", "part").count().where("count < 10").count() == 0 and clean.count() > 0.8 * NX * NY
