"""Stacks and orientations, held against plain loops over all slices and all paths."""

import itertools
import math
import random

from lamina.operators import orientation, stacks


def test_composition_is_that_of_a_loop(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for stack, n in (("long", 1000), ("short", 3), ("one", 1)):
        a, t = 1 + 0j, 0j
        for i in range(n):
            turn, size, dx, dy = rng.uniform(-20, 20), rng.uniform(0.97, 1.03), rng.uniform(-5, 5), rng.uniform(-5, 5)
            rows.append((stack, 3 * i - 7, turn, size, dx, dy))
            s = size * complex(math.cos(math.radians(turn)), math.sin(math.radians(turn)))
            a, t = a * s, a * complex(dx, dy) + t
            want[stack, 3 * i - 7] = (a, t)
    df = spark.createDataFrame(rows, "stack string, slice int, rotation double, scale double, dx double, dy double").repartition(5)
    got = stacks.composed(df, ["stack"], "slice", 16).collect()
    assert len(got) == len(want)
    for r in got:
        a, t = want[r.stack, r.slice]
        s = r.scale * complex(math.cos(math.radians(r.rotation)), math.sin(math.radians(r.rotation)))
        assert abs(s - a) < 1e-9 * abs(a) and abs(complex(r.dx, r.dy) - t) < 1e-8 * max(1, abs(t))
    assert stacks.composed(df.where("false"), ["stack"], "slice").count() == 0
    first = stacks.identity_first(df.where("slice > -7"), df, ["stack"], "slice")
    assert first.count() == 1004 and first.where("scale = 1 and dx = 0").count() >= 3


def test_two_best_paths_are_those_of_all(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for g in range(12):
        n = g % 12 + 1
        score = [[[rng.choice([0.0, 0.25, 0.5, rng.random()]) for _ in "01"] for _ in "01"] for _ in range(n)]
        rows += [(g, i, *score[i][0], *score[i][1]) for i in range(n)]
        paths = sorted((-sum(score[i][p[i]][p[i + 1]] for i in range(n)), "".join(map(str, p))) for p in itertools.product((0, 1), repeat=n + 1))
        want[g] = (n, paths[0], paths[1])
    df = spark.createDataFrame(rows, "g int, i int, s00 double, s01 double, s10 double, s11 double").repartition(3)
    support = spark.createDataFrame([(0, 0.1), (1, 0.9)], "g int, support double")
    for r in orientation.two_best(df, ["g"], "i", 0.05, support).collect():
        n, (a, first), (b, second) = want[r.g]
        assert r.n_edges == n and abs(r.score + a) < 1e-9 and abs(r.second_score + b) < 1e-9 and abs(r.margin - (b - a) / n) < 1e-9
        assert abs(a - b) < 1e-9 or (r.path, r.second if abs(b - a) > 1e-9 else second) == (first, r.second)
        assert ("score_margin_below_threshold" in r.reasons) == (r.margin < 0.05) and ("bootstrap" in r.reasons) == (r.g == 0)
