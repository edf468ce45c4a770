"""Splitting of label groups along a tree of labels, where a split lowers the clusters' dispersion.

The tree comes from a matrix of labels and is as small as the label set, so it and the choices along it live on the
driver. Everything that depends on cells is a Spark job: the order in which branches are taken depends on their heights
alone, so the partitions of all steps are known beforehand, and all tests of all steps run as one table of tests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import Axis
from ..sources.scratch import materialize
from .latent import linkage
from .patterns import pattern_tests
from .structure import ultrametric_violations

#: Given groups of labels, the bins (ix, iy, structure_id) of a partition with the groups numbered from 1.
Partition = Callable[[list[list[str]]], DataFrame]
RULES = ("extract_top_branch", "split_parent", "stop")


@dataclass
class Branch:
    height: float
    leaves: list[str]
    children: list[Branch] = field(default_factory=list)
    name: str = ""

    def inner(self) -> Iterator[Branch]:
        """The branch points at and below this one, each before what is below it."""
        if self.children:
            yield self
            for c in self.children:
                yield from c.inner()


def label_rows(matrix: DataFrame, labels: list[str] | None = None) -> tuple[list[str], np.ndarray]:
    """Labels and symmetric distances of a long label matrix (a, b, distance). Raises ValueError for a label without a row, or fewer than two."""
    rows = matrix.select("a", "b", "distance").collect()
    known = sorted({r.a for r in rows})
    if missing := sorted(set(labels or known) - set(known)):
        raise ValueError(f"labels without a row: {', '.join(missing)}")
    keep = [k for k in known if labels is None or k in set(labels)]
    if len(keep) < 2:
        raise ValueError("a tree needs two labels or more")
    at = {k: i for i, k in enumerate(keep)}
    d = np.zeros((len(keep), len(keep)))
    for r in rows:
        if r.a in at and r.b in at:
            d[at[r.a], at[r.b]] = r.distance
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0)
    return keep, d


def tree_of(matrix: DataFrame, labels: list[str] | None = None) -> Branch:
    """The tree that an ultrametric label matrix encodes; branch points are named N1, N2, ... from the highest on. Raises ValueError if it is none."""
    if not ultrametric_violations(matrix).isEmpty():
        raise ValueError("the label matrix is not ultrametric")
    names, d = label_rows(matrix, labels)
    parts = [Branch(0.0, [n], name=f"C{n}") for n in names]
    for a, b, h in linkage(d, "single"):
        parts.append(Branch(h, parts[a].leaves + parts[b].leaves, [parts[a], parts[b]]))
    order = {id(b): i for i, b in enumerate(parts)}
    for i, b in enumerate(sorted(parts[-1].inner(), key=lambda b: (-b.height, order[id(b)])), 1):
        b.name = f"N{i}"
    return parts[-1]


def steps_of(root: Branch) -> list[tuple[Branch, list[Branch]]]:
    """(branch point, parts after it is taken) from the highest branch point down."""
    parts, out = [root], []
    while points := [p for p in parts if p.children]:
        taken = min(points, key=lambda p: int(p.name[1:]))
        parts = [p for p in parts if p is not taken] + taken.children
        out.append((taken, parts))
    return out


def hotspot_groups(root: Branch, name: str, hot: set[str], slack: float = 1e-6) -> list[tuple[str, list[str], float | None]]:
    """(name, labels, height): branches that are all hot or hold none, cut from the top; the cold ones together are ``name.rest``.

    Merges of one height are one branch point with many children.
    """
    tie = slack * max(1.0, root.height)

    def parts(b: Branch, height: float) -> Iterator[Branch]:
        for c in b.children:
            if c.children and abs(c.height - height) <= tie:
                yield from parts(c, height)
            else:
                yield c

    def cut(b: Branch) -> Iterator[Branch]:
        if len(hot & set(b.leaves)) in (0, len(b.leaves)):
            yield b
        else:
            for c in parts(b, b.height):
                yield from cut(c)

    found = list(cut(root))
    out: list[tuple[str, list[str], float | None]] = [(f"{name}.{i}", b.leaves, b.height) for i, b in enumerate([b for b in found if hot & set(b.leaves)], 1)]
    cold = [x for b in found if not hot & set(b.leaves) for x in b.leaves]
    return [*out, (f"{name}.rest", cold, None)] if cold else out


@dataclass
class Exploration:
    """What the branch points do: index before and after for each label, from which any cut of the tree follows."""

    root: Branch
    baseline: dict[str, tuple[float, float]]
    #: (branch, label, child, before, after, p, cells, cells in the child)
    rows: list[tuple[str, str, str, float, float, float, int, int]]

    def gains(self) -> dict[str, dict[str, float]]:
        out: dict[str, dict[str, float]] = {b.name: {} for b in self.root.inner()}
        for branch, label, _, before, after, *_ in self.rows:
            out[branch][label] = before - after
        return out

    def gain(self) -> dict[str, float]:
        return {b: float(np.nansum(list(g.values()) or [0.0])) for b, g in self.gains().items()}

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row for each branch point and label."""
        return spark.createDataFrame(self.rows, "branch string, label string, child string, before double, after double, p_after double, n bigint, n_inside bigint")

    def branches(self, spark: SparkSession) -> DataFrame:
        """(branch, step, height, n_labels, labels, before, after, gain, place): places fall with the gain, in order of steps where equal."""
        gain, steps = self.gain(), [b for b, _ in steps_of(self.root)]
        place = {b.name: i for i, b in enumerate(sorted(steps, key=lambda b: -gain[b.name]), 1)}
        total = lambda b, i: float(np.nansum([r[i] for r in self.rows if r[0] == b.name] or [0.0]))
        rows = [(b.name, k, b.height, len(b.leaves), ",".join(b.leaves), total(b, 3), total(b, 4), gain[b.name], place[b.name]) for k, b in enumerate(steps, 1)]
        return spark.createDataFrame(rows, "branch string, step int, height double, n_labels int, labels string, before double, after double, gain double, place int")


def _tested(cells: DataFrame, groupings: dict[int, list[list[str]]], asked: list[tuple[int, str]], partition: Partition, x: Axis, y: Axis, radii: list[float], **options) -> dict[tuple[int, str], tuple[float, float, int]]:
    """(index, p, cells) of each asked (step, label), measured in its group's bins of that step's partition; step 0 is the whole tissue, whatever the bins."""
    spark = cells.sparkSession
    bins = None
    for step in sorted({s for s, _ in asked}):
        b = partition(groupings[step]).where("structure_id > 0").select(F.lit(step).alias("step"), "ix", "iy", F.col("structure_id").cast("int").alias("structure_id"))
        bins = b if bins is None else bins.unionByName(b)
    bins = materialize(bins)
    of = {(s, label): i for s, groups in groupings.items() for i, g in enumerate(groups, 1) for label in g}
    table = spark.createDataFrame([(s, label, of[(s, label)], f"{s}|{label}", f"{s}|{of[(s, label)]}" if s else "0") for s, label in asked], "step int, cluster string, structure_id int, key string, window string")
    placed = cells.select("cell_id", "x", "y", "cluster").withColumns({"ix": x.clipped("x"), "iy": y.clipped("y")}).join(F.broadcast(table), "cluster")
    inside = placed.join(bins, ["step", "ix", "iy", "structure_id"], "left_semi")
    points = placed.where("step = 0").select("key", F.col("cell_id").alias("id"), "x", "y").unionByName(inside.where("step > 0").select("key", F.col("cell_id").alias("id"), "x", "y"))
    windows = bins.select(F.when(F.col("step") == 0, "0").otherwise(F.concat_ws("|", "step", "structure_id")).alias("window"), "ix", "iy")
    tests = table.select("key", "window", F.lit(None).cast("string").alias("pool"))
    found = {r.key: (r.di, r.p_clustered, r.n_cells) for r in pattern_tests(points, tests, windows, x, y, radii, **options).select("key", "di", "p_clustered", "n_cells").collect()}
    return {(s, label): found.get(f"{s}|{label}", (float("nan"), float("nan"), 0)) for s, label in asked}


def explore(cells: DataFrame, root: Branch, partition: Partition, x: Axis, y: Axis, radii: list[float], **options) -> Exploration:
    """Every branch point from the top down: the dispersion of its labels just before and just after it is taken.

    Partitions compete for bins, so "before" is measured in the partition that the step before left.
    """
    steps = steps_of(root)
    groupings = {0: [root.leaves], **{k: [p.leaves for p in parts] for k, (_, parts) in enumerate(steps, 1)}}
    after = [(k, label) for k, (b, _) in enumerate(steps, 1) for label in b.leaves]
    before = [(k - 1, label) for k, (b, _) in enumerate(steps, 1) if k > 1 for label in b.leaves]
    found = _tested(cells, groupings, sorted({*[(0, label) for label in root.leaves], *after, *before}), partition, x, y, radii, **options)
    sizes = {r.cluster: r["count"] for r in cells.where(F.col("cluster").isin(root.leaves)).groupBy("cluster").count().collect()}
    rows = []
    for k, (b, _) in enumerate(steps, 1):
        child = {label: c.name for c in b.children for label in c.leaves}
        for label in b.leaves:
            now = found[(k, label)]
            rows.append((b.name, label, child[label], float(found[(k - 1, label)][0]), float(now[0]), float(now[1]), sizes.get(label, 0), int(now[2])))
    return Exploration(root, {label: found[(0, label)][:2] for label in root.leaves}, rows)


@dataclass
class Group:
    source: str
    labels: list[str]
    kind: str


def by_threshold(found: Exploration, least: float, rule: str = "extract_top_branch") -> tuple[list[Group], dict[str, str]]:
    """Groups where branch points that gain ``least`` are split, and what was done at each branch point reached.

    A branch point under the threshold with stronger ones below it is split too (``split_parent``), kept (``stop``), or kept
    without the better half of each stronger one (``extract_top_branch``), from the highest down, while some of it is left.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    gain, gains = found.gain(), found.gains()
    groups: list[Group] = []
    done: dict[str, str] = {}
    todo = [found.root]
    while todo:
        b = todo.pop(0)
        if not b.children:
            groups.append(Group(b.name, b.leaves, "single"))
            continue
        strong = [q for q in b.inner() if q is not b and gain[q.name] >= least]
        if gain[b.name] >= least or (rule == "split_parent" and strong):
            done[b.name] = "split"
            todo += b.children
            continue
        done[b.name] = "keep"
        left, taken = list(b.leaves), []
        if rule == "extract_top_branch":
            for q in sorted(strong, key=lambda q: -q.height):
                halves = [c for c in q.children if set(c.leaves) <= set(left) and len(c.leaves) < len(left)]
                whole = [c for c in q.children if set(c.leaves) <= set(left)]
                best = max(whole, key=lambda c: sum(gains[q.name][x] for x in c.leaves), default=None)
                if best is not None and best in halves:
                    left = [x for x in left if x not in set(best.leaves)]
                    taken.append(best.name)
                    groups.append(Group(best.name, best.leaves, "extracted"))
        groups.append(Group("-".join([b.name, *taken]), left, "rest" if taken else "kept"))
    return sorted(groups, key=lambda g: (-len(g.labels), g.source)), done


def by_count(found: Exploration, n: int) -> tuple[list[Group], dict[str, str]]:
    """``n`` groups, as many as there are labels at most: branch points are chosen by falling gain, each with all above it, while the count allows."""
    gain = found.gain()
    above: dict[str, list[str]] = {}

    def note(b: Branch, path: list[str]) -> None:
        above[b.name] = path
        for c in b.children:
            if c.children:
                note(c, [*path, b.name])

    note(found.root, [])
    room = min(max(1, n), len(found.root.leaves)) - 1
    chosen: set[str] = set()
    for b in sorted(found.root.inner(), key=lambda b: (-gain[b.name], -b.height)):
        need = {b.name, *above[b.name]} - chosen
        if b.name not in chosen and len(chosen) + len(need) <= room:
            chosen |= need
    groups: list[Group] = []
    done: dict[str, str] = {}
    todo = [found.root]
    while todo:
        b = todo.pop(0)
        if b.children:
            done[b.name] = "split" if b.name in chosen else "keep"
        if b.name in chosen:
            todo += b.children
        else:
            groups.append(Group(b.name, b.leaves, "kept" if b.children else "single"))
    return sorted(groups, key=lambda g: (-len(g.labels), g.source)), done


def cut_tree(cells: DataFrame, found: Exploration, groups: list[Group], partition: Partition, x: Axis, y: Axis, radii: list[float], **options) -> DataFrame:
    """(structure, source, kind, label, before, after, p_after, gain, share_inside) of each label after the cut, tested anew in the final partition."""
    spark = cells.sparkSession
    labels = [g.labels for g in groups]
    tested = _tested(cells, {1: labels}, [(1, label) for g in labels for label in g], partition, x, y, radii, **options)
    sizes = {r.cluster: r["count"] for r in cells.where(F.col("cluster").isin(found.root.leaves)).groupBy("cluster").count().collect()}
    rows = []
    for i, g in enumerate(groups, 1):
        for label in g.labels:
            di, p, n = tested[(1, label)]
            first = found.baseline[label][0]
            rows.append((f"Structure {i}", g.source, g.kind, label, float(first), float(di), float(p), float(first - di), n / max(sizes.get(label, 0), 1)))
    return spark.createDataFrame(rows, "structure string, source string, kind string, label string, before double, after double, p_after double, gain double, share_inside double")
