"""Quality rules: document statistics judged by boosted trees held as flat numpy node arrays.

Words are runs of bytes other than space and 0x09-0x0D. Null texts count as empty (no words, so the base rule
fails them). Repeated rows are judged one by one; ties in the training order are broken by id; extra columns are
carried by :func:`keep_good` and ignored by :func:`judge`; an empty label table gives no model and the base rule decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, batch_of, read_table, texts_of

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "line_rate")
#: +1: the score may only rise with the feature, -1: only fall, 0: free.
MONOTONE = (0, 0, -1, -1, -1, 0, 0)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Labelled rows fitted on at most (those of the smallest id hashes).
MAX_LABELS = 20_000


def text_stats(text: str) -> tuple[int, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct_words, n_lines) of a whole text."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            seen, twice = set(), set()
            for w in windows:
                (twice if w in seen else seen).add(w)
            end = 0
            for i, w in enumerate(windows):
                if w in twice:
                    repeated += i + 3 - max(end, i)
                    end = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(set(words)), len(lines)


def features(stats: np.ndarray) -> np.ndarray:
    """Feature matrix of rows of :func:`text_stats`."""
    s = np.asarray(stats, dtype=np.float64).reshape(-1, 7)
    n, lines = np.maximum(s[:, 0], 1), np.maximum(s[:, 6], 1)
    return np.column_stack([np.log1p(s[:, 0]), s[:, 1] / n, s[:, 2] / n, s[:, 3] / lines, s[:, 4] / n, s[:, 5] / n, s[:, 6] / n])


@dataclass
class Trees:
    """A forest as node arrays: at node i go to left[i] if x[feature[i]] <= threshold[i], else right[i]; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while (inner := self.feature[node] >= 0).any():
                f = np.maximum(self.feature[node], 0)
                down = np.where(x[rows, f] <= self.threshold[node], self.left[node], self.right[node])
                node = np.where(inner, down, node)
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, monotone=MONOTONE, n_trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, min_rows: int = 5
) -> Trees:
    """Newton boosting of the logistic loss over quantile bins.

    Monotonic constraints: a split on a constrained feature is taken only if its leaf values are in order, and each
    side's subtree is then held on its side of their midpoint, so that deeper splits can't break the order.
    """
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)])
    nodes: list[list] = []
    roots = []
    score = np.full(len(y), base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, rate * float(np.clip(-gs / (hs + l2), low, high))])
        if level == depth or len(rows) < 2 * min_rows:
            return at
        best = (1e-6, -1, 0, 0.0, 0.0)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, f]
            gl, hl, nl = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
            vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-(gs - gl) / (hs - hl + l2), low, high)
            gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
            gain[(nl < min_rows) | (len(rows) - nl < min_rows) | (monotone[f] * (vr - vl) < 0)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
        _, f, k, vl, vr = best
        if f < 0:
            return at
        go = binned[rows, f] <= k
        mid = (vl + vr) / 2
        l_low, l_high, r_low, r_high = low, high, low, high
        if monotone[f] > 0:
            l_high, r_low = mid, mid
        elif monotone[f] < 0:
            l_low, r_high = mid, mid
        left = grow(rows[go], g, h, level + 1, l_low, l_high)
        right = grow(rows[~go], g, h, level + 1, r_low, r_high)
        nodes[at][:4] = [f, float(cuts[f][k]), left, right]
        return at

    def trees(which: list[int]) -> Trees:
        f, t, lo, hi, v = zip(*nodes, strict=True) if nodes else ((),) * 5
        return Trees(np.array(f, dtype=int), np.array(t, dtype=float), np.array(lo, dtype=int), np.array(hi, dtype=int), np.array(v, dtype=float), np.array(which, dtype=int), base)

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -4.0, 4.0))
        score += trees(roots[-1:]).raw(x) - base
    return trees(roots)


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > MAX_REPEAT_PERCENT * stats[:, 0])


def _stats_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([text_stats(t) for t in texts_of(batch.column("text"))], dtype=np.int64).reshape(-1, 7)


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, threshold: float = 0.5) -> tuple[Trees | None, float]:
    """Trees fitted to ``labels.quality`` (1 good) of at most ``max_labels`` documents, with the threshold to keep at.

    The sample is bounded, so its ids may be broadcast and its statistics (not its texts) come to the driver.
    """
    pick = (
        labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    )
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([("doc_id", b.schema.field("doc_id").type), ("s", pa.list_(pa.int64())), ("y", pa.int32())])
            yield batch_of(schema, doc_id=b.column("doc_id"), s=_stats_of(b).tolist(), y=b.column("_y"))

    picked = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id").select("doc_id", "text", F.col("_y").cast("int").alias("_y"))
    # An id that many rows repeat counts once, by its smallest statistics, so no more than max_labels rows come to the driver.
    rows = picked.mapInArrow(measure, f"doc_id {id_type}, s array<bigint>, y int").groupBy("doc_id").agg(F.min("s").alias("s"), F.min("y").alias("y")).collect()
    if not rows or len({r.y for r in rows}) < 2:
        return None, threshold
    rows.sort(key=lambda r: (r.s, r.y))
    return fit_trees(features(np.array([r.s for r in rows])), np.array([r.y > 0 for r in rows])), threshold


def _verdict(stats: np.ndarray, trees: Trees | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    failed = base_failed(stats)
    p = trees.probability(features(stats)) if trees is not None and len(stats) else np.full(len(stats), 1.0)
    return failed, p, ~failed & (p >= threshold)


def judge(docs: DataFrame, model: tuple[Trees | None, float]) -> DataFrame:
    """One row per document: doc_id, the five counts, base_failed, kept and the model's probability."""
    trees, threshold = model
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fields = [(c, pa.int64()) for c in COUNTS] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("quality_score", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _stats_of(b)
            failed, p, kept = _verdict(s, trees, threshold)
            ids = b.column("doc_id")
            columns = {c: s[:, i] for i, c in enumerate(COUNTS)} | {"base_failed": failed, "kept": kept, "quality_score": p}
            yield batch_of(pa.schema([("doc_id", ids.type), *fields]), doc_id=ids, **columns)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, kept boolean, quality_score double")


def keep_good(docs: DataFrame, model: tuple[Trees | None, float]) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`judge` keeps."""
    trees, threshold = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_verdict(_stats_of(b), trees, threshold)[2]))

    return docs.mapInArrow(run, docs.schema)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, read_table(spark, sf_dir, "labels")))


QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLE_SQL: dict[str, str] = {}
