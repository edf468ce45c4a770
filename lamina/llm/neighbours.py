"""Embedding near-dedup: p-stable Euclidean hashing of unit vectors in several tables, then exact cosines.

Vectors that are null, zero or hold a null or non-finite component link with nothing, nor do vectors of different
lengths link. Equal vectors are one node with a count, so a group of copies costs one row. Every input row gives one
row; a null id counts as a link partner but is never a component's id while there is another. An empty table gives an
empty result; other columns (labels too) are ignored.

Two unit vectors of cosine 0.9 are 0.447 apart. One projection in steps of ``WIDTH`` keeps them together with
probability 0.84, all ``HASHES`` of a table with 0.12, one of ``TABLES`` tables with 0.98; closer pairs are missed far
less (1 in 10**7 at 0.98). Buckets over ``TILE`` are cut into blocks, and every pair of blocks is a task's row group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, hot_lookup, materialize, read_table
from .components import connected, forest

COSINE, TABLES, HASHES, WIDTH = 0.9, 32, 12, 2.2
TILE = 2048
#: So many oversized buckets are told to all tasks at most; more are joined.
HOT_BUCKETS = 100_000
_SMALL = 48


def projections(dim: int, tables: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(dim)
    return rng.standard_normal((dim, tables * hashes)), rng.random(tables * hashes)


def table_keys(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH) -> np.ndarray:
    """Bucket keys (rows x tables) of vectors of one length."""
    a, b = projections(x.shape[1], tables, hashes)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    steps = np.floor(unit @ a / width + b).astype(np.int64).astype(np.uint64).reshape(len(x), tables, hashes)
    h = np.full((len(x), tables), x.shape[1], dtype=np.uint64) + np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(hashes):
        h = (h ^ steps[:, :, i]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(30)
    return h.view(np.int64)


def _packed(vectors: DataFrame) -> tuple[DataFrame, str]:
    """(vec_id, uid, raw): the components as little-endian floats of the column's own width, null where a vector can't link."""
    kind = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def pack(v) -> bytes | None:
        if not v or None in v:
            return None
        x = np.asarray(v, dtype=kind) + np.array(0, dtype=kind)  # -0 becomes 0
        return x.tobytes() if np.isfinite(x).all() and x.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch_of(pa.schema([("vec_id", b.schema.field("vec_id").type), ("raw", pa.binary())]), vec_id=b.column("vec_id"), raw=[pack(v) for v in b.column("embedding").to_pylist()])

    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {id_type}, raw binary").withColumn("uid", F.monotonically_increasing_id()), kind


def _matrix(raw: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)


def _by_length(raw: list[bytes]) -> Iterator[np.ndarray]:
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    for n in np.unique(sizes):
        yield np.flatnonzero(sizes == n)


def _spread(nodes: DataFrame, kind: str, tables: int, hashes: int, width: float, with_vectors: bool) -> DataFrame:
    """A row for each node and table: tab, key[, rep, n, raw]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            for rows in _by_length(raw):
                for at in range(0, len(rows), 512):
                    some = rows[at : at + 512]
                    keys = table_keys(_matrix([raw[i] for i in some], kind), tables, hashes, width)
                    columns = {"tab": np.repeat(np.arange(tables, dtype=np.int32), len(some)), "key": keys.T.ravel()}
                    schema = [("tab", pa.int32()), ("key", pa.int64())]
                    if with_vectors:
                        part = batch.take(pa.array(np.tile(some, tables)))
                        columns |= {"rep": part.column("rep"), "n": part.column("n"), "raw": part.column("raw")}
                        schema += [("rep", pa.int64()), ("n", pa.int64()), ("raw", pa.binary())]
                    yield batch_of(pa.schema(schema), **columns)

    return nodes.select("rep", "n", "raw").mapInArrow(run, "tab int, key bigint" + ", rep bigint, n bigint, raw binary" * with_vectors)


def _pairs(group: np.ndarray, block: np.ndarray, crossed: np.ndarray, x: np.ndarray, norm: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of equal ``group`` (sorted) with at least ``cosine``; where ``crossed``, only those of different blocks."""
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    sizes = np.diff(edges)
    big = np.repeat(sizes > _SMALL, sizes)
    i = np.flatnonzero(~big)
    for shift in range(1, _SMALL):  # all small groups side by side
        i = i[i + shift < len(group)]
        i = i[group[i] == group[i + shift]]
        if not len(i):
            break
        for at in range(0, len(i), 1 << 16):
            u = i[at : at + (1 << 16)]
            v = u + shift
            near = (np.einsum("ij,ij->i", x[u], x[v]) / (norm[u] * norm[v]) >= cosine) & ~(crossed[u] & (block[u] == block[v]))
            if near.any():
                yield u[near], v[near]
    for s, e in zip(edges[:-1][sizes > _SMALL], edges[1:][sizes > _SMALL], strict=True):
        for at in range(s, e, 1024):
            to = min(at + 1024, e)
            near = (x[at:to] @ x[at:e].T) / (norm[at:to, None] * norm[None, at:e]) >= cosine
            u, v = np.nonzero(np.triu(near, 1))
            u, v = u + at, v + at
            if crossed[s]:
                keep = block[u] != block[v]
                u, v = u[keep], v[keep]
            if len(u):
                yield u, v


def _links(buckets: DataFrame, kind: str, tables: int, hashes: int, width: float, cosine: float) -> DataFrame:
    """(rep, links, root) by task: links found there and the smallest node reached. A pair counts in the first table that brings it together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        tab, key, rep, n, lo, hi, block = (table.column(c).to_numpy() for c in ("tab", "key", "rep", "n", "lo", "hi", "block"))
        raw = table.column("raw").to_pylist()
        nodes, of = np.unique(rep, return_inverse=True)
        links = np.zeros(len(nodes), dtype=np.int64)
        root = np.arange(len(nodes))
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def settle() -> None:
            nonlocal held, root
            if held:
                u, v = (np.concatenate(c) for c in zip(*held, strict=True))
                root = forest(len(nodes), np.concatenate([u, np.arange(len(nodes))]), np.concatenate([v, root]))
                held = []

        for rows in _by_length(raw):
            rows = rows[np.lexsort((hi[rows], lo[rows], key[rows], tab[rows]))]
            x = _matrix([raw[i] for i in rows], kind)
            norm = np.linalg.norm(x, axis=1)
            change = np.zeros(len(rows), dtype=np.int64)
            for c in (tab, key, lo, hi):
                change[1:] |= c[rows][1:] != c[rows][:-1]
            for u, v in _pairs(np.cumsum(change), block[rows], (lo != hi)[rows], x, norm, cosine):
                for at in range(0, len(u), 1 << 15):
                    a, b = u[at : at + (1 << 15)], v[at : at + (1 << 15)]
                    some, place = np.unique(np.concatenate([a, b]), return_inverse=True)
                    keys = table_keys(x[some], tables, hashes, width)
                    ka, kb = keys[place[: len(a)]], keys[place[len(a) :]]
                    first = (ka == kb).argmax(axis=1) == tab[rows[a]]
                    a, b = rows[a[first]], rows[b[first]]
                    np.add.at(links, of[a], n[b])
                    np.add.at(links, of[b], n[a])
                    held.append((of[a], of[b]))
                    if sum(len(h) for h, _ in held) > 1_000_000:
                        settle()
        settle()
        some = np.flatnonzero(links)
        yield batch_of(pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]), rep=nodes[some], links=links[some], root=nodes[root[some]])

    return buckets.repartition("tab", "key", "lo", "hi").mapInArrow(run, "rep bigint, links bigint, root bigint")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    packed, kind = _packed(vectors)
    marked = materialize(packed)
    nodes = materialize(marked.where("raw is not null").groupBy("raw").agg(F.min("uid").alias("rep"), F.count("*").alias("n"), F.min("vec_id").alias("first_id")))
    hot = materialize(_spread(nodes, kind, tables, hashes, width, False).groupBy("tab", "key").count().where(F.col("count") > tile))
    if hot.count() <= HOT_BUCKETS:
        hot = F.broadcast(hot)
    blocks = F.coalesce(F.ceil(F.col("count") / tile), F.lit(1)).cast("int")
    rows = _spread(nodes, kind, tables, hashes, width, True).join(hot, ["tab", "key"], "left").withColumn("_blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.select("tab", "key", "rep", "n", "raw", "block", F.least("block", "_other").alias("lo"), F.greatest("block", "_other").alias("hi"))
    found = materialize(_links(rows, kind, tables, hashes, width, cosine))
    roots = connected(found.select("rep", "root")).select(F.col("node").alias("rep"), "root")
    known = nodes.join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = known.groupBy("root").agg(F.min("first_id").alias("component"))
    table = materialize(known.join(least, "root").select("raw", "n", "links", "component", F.col("n").alias("rows")))
    return hot_lookup(marked, table, "raw", "rows").select(
        "vec_id",
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("raw").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_embedding_neighbours(spark, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


QUERIES = {"op6_embedding_neighbours": op6_embedding_neighbours}
ORACLE_SQL: dict[str, str] = {}
