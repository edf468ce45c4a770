"""SimHash near-dedup with pivot distance tables.

Fingerprints of 3-word shingles link at a Hamming distance of 3 or less. Null and empty texts have fingerprint zero
and link like any other. Repeated rows and ids each give a row; a null id gives a row whose component is the smallest
non-null id of its group, if any. An empty table gives an empty result; other columns are ignored.

Candidates share bits: a fingerprint is cut into six blocks, and two fingerprints that differ in three bits at most have
at least three blocks alike, so pairs are looked for among fingerprints that agree on three of the blocks (20 choices).
A crowded choice is divided by a quarter of its other bits, of which three differing bits leave one as it is. Pairs are
then discarded by a pivot table: for any pivot p, |d(x, p) - d(y, p)| <= d(x, y), so a pair whose distances to one of
the reference fingerprints differ by more than three is no link. Survivors are verified bit by bit. Pivot distances
alone make no candidates: to one pivot most of all fingerprints are 24 to 40 bits away, so they tell too few apart.
Equal fingerprints are one node throughout, so a group of copies costs one row however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, hot_lookup, materialize, read_table, row_hash, texts_of, unused
from .components import connected, forest

SHINGLE, SEED, RADIUS, BITS = 3, 42, 3, 64
#: Widths of the six blocks.
WIDTHS = (11, 11, 11, 11, 10, 10)
PIVOTS = 16
#: Candidates of one bucket compared pair by pair; a larger bucket is divided, and its parts are dealt anew.
DIVIDE = 512


def fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: 1 - SHINGLE].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero for none."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row, fp) of every row; fp holds the 64 bits as a signed long, ``row`` is a hash of all columns."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in texts_of(b.column("text"))], dtype=np.uint64)
            yield batch_of(pa.schema([("doc_id", b.schema.field("doc_id").type), ("row", pa.int64()), ("fp", pa.int64())]), doc_id=b.column("doc_id"), row=b.column("row"), fp=fp.view(np.int64))

    return docs.select("doc_id", row_hash(docs).alias("row"), "text").mapInArrow(run, f"doc_id {id_type}, row bigint, fp bigint")


CHOICES = list(combinations(range(len(WIDTHS)), len(WIDTHS) - RADIUS))


def _bits_of(block: int) -> np.ndarray:
    start = sum(WIDTHS[:block])
    return np.arange(start, start + WIDTHS[block])


def _mask(bits) -> np.uint64:
    return np.uint64(sum(1 << int(x) for x in bits))


#: Bits of the three blocks of each choice; and of each quarter of its other bits.
CHOSEN = [_mask(np.concatenate([_bits_of(b) for b in chosen])) for chosen in CHOICES]
QUARTERS = [[_mask(q) for q in np.array_split(np.concatenate([_bits_of(b) for b in range(len(WIDTHS)) if b not in chosen]), RADIUS + 1)] for chosen in CHOICES]


def _keyed(bits: np.ndarray, salt: int, low: int) -> np.ndarray:
    """Mixed bits with the number of the choice in the low five bits of the key."""
    h = (bits ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) & ~np.uint64(31)) | np.uint64(low)


def bucket_keys(fp: np.ndarray) -> np.ndarray:
    """Keys (choices x fingerprints) of the blocks chosen."""
    return np.stack([_keyed(fp & m, i + 1, i) for i, m in enumerate(CHOSEN)])


def divided(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) rows of crowded buckets, each under four new keys: its bucket and one quarter of the bits that the bucket leaves free."""
    choice = (key & np.uint64(31)).astype(np.int64)
    keys = []
    for q in range(RADIUS + 1):
        masks = np.array([QUARTERS[c][q] for c in range(len(CHOICES))], dtype=np.uint64)[choice]
        keys.append(_keyed((fp & masks) ^ (key >> np.uint64(5)), 101 + q, q))
    return np.concatenate(keys), np.tile(fp, RADIUS + 1)


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.arange(n, dtype=np.uint64) % np.uint64(2)


def _runs(key: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.empty(0, int)
    return zip(edges[:-1], edges[1:], strict=True)


def pairs_within(key: np.ndarray, fp: np.ndarray, coords: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of equal ``key`` (sorted) within RADIUS, by the maximum coordinate difference and then by the bits."""
    i = np.arange(len(key))
    for shift in range(1, len(key)):
        i = i[i + shift < len(key)]
        i = i[key[i] == key[i + shift]]
        if not len(i):
            return
        near = i
        for c in range(coords.shape[1]):
            near = near[np.abs(coords[near, c] - coords[near + shift, c]) <= RADIUS]
        near = near[np.bitwise_count(fp[near] ^ fp[near + shift]) <= RADIUS]
        if len(near):
            yield near, near + shift


def link(key: np.ndarray, fp: np.ndarray, divide: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links found among rows of (bucket key, fingerprint), each linked fingerprint with the smallest it reaches here; and, with ``divide``, the rows of larger buckets under new keys."""
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)
    sizes = np.diff(edges)
    crowded = np.repeat(sizes > DIVIDE, sizes) if divide else np.zeros(len(key), dtype=bool)
    later = divided(key[crowded], fp[crowded])
    key, fp = key[~crowded], fp[~crowded]
    nodes, of = np.unique(fp, return_inverse=True)
    coords = np.bitwise_count(fp[:, None] ^ pivots()[None, :]).astype(np.int8)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def settle() -> None:
        nonlocal held, size
        u, v = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.empty(0, int),) * 2
        root = forest(len(nodes), u, v)
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        held, size = [(moved, root[moved])], len(moved)

    for a, b in pairs_within(key, fp, coords):
        held.append((of[a], of[b]))
        size += len(a)
        if size > 2_000_000 + 2 * len(nodes):
            settle()
    settle()
    u, v = held[0]
    return nodes[u], nodes[v], *later


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("again", pa.bool_())])


def _compared(rows: DataFrame, divide: bool) -> DataFrame:
    """(a, b, again): links (a, b), and where ``again`` is set the key and fingerprint of a row that is to be compared anew."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        if parts:
            key, fp = (np.concatenate(x).view(np.uint64) for x in zip(*parts, strict=True))
            u, v, key, fp = link(key, fp, divide)
            for a, b, again in ((u, v, False), (key, fp, True)):
                for at in range(0, len(a), 1 << 20):
                    some = slice(at, at + (1 << 20))
                    yield batch_of(_FOUND, a=a[some].view(np.int64), b=b[some].view(np.int64), again=np.full(len(a[some]), again))

    return rows.repartition("key").mapInArrow(find, "a bigint, b bigint, again boolean")


def links(fps: DataFrame) -> DataFrame:
    """(a, b) links that connect the distinct fingerprints of column ``fp`` as all links within RADIUS do."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch_of(pa.schema([("key", pa.int64()), ("fp", pa.int64())]), key=bucket_keys(fp).ravel().view(np.int64), fp=np.tile(fp.view(np.int64), len(CHOICES)))

    found = materialize(_compared(fps.select("fp").mapInArrow(spread, "key bigint, fp bigint"), True))
    rest = _compared(found.where("again").select(F.col("a").alias("key"), F.col("b").alias("fp")), False)
    return found.where("not again").select("a", "b").union(rest.select("a", "b"))


def _grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, row, fp, root, component_id) of every row; rows of one root are one group."""
    marked = materialize(fingerprints(docs))
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    roots = connected(links(nodes)).withColumnRenamed("node", "fp")
    rooted = materialize(nodes.join(roots, "fp", "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return hot_lookup(marked, rooted.join(least, "root").select("fp", "root", "component_id", "n"), "fp", "n")


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    return _grouped(docs).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id, then of the smallest hash of its columns. Rows without an id stay."""
    first = _grouped(docs).where("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("m"))
    row = unused("_row", docs)
    kept = materialize(first.select(F.col("m.doc_id").alias("doc_id"), F.col("m.row").alias(row)))
    once = docs.withColumn(row, row_hash(docs)).join(kept, ["doc_id", row], "left_semi").dropDuplicates(["doc_id", row])
    return once.drop(row).union(docs.where("doc_id is null"))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    groups = near_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}
ORACLE_SQL: dict[str, str] = {}
