"""Groups of documents whose sets of word shingles have a Jaccard similarity of LEAST or more.

Candidates come from SimHash fingerprints of the sets: those that ``simhash.links`` finds within its radius, by blocks of
bits and pivot distance tables, are held against one another. That radius can't hold the similarity, as most pairs that
are just alike differ in more bits. For these, candidates also share a band of minima of random hashes: at a similarity
of exactly LEAST, a pair shares one of BANDS bands of ROWS minima with probability 0.9996. Each candidate pair of either
kind is then held against its exact shingle sets. Texts of the same words are one node, so a group of copies costs one
row however large it is. Null and empty texts are alike.

Every node of a bucket is first compared with one hub there, drawn anew for each fourth of the bands, so a crowd of near
copies makes a few pairs a node. Where nodes of a bucket are then still in different groups, they are held against a few
pivots, members of its largest groups, and parted among them: sets alike are near the same pivots, as the number of
shingles in which sets differ is a metric. Parts of one group are done, so copies lacking the same piece of a text are
no pairs with those that lack another. What is still mixed is parted again, and then each node is known by its edits of
its pivot: the shingles that it lacks and those that it adds. Two nodes that are alike, though not both alike the pivot,
must share an added shingle that few have, or have so few and so equal edits that their numbers allow it; only such pairs
are compared. So the groups are those of all candidate pairs, while the pairs grow with a crowd, not with its square,
unless its members lie within half of their shingles of one another and are yet in different groups.

Null and empty texts are one node. An empty table has no groups. Only doc_id and text are read, other columns are kept
as they are, whatever their types and names. A text is held whole, with eight bytes for each of its shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, hot_lookup, materialize, row_hash, slices, texts_of, unused
from .components import connected
from .simhash import links, majority

SHINGLE, SEED, BANDS, ROWS = 5, 42, 20, 5
#: Hubs of a crowd whose members share all bands; a shingle added by so many members of a crowd at most is rare.
HUBS, RARE = 4, 32
#: Crowds in which groups are left are parted by so many members of different groups, and what is still mixed again, so many times in all.
PIVOTS, SPLITS = 8, 1
#: Parts where no more nodes than this look for others are not parted again.
FEW = 32
#: The least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
_RNG = np.random.default_rng(SEED)
FLIPS = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
FACTORS = _RNG.integers(0, 1 << 62, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SLICE_BYTES = 16 << 20
#: Shingles of the sets that a task keeps, as the nodes of a crowd come back in many pairs.
HELD = 4_000_000


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def node_of(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words), SEED)


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct hashes of the shingles, sorted; a text of fewer words is one shingle, an empty one has none."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - SHINGLE].tolist()
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)], dtype=np.uint64))


def bands(h: np.ndarray) -> list[int]:
    """Keys of the bands, each with the number of its band mixed in."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), 1024):
        least = np.minimum(least, ((h[None, at : at + 1024] ^ FLIPS) * FACTORS).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(rows[i].tobytes(), i) for i in range(BANDS)]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two sorted sets is LEAST or more."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    if LEAST[1] * min(len(a), len(b)) < LEAST[0] * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, row, node, fp, bands) of every row; ``row`` hashes all of its columns, ``fp`` is the SimHash of the set."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, SLICE_BYTES):
                words = [words_of(t) for t in texts_of(b.column("text"))]
                marks = [(majority(h), bands(h)) for h in map(shingles, words)]
                fp = np.array([f for f, _ in marks], dtype=np.uint64).view(np.int64)
                keys = np.array([k for _, k in marks], dtype=np.uint64).view(np.int64)
                schema = pa.schema([b.schema.field("doc_id"), ("row", pa.int64()), ("node", pa.binary()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])
                yield batch_of(schema, doc_id=b.column("doc_id"), row=b.column("row"), node=[node_of(w) for w in words], fp=fp, bands=list(keys))

    return docs.select("doc_id", row_hash(docs).alias("row"), "text").mapInArrow(run, f"doc_id {id_type}, row bigint, node binary, fp bigint, bands array<bigint>")


def _texts(docs: DataFrame) -> DataFrame:
    """(node, text) with one text of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch_of(pa.schema([("node", pa.binary()), ("text", b.schema.field("text").type)]), node=[node_of(words_of(t)) for t in texts_of(b.column("text"))], text=b.column("text"))

    return docs.select("text").mapInArrow(run, "node binary, text string")


def _both_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, text_a, text_b) of (a, b); ``a`` may be in many pairs."""
    other = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    hubs = texts.join(pairs.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n")), "node").select(F.col("node").alias("a"), F.col("text").alias("text_a"), "n")
    return hot_lookup(other, hubs, "a", "n").select("a", "b", "text_a", "text_b")


class _Sets:
    """Shingle sets of nodes, of which a task keeps some, as the nodes of a crowd come back in many pairs."""

    def __init__(self):
        self.held: dict[bytes, np.ndarray] = {}
        self.size = 0

    def of(self, node: bytes, text: str | None) -> np.ndarray:
        if (h := self.held.get(node)) is None:
            h = shingles(words_of(text or ""))
            if self.size > HELD:
                self.held, self.size = {}, 0
            self.held[node] = h
            self.size += len(h) + 16
        return h


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that are alike by their exact shingle sets; ``a`` may be in many pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets()
        for batch in batches:
            a, b, ta, tb = (batch.column(c) for c in ("a", "b", "text_a", "text_b"))
            keep = np.array([alike(sets.of(a[i].as_py(), ta[i].as_py()), sets.of(b[i].as_py(), tb[i].as_py())) for i in range(batch.num_rows)], dtype=bool)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return _both_texts(pairs, texts).mapInArrow(run, "a binary, b binary")


def _edits(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(hub, node, alike, size, lacking, added) of (a, b) as hub and node: how many of the hub's shingles a node lacks, and the ones it adds."""
    schema = pa.schema([("hub", pa.binary()), ("node", pa.binary()), ("alike", pa.bool_()), ("size", pa.int32()), ("lacking", pa.int32()), ("added", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets()
        for batch in batches:
            rows = []
            for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                hub, own = sets.of(a, ta), sets.of(b, tb)
                added = np.setdiff1d(own, hub, assume_unique=True)
                rows.append((a, b, alike(hub, own), len(own), len(hub) - (len(own) - len(added)), added.view(np.int64)))
            if rows:
                yield batch_of(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    return _both_texts(pairs, texts).mapInArrow(run, "hub binary, node binary, alike boolean, size int, lacking int, added array<bigint>")


def _profiles(texts: DataFrame) -> DataFrame:
    """(node, size, own): distinct shingles of each text, and those that no other text of the table has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, SLICE_BYTES):
                sets = [shingles(words_of(t)) for t in texts_of(b.column("text"))]
                for node, h in zip(b.column("node").to_pylist(), sets, strict=True):
                    yield batch_of(pa.schema([("node", pa.binary()), ("h", pa.int64())]), node=[node] * len(h), h=h.view(np.int64))

    grams = texts.select("node", "text").mapInArrow(run, "node binary, h bigint")
    # One row for each shingle: how many have it and, where that is one, who.
    by_gram = materialize(grams.groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count("*").alias("own")))
    sizes = grams.groupBy("node").agg(F.count("*").alias("size"))
    return sizes.join(by_gram, "node", "left").select("node", "size", F.coalesce("own", F.lit(0)).alias("own"))


def _pivots(members: DataFrame, own: DataFrame) -> DataFrame:
    """(key, place, a, size): a member of each of the PIVOTS largest groups of each crowd (key, node, root), and its shingles.

    A group has one such member, that with the fewest shingles of its own, in all crowds that it is in, as the buckets
    of several bands hold much the same nodes.
    """
    groups = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), F.xxhash64("root"), "root"))
    largest = groups.withColumn("place", place).where(F.col("place") <= PIVOTS)
    one = members.select("root", "node").distinct().join(own, "node").groupBy("root").agg(F.min(F.struct("own", F.xxhash64("node").alias("o"), "node", "size")).alias("m"))
    return materialize(largest.join(one, "root").select("key", "place", F.col("m.node").alias("a"), F.col("m.size").alias("size")))


def _parting(pivots: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, a) of the pivots (key, place, a, size) that part their crowd: those farther than half of their shingles from all kept before them.

    A member whose nearest pivot is a is farther from b by no more than b is from a. If that is half of its shingles it
    goes to both (see _regions), so b would make a row of each such member and part none of them.
    """
    p, q = LEAST
    one, two = (pivots.select("key", *[F.col(c).alias(f"{c}_{n}") for c in ("place", "a")]) for n in "xy")
    pairs = materialize(one.join(two, "key").where("place_x < place_y").select("key", "a_x", "a_y"))
    edits = _edits(materialize(pairs.select(F.col("a_x").alias("a"), F.col("a_y").alias("b")).distinct()), texts)
    apart = edits.select(F.col("hub").alias("a_x"), F.col("node").alias("a_y"), (F.col("lacking") + F.size("added")).alias("d"))
    before = pairs.join(apart, ["a_x", "a_y"]).groupBy("key", F.col("a_y").alias("a")).agg(F.map_from_entries(F.collect_list(F.struct("a_x", "d"))).alias("far"))
    # A crowd's pivots are one row of PIVOTS at most, in the order of their groups.
    rows = pivots.join(before, ["key", "a"], "left").groupBy("key").agg(F.collect_list(F.struct("place", "a", "size", "far")).alias("all"))
    near = lambda x, a: p * F.element_at(x["far"], a) <= 2 * (q - p) * x["size"]
    keep = lambda kept, x: F.when(F.exists(kept, lambda a: near(x, a)), kept).otherwise(F.concat(kept, F.array(x["a"])))
    placed = F.array_sort("all", lambda x, y: x["place"] - y["place"])
    return materialize(rows.select("key", F.explode(F.aggregate(placed, F.array().cast("array<binary>"), keep)).alias("a")))


def _regions(members: DataFrame, pivots: DataFrame, edits: DataFrame) -> DataFrame:
    """(hub, node, own): the pivots at which each member (key, node, own) of a crowd may meet the ones alike it.

    The number of shingles in which two sets differ is a metric, and members alike x differ from it in a quarter of its
    shingles at most. One whose nearest pivot is b is thus no nearer to x than half of what x is farther from b than from
    its own nearest, so x goes to its nearest pivot and to those farther by no more than half of its shingles. Members
    alike thus meet at the nearest pivot of either, and only pairs with one that is there for its ``own`` sake are asked.
    """
    p, q = LEAST
    # A node's distances are one row, and so are a crowd's pivots, so a member costs a row until its pivots are chosen.
    apart = edits.groupBy("node").agg(F.max("size").alias("size"), F.map_from_entries(F.collect_list(F.struct("hub", (F.col("lacking") + F.size("added")).alias("d")))).alias("far"))
    met = members.select("key", "node", "own").join(pivots.groupBy("key").agg(F.collect_set("a").alias("pivots")), "key").join(apart, "node")
    others = F.filter("pivots", lambda a: a != F.col("node"))
    met = met.withColumn("at", F.transform(others, lambda a: F.struct(a.alias("hub"), F.element_at("far", a).alias("d"))))
    # A pivot is at no distance from itself, so it is its own nearest; it has been held against all members already.
    met = met.withColumn("least", F.when(F.array_contains("pivots", F.col("node")), 0).otherwise(F.array_min(F.transform("at", lambda x: x["d"]))))
    kept = F.filter("at", lambda x: p * (x["d"] - F.col("least")) <= 2 * (q - p) * F.col("size"))
    near = met.select("node", "own", "least", F.explode(kept).alias("x"))
    return near.groupBy(F.col("x.hub").alias("hub"), "node").agg(F.max(F.col("own") & (F.col("x.d") == F.col("least"))).alias("own"))


def _across(edits: DataFrame) -> DataFrame:
    """(a, b) of nodes about one hub (hub, node, root, own, alike, size, lacking, added) whose groups differ and that can be alike, one of them there for its own sake.

    Sets x and y are alike if they differ by no more than (q - p) / (q + p) of |x| + |y| shingles (LEAST is p / q). What
    they lack of the hub differs by the difference of the numbers at least; of what they add, shingles that no other
    adds differ for certain, and all rare ones do unless the two share a rare one, by which they then meet.
    """
    p, q = LEAST
    tokens = edits.select("hub", "node", F.explode("added").alias("token"))
    counts = tokens.groupBy("hub", "token").agg(F.count("*").alias("n"))
    known = materialize(tokens.join(counts, ["hub", "token"]))
    kinds = known.groupBy("hub", "node").agg(F.count_if(F.col("n") <= RARE).alias("rare"), F.count_if(F.col("n") > 1).alias("shared"))
    rows = edits.withColumn("more", F.size("added")).drop("added").join(kinds, ["hub", "node"], "left")
    rows = materialize(rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("int") for c in ("rare", "shared")}))
    names = ["node", "root", "own", "alike", "size", "lacking", "more", "rare", "shared"]
    x, y = (rows.select("hub", *[F.col(c).alias(f"{c}_{n}") for c in names]) for n in "xy")
    lacking = F.abs(F.col("lacking_x") - F.col("lacking_y"))
    near = lambda d: (q + p) * d <= (q - p) * (F.col("size_x") + F.col("size_y"))
    # Pairs that share a rare added shingle.
    rare = known.where((F.col("n") > 1) & (F.col("n") <= RARE)).select("hub", "token", "node")
    left, right = (rare.withColumnRenamed("node", f"node_{n}").join(t, ["hub", f"node_{n}"]) for n, t in (("x", x), ("y", y)))
    can = near(lacking + F.col("more_x") + F.col("more_y") - 2 * F.least("shared_x", "shared_y"))
    by_token = left.where("own_x").join(right, ["hub", "token"]).where((F.col("node_x") != F.col("node_y")) & (F.col("root_x") != F.col("root_y")) & can)
    # Pairs that share none: they lack about as many, so they meet by that number.
    width = 16
    reach = (q - p) * F.col("size_x") / p - F.col("rare_x")
    fields = F.sequence(F.floor((F.col("lacking_x") - reach) / width), F.floor((F.col("lacking_x") + reach) / width))
    spread = x.where(~F.col("alike_x") & (reach >= 0)).withColumn("_f", F.explode(fields))
    placed = y.withColumn("_f", F.floor(F.col("lacking_y") / width))
    close = spread.where("own_x").join(placed, ["hub", "_f"]).unionByName(spread.where("not own_x").join(placed.where("own_y"), ["hub", "_f"]))
    by_size = close.where((F.col("node_x") != F.col("node_y")) & (F.col("root_x") != F.col("root_y")) & near(lacking + F.col("rare_x") + F.col("rare_y")))
    ends = [F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")]
    return by_token.select(*ends).union(by_size.select(*ends)).distinct()


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs that connect the nodes (node, fp) whose fingerprints are linked. Nodes of one fingerprint meet its hub, and hubs meet as their fingerprints are linked."""
    fps = materialize(nodes.groupBy("fp").agg(F.min(F.struct(F.xxhash64("node").alias("o"), "node")).alias("m"), F.count("*").alias("n")).select("fp", F.col("m.node").alias("hub"), "n"))
    same = hot_lookup(nodes, fps, "fp", "n").select(F.col("hub").alias("x"), F.col("node").alias("y"))
    one, two = (fps.select(F.col("fp").alias(c), F.col("hub").alias(n)) for c, n in ("ax", "by"))
    linked = links(fps).select("a", "b").distinct().join(one, "a").join(two, "b").select("x", "y")
    return same.union(linked).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, row, node, root) of every row; rows of one root are one group."""
    marks = materialize(marked(docs))
    printed = materialize(by_fingerprint(marks.groupBy("node").agg(F.first("fp").alias("fp"))))
    members = marks.groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.posexplode("bands").alias("band", "key"))
    drawn = F.struct(F.xxhash64("node", F.pmod("band", F.lit(HUBS))).alias("o"), F.col("node").alias("hub"))
    hubs = materialize(members.groupBy("key").agg(F.min(drawn).alias("m"), F.count("*").alias("n")).where("n > 1").select("key", F.col("m.hub").alias("hub"), "n"))
    shared = materialize(hot_lookup(members.select("key", "node"), hubs, "key", "n").where("hub is not null and node <> hub").select("key", "node", "hub"))
    wanted = shared.select("node").union(shared.select("hub")).union(printed.select("a")).union(printed.select("b")).distinct()
    texts = materialize(_texts(docs).groupBy("node").agg(F.min("text").alias("text")).join(wanted, "node", "left_semi"))
    pairs = printed.union(shared.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))).distinct()
    near = materialize(verified(materialize(pairs), texts))
    roots = materialize(connected(near))
    held = materialize(shared.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    mixed = held.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    open_ = materialize(held.join(mixed, "key", "left_semi").select(F.col("key").cast("string").cast("binary").alias("key"), "node", "root"))
    if not open_.isEmpty():
        profiles = materialize(_profiles(texts.join(open_.select("node").distinct(), "node", "left_semi")))
        open_, left = open_.withColumn("own", F.lit(True)), []
        for last in [False] * (SPLITS - 1) + [True]:
            pivots = _parting(_pivots(open_, profiles), texts)
            about = open_.join(pivots, "key").where("a <> node").select("a", F.col("node").alias("b")).distinct()
            edits = materialize(_edits(materialize(about), texts))
            near = near.union(edits.where("alike").select(F.col("hub").alias("a"), F.col("node").alias("b")))
            roots = materialize(connected(near))
            regions = materialize(_regions(open_, pivots, edits).join(roots, "node", "left").select("hub", "node", "own", F.coalesce("root", "node").alias("root")))
            mixed = regions.groupBy("hub").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count_if("own").alias("n")).where("low <> high and n > 0").select("hub", "n")
            regions = materialize(regions.join(mixed, "hub"))
            few = F.lit(True) if last else F.col("n") <= FEW
            left.append(edits.join(regions.where(few).drop("n"), ["hub", "node"]))
            open_ = regions.where(~few).select(F.col("hub").alias("key"), "node", "own", "root")
            if open_.isEmpty():
                break
        for edits in left:
            rest = edits.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            near = near.union(materialize(verified(materialize(_across(materialize(rest))), texts)))
        roots = connected(near)
    sizes = marks.groupBy("node").agg(F.count("*").alias("n")).join(roots, "node")
    return hot_lookup(marks.drop("fp", "bands"), sizes, "node", "n").withColumn("root", F.coalesce("root", "node"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of similar texts: that of the smallest id, then of the smallest hash of its columns. Rows without an id stay."""
    groups = similar_groups(docs)
    first = groups.where("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("m"))
    row = unused("_row", docs)
    kept = materialize(first.select(F.col("m.doc_id").alias("doc_id"), F.col("m.row").alias(row)))
    once = docs.withColumn(row, row_hash(docs)).join(kept, ["doc_id", row], "left_semi").dropDuplicates(["doc_id", row])
    return once.drop(row).union(docs.where("doc_id is null"))
