"""Best-fit packing of token sequences by minimum bin slack.

Every document is its token ids and an end id. Those longer than a sequence are cut into whole sequences, the rest
standing first. Null and empty texts give one piece with the end id alone. Every input row is packed, repeated ids and
rows included; an empty table gives an empty result; other columns are ignored.

Ids are those of the ``tokenizers`` library with its defaults, so an added token's string within a text is that token.
Texts without such a string and without a very long run of white space are encoded from the same vocabulary's ranks,
which gives the same ids faster; all others, and any text that the faster way can't encode, go to the library itself.

How pieces combine depends on their lengths alone, so the bins are planned over the histogram of lengths (as many rows
as a sequence has places, for any corpus), and pieces are dealt to the planned places by their rank within their length.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch_of, materialize, read_table, shuffle_partitions, texts_of

MAX_TOKENS = 1024
END_ID = 2

#: A run of so much white space is left to the library: the ranks' pattern matcher gives up on longer ones.
LONG_SPACE = 100_000

_encoders: dict = {}
_LONG_RUN = re.compile(r"\s{%d}" % LONG_SPACE)


class Encoder:
    """Byte-level BPE ids of a ``tokenizers`` file; ``ranks`` (a file of its merges as ranks, and their pattern) is the faster way to them."""

    def __init__(self, path: str, ranks: tuple[str, str]):
        import tiktoken

        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f)["added_tokens"]]
        with open(ranks[0], "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=ranks[1], mergeable_ranks=known, special_tokens={})

    @classmethod
    def load(cls, path: str, ranks: tuple[str, str]) -> Encoder:
        if (path, *ranks) not in _encoders:
            _encoders[(path, *ranks)] = cls(path, ranks)
        return _encoders[(path, *ranks)]

    def by_library(self, text: str) -> np.ndarray:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def ids(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added) or len(text) >= LONG_SPACE and _LONG_RUN.search(text):
            return self.by_library(text)
        try:
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=())).astype("<u4")
        except ValueError:  # the matcher's own limit
            return self.by_library(text)


def cut(ids: np.ndarray, max_tokens: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ids) of each piece: what is over a multiple of ``max_tokens`` first, then whole sequences."""
    first = len(ids) % max_tokens
    if first:
        yield 0, ids[:first]
    for start in range(first, len(ids), max_tokens):
        yield start, ids[start : start + max_tokens]


def pieces(docs: DataFrame, path: str, ranks: tuple[str, str], max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every piece; ids are little-endian unsigned 32-bit."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.binary())] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.load(path, ranks).ids
        for b in batches:
            schema = pa.schema([("doc_id", b.schema.field("doc_id").type), *fields])
            rows: list[tuple] = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts_of(b.column("text")), strict=True):
                ids = np.append(encode(text), np.uint32(end_id))
                for i, (start, part) in enumerate(cut(ids, max_tokens)):
                    raw = part.astype("<u4").tobytes()
                    rows.append((doc_id, i, start, len(part), zlib.crc32(raw), raw)[: len(schema)])
                if len(rows) >= 4096:
                    yield batch_of(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))
                    rows = []
            if rows:
                yield batch_of(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, with repeats as far as ``counts`` goes, whose sum is the largest that fits ``room``.

    Bit i of ``reach`` says that some choice of the lengths seen so far sums to i; each step's bitset is kept to trace the choice back.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        k = 1
        left = min(counts[length], room // length)
        while left > 0:  # so many copies as powers of two and a rest
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen: list[int] = []
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * k
            total -= length * k
    return chosen


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths, bins) patterns that use up ``counts``: the longest piece left opens a bin, the fullest combination of the others joins it.

    A pattern is repeated while its lengths last. A length's count falls under its use in the pattern each time one
    ends, so there are at most sum(1 + capacity / length) patterns, however many pieces there are.
    """
    counts = {k: v for k, v in counts.items() if v > 0}
    patterns = []
    while counts:
        first = max(counts)
        counts[first] -= 1
        chosen = [first, *fullest(counts, capacity - first)]
        counts[first] += 1
        used = {x: chosen.count(x) for x in set(chosen)}
        bins = min(counts[x] // n for x, n in used.items())
        patterns.append((sorted(chosen, reverse=True), bins))
        for x, n in used.items():
            counts[x] -= n * bins
            if not counts[x]:
                del counts[x]
    return patterns


def places(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank_from, rank_to, first_sequence, per_sequence, offset): which ranks of a length go where."""
    out, used, sequence = [], {}, 0
    for lengths, bins in patterns:
        offset = 0
        for length in dict.fromkeys(lengths):
            n = lengths.count(length)
            at = used.get(length, 0)
            out.append((length, at, at + n * bins, sequence, n, offset))
            used[length] = at + n * bins
            offset += n * length
        sequence += bins
    return out


def pack(cut_pieces: DataFrame, capacity: int = MAX_TOKENS) -> DataFrame:
    """``cut_pieces`` (a table with ``length``, 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Ranks within a length, where one length may hold most rows: rows are spread over buckets, each bucket's count gives
    the rank at which the next begins, and rows are numbered within their bucket.
    """
    spark = cut_pieces.sparkSession
    names = cut_pieces.columns
    n_buckets = max(64, 4 * shuffle_partitions(spark))
    told = [c for c in names if c not in ("length", "ids")]  # ids have a checksum among these
    rows = cut_pieces.withColumn("_bucket", F.pmod(F.xxhash64(*told), F.lit(n_buckets)).cast("int"))
    per_bucket = rows.groupBy("length", "_bucket").count()
    histogram = {r["length"]: r["n"] for r in per_bucket.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # one row per length
    if not histogram:
        return cut_pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    if max(histogram) > capacity or min(histogram) < 1:
        raise ValueError("a piece is empty or longer than a sequence")
    plan = spark.createDataFrame(places(plan_bins(histogram, capacity)), "length bigint, _from bigint, _to bigint, _sequence bigint, _n bigint, _offset bigint")
    before = F.sum("count").over(W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = per_bucket.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.partitionBy("length", "_bucket").orderBy(*told)) - 1
    ranked = rows.withColumn("_rank", rank).join(starts, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    step = F.col("_rank") - F.col("_from")
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).drop(plan["length"])
    return placed.withColumns({
        "sequence_id": F.col("_sequence") + F.floor(step / F.col("_n")).cast("long"),
        "offset": F.col("_offset") + F.pmod(step, F.col("_n")) * F.col("length"),
    }).select(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, encode: tuple[str, tuple[str, str]] | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Documents cut and packed. The cut pieces are written once to shared scratch, as both the plan and the placing read them."""
    import public_tokenizers

    path, ranks = encode or (public_tokenizers.path("byte_bpe_50k.json"), (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    return pack(materialize(pieces(docs, path, ranks, max_tokens, end_id, with_ids)), max_tokens)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """The packed pieces; their checksums are taken from the ids that were packed."""
    packed = pack_documents(read_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
