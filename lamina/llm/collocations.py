"""Phrase collocations by partitioned mining: shards propose phrases at lowered support, all proposals are counted exactly.

Input partitions are dealt into ``shards``. A phrase of global support ``least`` has ``least / shards`` occurrences in one
shard at least, whatever the shards' sizes, so each shard is mined completely at that support: single words and pairs
first, then longer phrases whose two parts of one word less are proposed already. Mining works on 48-bit keys of
(language, phrase) in blocks of numbers, and its union is a bitmap of fixed size, which is all that the driver and the
passes hold; keys that collide only propose phrases in vain. The last pass counts proposed phrases by their very words,
and the wanted support is then asked of those exact counts.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs. Null
texts are empty, null languages are ``und``. Every row counts, repeated ones too. Parts of very long texts overlap by the
words a phrase may need, so none is lost or counted twice. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spans
from .common import batch_of, materialize, read_table, shuffle_partitions

#: Words of a phrase at most; occurrences at least; hundredths of a phrase's occurrences that a longer one must have to replace it; phrases reported for each language.
MAX_WORDS, LEAST, INSIDE, TOP = 3, 10, 50, 2000
#: Fewer shards ask for higher local support, so less is proposed that turns out rare; at two or more, phrases of one occurrence are never sent.
SHARDS = 2
#: Bits of the bitmap of proposed phrases.
BITMAP = 28
#: Keys, or phrases, that a task gathers before it passes them on.
HELD_KEYS, HELD_PHRASES, SENT = 2_000_000, 1_500_000, 50_000
#: Bytes of text worked on at once.
CHUNK = 1 << 20

_KINDS = spans.byte_kinds(spaces=b" \t", breaks=b".,;:!?\n\x0b\x0c\r")
_MORE = np.uint64(0xA24BAED4963EE407)


def _seed(lang: str) -> int:
    return int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little")


def phrases(w: spans.Words, seeds: np.ndarray, max_words: int, bitmap: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, first word, key) of all phrases whose last word is fresh, by length. ``seeds`` has a number for each row of the batch.

    With ``bitmap``, phrases of three words or more are left out unless it has their first and their last words but one.
    """
    if not len(w.start):
        return
    hashes = w.hashes()
    cuts = np.concatenate([[0], np.cumsum(w.kinds == spans.BREAK)])[w.start]
    together = (w.row[1:] == w.row[:-1]) & (cuts[1:] == cuts[:-1])
    first, key = np.arange(len(hashes)), spans._mixed(hashes ^ seeds[w.row])
    for k in range(1, max_words + 1):
        if k > 1:
            more = np.flatnonzero(first + k - 1 < len(hashes))
            more = more[together[first[more] + k - 2]]
            if k > 2 and bitmap is not None:
                known = np.zeros(len(hashes) + 1, dtype=bool)
                known[first] = marked(bitmap, key)
                more = more[known[first[more]] & known[first[more] + 1]]
            first, key = first[more], spans._mixed(key[more] * _MORE + hashes[first[more] + k - 1])
        fresh = w.fresh[first + k - 1]
        yield k, first[fresh], key[fresh]


def marked(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a bitmap (bytes) has each key, by its first bits."""
    p = (key >> np.uint64(64 - (len(bitmap).bit_length() + 2))).astype(np.int64)
    return (bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1


def _with_langs(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))


def _summed(keys: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts, no higher than ``most``."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[at], np.minimum(np.add.reduceat(counts[order].astype(np.int64), at), most) if len(at) else counts[:0]


def proposed(docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, shards: int = SHARDS, bits: int = BITMAP) -> np.ndarray:
    """Bitmap (bytes) of the keys of phrases that some shard holds ``least / shards`` times or more, mined length by length."""
    out = _mined(docs, least, 1, min(max_words, 2), shards, bits, None)
    for k in range(3, max_words + 1):
        out |= _mined(docs, least, k, k, shards, bits, out)
    return out


def _mined(docs: DataFrame, least: int, low: int, high: int, shards: int, bits: int, known: np.ndarray | None) -> np.ndarray:
    """The bitmap of phrases of ``low`` to ``high`` words.

    Tasks send their keys, sorted and counted, in blocks by their first bits; a group is one block of all shards, about a
    shuffle partition's share of distinct phrases. Counts are kept up to the local support only, which decides nothing else.
    """
    local = -(-least // shards)
    block_bits = min(max(shuffle_partitions(docs.sparkSession) - 1, 1).bit_length(), bits - 8)
    n_blocks, width = 1 << block_bits, 1 << (bits - block_bits)
    unit = "<u1" if local < 256 else "<u4"
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("n", pa.binary())])
    edges = np.arange(1, n_blocks, dtype=np.uint64) << np.uint64(48 - block_bits)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def sent(shard: int, keys: list[np.ndarray]) -> pa.RecordBatch:
        key = np.concatenate(keys)
        key, n = _summed(key, np.ones(len(key), dtype=np.int64), local)
        cut = [0, *np.searchsorted(key, edges).tolist(), len(key)]
        rows = [(shard, b, key[s:e].astype("<u4").tobytes(), (key[s:e] >> np.uint64(32)).astype("<u2").tobytes(), n[s:e].astype(unit).tobytes()) for b, (s, e) in enumerate(zip(cut, cut[1:], strict=False)) if e > s]
        return batch_of(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, n = TaskContext.get().partitionId() % shards, [], 0
        for b in batches:
            seeds = np.array([_seed(x) for x in b.column("lang").to_pylist()], dtype=np.uint64)
            for w in spans.words(b.column("text"), _KINDS, fold=True, context=high - 1, limit=CHUNK):
                for k, _, key in phrases(w, seeds, high, shared.value):
                    if k >= low:
                        held.append(key >> np.uint64(16))
                        n += len(key)
                if n > HELD_KEYS:
                    yield sent(shard, held)
                    held, n = [], 0
        if n:
            yield sent(shard, held)

    def union(table: pa.Table) -> pa.Table:
        block, found = table.column("block")[0].as_py(), np.zeros(width, dtype=bool)
        shard = table.column("shard").to_numpy()
        for s in np.unique(shard):
            part = table.filter(pa.array(shard == s))
            low, high, n = (np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=t) for c, t in (("low", "<u4"), ("high", "<u2"), ("n", unit)))
            key, n = _summed(low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)), n, local)
            found[(key[n >= local] >> np.uint64(48 - bits)).astype(np.int64) - block * width] = True
        return pa.table({"block": pa.array([block], pa.int32()), "bits": pa.array([zlib.compress(np.packbits(found, bitorder="little").tobytes(), 1)], pa.binary())})

    rows = _with_langs(docs).mapInArrow(mine, "shard int, block int, low binary, high binary, n binary")
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in rows.groupBy("block").applyInArrow(union, "block int, bits binary").collect():  # the bitmap, whose size is given
        out[r.block * width // 8 : (r.block + 1) * width // 8] = np.frombuffer(zlib.decompress(r.bits), dtype=np.uint8)
    return out


def counted(docs: DataFrame, bitmap: np.ndarray, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, phrase, n): exact occurrences of each phrase that the bitmap proposes, and of all words (null phrase) of each language."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def flush(seen: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        """All that was seen, in order, which compresses well. A key is the language, a line end, which no phrase holds, and the phrase."""
        keys = sorted(seen)
        for i in range(0, len(keys), SENT):
            some = keys[i : i + SENT]
            langs, texts = zip(*(k.rsplit(b"\n", 1) for k in some), strict=True)
            yield batch_of(schema, lang=[x.decode() for x in langs], phrase=[x.decode() for x in texts], n=[seen[k] for k in some])
        seen.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, total = shared.value, Counter()
        seen: dict[bytes, int] = {}
        for b in batches:
            langs = b.column("lang").to_pylist()
            codes = {x: i for i, x in enumerate(dict.fromkeys(langs))}
            heads, code = [x.encode() + b"\n" for x in codes], np.array([codes[x] for x in langs], dtype=np.int64)
            seeds = np.array([_seed(x) for x in codes], dtype=np.uint64)[code] if heads else np.zeros(0, dtype=np.uint64)
            for w in spans.words(b.column("text"), _KINDS, fold=True, context=max_words - 1, limit=CHUNK):
                for c, k in zip(*np.unique(code[w.row[w.fresh]], return_counts=True), strict=True):
                    total[heads[c]] += int(k)
                if not len(w.start):
                    continue
                plain = np.concatenate([[0], np.cumsum((w.start[1:] - w.end[:-1] != 1) | (w.data[w.end[:-1]] != 32))])  # gaps so far that aren't one space
                at, last, keys = [], [], []
                for k, first, key in phrases(w, seeds, max_words, bitmap):
                    hit = marked(bitmap, key)
                    at.append(first[hit])
                    last.append(first[hit] + k - 1)
                    keys.append(key[hit])
                at, last, keys = (np.concatenate(x) for x in (at, last, keys))
                odd = plain[at] != plain[last]
                for i, j in zip(at[odd].tolist(), last[odd].tolist(), strict=True):
                    k = heads[code[w.row[i]]] + b" ".join(w.data[s:e].tobytes() for s, e in zip(w.start[i : j + 1].tolist(), w.end[i : j + 1].tolist(), strict=True))
                    seen[k] = seen.get(k, 0) + 1
                at, last, keys = at[~odd], last[~odd], keys[~odd]
                start, length, lang = w.start[at], w.end[last] - w.start[at], code[w.row[at]]

                def equal(x, y, w=w, start=start, length=length, lang=lang):
                    same = (length[x] == length[y]) & (lang[x] == lang[y])
                    return same & spans.same_bytes(w.data, start[x], w.data, start[y], np.where(same, length[x], 0))

                times = np.bincount(spans.insert(keys, equal), minlength=len(keys))
                raw, some = w.data.tobytes(), np.flatnonzero(times)
                for s, e, c, n in zip(start[some].tolist(), (start + length)[some].tolist(), lang[some].tolist(), times[some].tolist(), strict=True):
                    k = heads[c] + raw[s:e]
                    seen[k] = seen.get(k, 0) + n
                if len(seen) > HELD_PHRASES:
                    yield from flush(seen)
        yield from flush(seen)
        yield batch_of(schema, lang=[k[:-1].decode() for k in total], phrase=[None] * len(total), n=list(total.values()))

    return _with_langs(docs).mapInArrow(count, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, shards: int = SHARDS) -> DataFrame:
    """(lang, phrase, n) of all phrases with ``least`` occurrences or more, single words included, and the number of all words (null phrase)."""
    docs = docs.select("text", "lang")
    exact = counted(docs, proposed(docs, least, max_words, shards), max_words)
    return materialize(exact.where((F.col("n") >= least) | F.col("phrase").isNull()))


def scored(found: DataFrame, inside: int = INSIDE) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases of two words or more: the lowest-scoring cut, without those that a longer phrase replaces.

    Parts of a frequent phrase are frequent, so both sides of every cut are in ``found``. Scores are exact decimals of 38 digits.
    """
    known = found.where("phrase is not null")
    words = F.split("phrase", " ")
    longer = known.where(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("n").alias("a"), words.alias("w"))
    part = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cuts = longer.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.size("w") - F.col("cut")).alias("right"))
    sides = known.select("lang", F.col("phrase").alias("side"), "n")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(sides.withColumnsRenamed({"side": side, "n": name}).hint("merge"), ["lang", side])
    score = F.expr("cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x"))
    inner = (
        longer.where(F.size("w") > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("k"))
        .select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)).alias("at"))
        .groupBy("lang", part(F.col("at"), F.col("k")).alias("phrase")).agg(F.max("a").alias("most"))
    )
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < inside * F.col("a")))
    return kept.select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def leading(rows: DataFrame, group: str, order: list, top: int) -> DataFrame:
    """``rows`` and their ``rank`` among the first ``top`` of each group, in ever fewer buckets, so that no task sorts a whole group."""
    buckets = shuffle_partitions(rows.sparkSession)
    for n in (buckets, int(buckets**0.5)):
        if n > 1:
            place = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order))
            rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("phrase"), F.lit(n))).withColumn("_place", place).where(F.col("_place") <= top).drop("_bucket", "_place")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, inside: int = INSIDE, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by score, occurrences, then bytes."""
    found = frequent(docs, least, max_words, shards)
    totals = found.where("phrase is null").select("lang", F.col("n"))
    rows = leading(scored(found, inside), "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


QUERIES = {"op12_phrase_collocations": op12_phrase_collocations}

ORACLE_SQL = {
    "op12_phrase_collocations": r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p
), g AS (SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i : i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS k)
), f AS (SELECT lang, phrase, k, count(*) AS a FROM g GROUP BY ALL
), n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10
), u AS (SELECT lang, phrase, a, cut, array_to_string(w[1 : cut], ' ') AS x, array_to_string(w[cut + 1 : k], ' ') AS y FROM c, (SELECT unnest([1, 2]) AS cut) WHERE cut < k
), s AS (
  SELECT u.lang, u.phrase, u.a, cut, l.a AS l, r.a AS r, CAST((1000000::HUGEINT * u.a * u.a) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM u JOIN f l ON l.lang = u.lang AND l.phrase = x JOIN f r ON r.lang = u.lang AND r.phrase = y
), b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM s
), i AS (SELECT lang, array_to_string(w[j : j + 1], ' ') AS phrase, max(a) AS most FROM c, (SELECT unnest([1, 2]) AS j) WHERE k = 3 GROUP BY ALL
), kept AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE o = 1 AND (most IS NULL OR 100 * most < 50 * a)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
}
