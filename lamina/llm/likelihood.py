"""LM scoring by a lattice of subwords: the log-probability of a text summed over all its segmentations.

A text is its words, lower-cased (A-Z), each with a mark before it, and one end. The model draws pieces of a given vocabulary
independently until it draws the end, so a text's probability is the sum over all ways to cut it, and as no piece crosses
a mark, that is the product of its words' sums. The vocabulary's own scores are the first estimate and the prior;
expectation-maximisation over the words of the learning documents, by how often they have them, refines them. Bytes that
are no piece themselves are added as pieces, so every text has a positive probability.

Beside it stands the add-one probability of the tokens (words and end) themselves. Words are summed once over all
documents: their table, which grows with the input, has each word's count in learning documents and its lattice
score. Texts then look up the bounded number of most frequent words where they are read, and meet the others in a join.

Null texts are empty (the end alone). Every row gives one row, repeated ones too; rows with a null id are learned from.
With nothing to learn from, the prior stands. An empty table gives no rows. Other columns are ignored. A word is held
whole in one task, at some hundred bytes for each of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import batch_of, materialize, read_table

#: Rounds of expectation-maximisation; weight of the prior in pieces; the prior's share of ends.
ROUNDS, PRIOR, END_SHARE = 3, 1000.0, 0.05
#: Words whose scores every task holds: at most so many, of so many bytes in all, each of so many at most.
HOT_WORDS, HOT_BYTES, HOT_LONGEST = 131_072, 32 << 20, 4096
#: Distinct words a task gathers before it passes them on.
HELD = 400_000

_KINDS = spans.byte_kinds()
_B = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(64 - 20)


@dataclass
class Pieces:
    """A vocabulary over bytes, sorted by hash; the mark before a word is a space. The last weight is that of the end."""

    keys: np.ndarray
    data: np.ndarray  # bytes of the pieces, one after the other
    start: np.ndarray
    length: np.ndarray
    prior: np.ndarray  # probabilities, which sum to 1 with the end's
    present: np.ndarray  # of the top bits of a hash: whether some piece has them

    @classmethod
    def of(cls, scores: dict[bytes, float]) -> Pieces:
        """From natural log-weights; bytes without a piece get the lowest weight less ten."""
        low = min(scores.values(), default=0.0) - 10
        names = {**scores, **{bytes([b]): low for b in range(256) if bytes([b]) not in scores}}
        if any(not p or b" " in p[1:] for p in names):
            raise ValueError("a piece is empty or holds a mark after its first byte")
        hashes = {p: _hash(p) for p in names}
        order = sorted(names, key=hashes.get)
        keys = np.array([hashes[p] for p in order], dtype=np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        weight = np.exp(np.array([names[p] for p in order]))
        length = np.array([len(p) for p in order])
        present = np.zeros(1 << 20, dtype=bool)
        present[(keys >> _TOP).astype(np.int64)] = True
        data = np.frombuffer(b"".join(order) + bytes(8), dtype=np.uint8)
        return cls(keys, data, np.cumsum(length) - length, length, np.append(weight / weight.sum() * (1 - END_SHARE), END_SHARE), present)

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Of the sentencepiece model at ``path``: its pieces that a lower-cased, marked word can hold.

        Scores that are whole numbers only rank the pieces, as a model made for merges has them; a piece of rank r then weighs 1 / (r + 1).
        """
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        own = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        raw = {i: sp.get_score(i) for i in own}
        if all(float(s).is_integer() for s in raw.values()):
            raw = {i: -math.log(r + 1) for r, i in enumerate(sorted(own, key=lambda i: -raw[i]))}
        scores = {}
        for i in own:
            p = sp.id_to_piece(i).replace("▁", " ").encode()
            inner = p[1:] if p[:1] == b" " else p
            if p and not any(c in b" \t\n\x0b\x0c\r" or 65 <= c <= 90 for c in inner):
                scores[p] = raw[i]
        return cls.of(scores)

    def edges(self, data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of every piece that stands in the words; ``end`` gives, for each byte, where its word ends."""
        at, h, found = np.arange(len(end)), np.zeros(len(end), dtype=np.uint64), []
        for n in range(1, int(self.length.max(initial=0)) + 1):
            fits = at + n <= end[at]
            at, h = at[fits], h[fits]
            if not len(at):
                break
            h = h * _B + data[at + n - 1] + np.uint64(1)
            some = np.flatnonzero(self.present[(h >> _TOP).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
            hit = (self.keys[k] == h[some]) & (self.length[k] == n)
            some, k = some[hit], k[hit]
            same = spans.same_bytes(data, at[some], self.data, self.start[k], np.full(len(k), n))
            found.append((at[some[same]], np.full(int(same.sum()), n), k[same]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _hash(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * int(_B) + b + 1) & ((1 << 64) - 1)
    return h


def lattice(pieces: Pieces, logs: np.ndarray, words: list[bytes], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log of each word's probability over all segmentations; with ``counts`` also the expected uses of each piece.

    Words lie one after the other; all edges that start equally far into their words are followed at once.
    """
    if not words:
        return np.zeros(0), None if counts is None else np.zeros(len(logs))
    length = np.array([len(x) + 1 for x in words])
    data = np.frombuffer(b" " + b" ".join(words) + bytes(8), dtype=np.uint8)
    begin = np.cumsum(length) - length
    start, n, piece = pieces.edges(data, np.repeat(begin + length, length))
    word = np.repeat(np.arange(len(words)), length)[start]
    offset = start - begin[word]
    order = np.argsort(offset, kind="stable")
    source, target = (start + word)[order], (start + word + n)[order]  # a word of n bytes has n + 1 nodes
    weight, piece, word = logs[piece[order]], piece[order], word[order]
    cut = np.flatnonzero(np.diff(offset[order], prepend=-1)).tolist() + [len(order)]
    steps = list(zip(cut, cut[1:], strict=False))
    first, last = begin + np.arange(len(words)), begin + np.arange(len(words)) + length
    ahead = np.full(int(length.sum()) + len(words), -np.inf)
    ahead[first] = 0
    for s, e in steps:
        ahead[target[s:e]] = np.logaddexp(ahead[target[s:e]], ahead[source[s:e]] + weight[s:e])
    total = ahead[last]
    if counts is None:
        return total, None
    behind = np.full(len(ahead), -np.inf)
    behind[last] = 0
    for s, e in reversed(steps):
        for at in _layers(source[s:e]):
            at = at + s
            behind[source[at]] = np.logaddexp(behind[source[at]], behind[target[at]] + weight[at])
    share = np.exp(ahead[source] + weight + behind[target] - total[word]) * counts[word]
    return total, np.bincount(piece, weights=share, minlength=len(logs))


def _layers(keys: np.ndarray) -> Iterator[np.ndarray]:
    """Positions in layers, so that no key occurs twice in one."""
    order = np.argsort(keys, kind="stable")
    run = np.arange(len(keys)) - np.maximum.accumulate(np.where(np.diff(keys[order], prepend=-1) != 0, np.arange(len(keys)), 0))
    for k in range(int(run.max(initial=-1)) + 1):
        yield order[run == k]


def held_out():
    """True for documents that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))


def _unique(w: spans.Words) -> np.ndarray:
    """For each word of a chunk the first one equal to it."""
    length = w.end - w.start

    def equal(a, b):
        same = length[a] == length[b]
        return same & spans.same_bytes(w.data, w.start[a], w.data, w.start[b], np.where(same, length[a], 0))

    return spans.insert(w.hashes(), equal)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, c) of all documents: occurrences in all and in those learned from; the end is the null word."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}
        ends = [0, 0]

        def flush():
            return batch_of(schema, word=[k.decode() for k in seen], n=[v[0] for v in seen.values()], c=[v[1] for v in seen.values()])

        for b in batches:
            learned = ~b.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            ends = [ends[0] + b.num_rows, ends[1] + int(learned.sum())]
            for w in spans.words(b.column("text"), _KINDS, fold=True):
                if not len(w.start):
                    continue
                holder = _unique(w)
                n, c = (np.bincount(holder, weights=x, minlength=len(holder)).astype(np.int64) for x in (None, learned[w.row]))
                first = np.flatnonzero(n)
                for word, n1, c1 in zip(w.texts_at(first), n[first].tolist(), c[first].tolist(), strict=True):
                    v = seen.setdefault(word, [0, 0])
                    v[0] += n1
                    v[1] += c1
                if len(seen) > HELD:
                    yield flush()
                    seen.clear()
        yield flush()
        yield batch_of(schema, word=[None], n=[ends[0]], c=[ends[1]])

    rows = docs.select("text", held_out().alias("held_out")).mapInArrow(run, "word string, n bigint, c bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def fit(vocabulary: DataFrame, pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Natural log-probabilities of the pieces and, last, the end; only sums for each piece of the given vocabulary come to the driver."""
    sc = vocabulary.sparkSession.sparkContext
    shared = sc.broadcast(pieces)
    schema = pa.schema([("piece", pa.int32()), ("uses", pa.float64())])
    known = vocabulary.where("word is not null and c > 0").select("word", "c")
    ends = vocabulary.where("word is null").agg(F.sum("c")).first()[0] or 0
    prob = pieces.prior
    for _ in range(rounds):
        logs = sc.broadcast(np.log(prob))

        def expect(batches: Iterator[pa.RecordBatch], logs=logs) -> Iterator[pa.RecordBatch]:
            uses = np.zeros(len(logs.value))
            for b in batches:
                uses += lattice(shared.value, logs.value, [x.encode() for x in b.column(0).to_pylist()], b.column(1).to_numpy().astype(float))[1]
            at = np.flatnonzero(uses)
            yield batch_of(schema, piece=at, uses=uses[at])

        uses = np.zeros(len(prob))
        for r in known.mapInArrow(expect, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():  # at most one for each piece
            uses[r.piece] = r.uses
        uses[-1] = ends
        prob = (uses + PRIOR * pieces.prior) / (uses.sum() + PRIOR)
    return np.log(prob)


def word_scores(vocabulary: DataFrame, pieces: Pieces, logs: np.ndarray) -> DataFrame:
    """(word, n, c, lattice): each word with the log10 of its probability."""
    shared = vocabulary.sparkSession.sparkContext.broadcast((pieces, logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, logs = shared.value
        for b in batches:
            total, _ = lattice(pieces, logs, [x.encode() for x in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(total / math.log(10))], names=["word", "n", "c", "lattice"])

    return vocabulary.where("word is not null").select("word", "n", "c").mapInArrow(run, "word string, n bigint, c bigint, lattice double")


@dataclass
class Hot:
    """The most frequent words, sorted by hash, with their counts and lattice scores."""

    keys: np.ndarray
    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    c: np.ndarray
    lattice: np.ndarray

    @classmethod
    def of(cls, table: DataFrame, limit: int = HOT_WORDS) -> Hot:
        """Words of the highest frequency classes that keep to the limits in all; where the first class is over them, no word is frequent enough to matter."""
        rows = table.where(F.octet_length("word") <= HOT_LONGEST).withColumn("_class", F.floor(8 * F.log2("n")))
        count, size, least = 0, 0, None
        for r in sorted(rows.groupBy("_class").agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("size")).collect(), key=lambda r: -r._class):  # a few hundred
            count, size = count + r.n, size + r.size
            if count > limit or size > HOT_BYTES:
                break
            least = r._class
        found = [] if least is None else rows.where(F.col("_class") >= least).select("word", "c", "lattice").collect()
        words = [r.word.encode() for r in found]
        length = np.array([len(x) for x in words], dtype=np.int64)
        start = np.cumsum(length) - length
        data = np.frombuffer(b"".join(words) + bytes(8), dtype=np.uint8)
        w = spans.Words(data, data[:-8], start, start + length, *[np.zeros(0)] * 4, 0)
        keys = w.hashes()
        order = np.argsort(keys, kind="stable")
        return cls(keys[order], data, start[order], length[order], np.array([r.c for r in found], dtype=np.int64)[order], np.array([r.lattice for r in found], dtype=float)[order])

    def find(self, w: spans.Words, at: np.ndarray) -> np.ndarray:
        """Place of each of the words ``at`` of a chunk in this table, or -1. Of words with one hash only the first is found here; the others are joined."""
        if not len(self.keys):
            return np.full(len(at), -1)
        h = w.hashes()[at]
        k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        length = w.end[at] - w.start[at]
        same = (self.keys[k] == h) & (self.length[k] == length)
        same &= spans.same_bytes(w.data, w.start[at], self.data, self.start[k], np.where(same, length, 0))
        return np.where(same, k, -1)


def score(docs: DataFrame, pieces: Pieces, rounds: int = ROUNDS, hot_words: int = HOT_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    docs = docs.select("doc_id", "text")
    vocabulary = materialize(word_counts(docs))
    total = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("c"))), F.lit(0)).alias("ends")).first()
    logs = fit(vocabulary, pieces, rounds)
    table = materialize(word_scores(vocabulary, pieces, logs))
    shared = docs.sparkSession.sparkContext.broadcast(Hot.of(table, hot_words))
    below = total.n + total.v + 1
    fields = [("uid", pa.int64()), ("held_out", pa.bool_()), ("own", pa.bool_()), ("word", pa.string()), ("k", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("lattice", pa.float64())]
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, uid = shared.value, TaskContext.get().partitionId() << 40
        base = np.log10((hot.c + 1) / below)
        for b in batches:
            schema = pa.schema([("doc_id", b.schema.field("doc_id").type), *fields])
            n = b.num_rows
            own = np.zeros((4, n))
            for w in spans.words(b.column("text"), _KINDS, fold=True):
                if not len(w.start):
                    continue
                holder = _unique(w)
                first = np.flatnonzero(np.bincount(holder))
                place = np.full(len(holder), -1)
                place[first] = hot.find(w, first)
                place = place[holder]
                got = place >= 0
                row, place = w.row[got], place[got]
                own[0] += np.bincount(w.row, minlength=n)
                for i, x in ((1, hot.c[place] > 0), (2, base[place]), (3, hot.lattice[place])):
                    own[i] += np.bincount(row, weights=x, minlength=n)
                pair, k = np.unique(w.row[~got] * len(holder) + holder[~got], return_counts=True)
                if len(pair):
                    at = pair // len(holder)
                    none = pa.nulls(len(pair), pa.float64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(len(pair), schema[0].type), pa.array(uid + at), pa.nulls(len(pair), pa.bool_()), pa.array(np.zeros(len(pair), dtype=bool)),
                         pa.array([x.decode() for x in w.texts_at(pair % len(holder))], pa.string()), pa.array(k), none.cast(pa.int64()), none.cast(pa.int64()), none, none], schema=schema)
            uids = np.arange(uid, uid + n)
            yield batch_of(
                schema, doc_id=b.column("doc_id"), uid=uids, held_out=b.column("held_out"), own=np.ones(n, dtype=bool), word=[f"{u % 4099}" for u in uids.tolist()], k=np.ones(n, dtype=np.int64),
                n_tokens=own[0].astype(np.int64) + 1, n_known=own[1].astype(np.int64) + int(total.ends > 0), base=own[2] + math.log10((total.ends + 1) / below), lattice=own[3] + logs[-1] / math.log(10),
            )
            uid += n

    # Rows with ``own`` are one for each document and carry what was summed at once; their word only spreads them.
    rows = docs.withColumn("held_out", held_out()).mapInArrow(run, f"doc_id {id_type}, uid bigint, held_out boolean, own boolean, word string, k bigint, n_tokens bigint, n_known bigint, base double, lattice double")
    met = rows.join(table.select("word", "c", F.col("lattice").alias("rest")).hint("merge"), "word", "left")
    own, c = F.col("own"), F.col("c")
    joined = lambda mine, rest: F.sum(F.when(own, F.col(mine)).otherwise(F.col("k") * rest))
    return (
        met.groupBy("uid").agg(
            F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), joined("n_known", (c > 0).cast("bigint")).alias("n_known"),
            F.lit(int(total.n)).cast("bigint").alias("train_tokens"), joined("base", F.log10((c + 1) / F.lit(float(below)))).alias("base_score"), joined("lattice", F.col("rest")).alias("score"),
        ).drop("uid")
    )


def op11_lattice_likelihood(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score(read_table(spark, sf_dir, "documents"), Pieces.load(public_tokenizers.path("piece_bpe_32k.model")))


QUERIES = {"op11_lattice_likelihood": op11_lattice_likelihood}
ORACLE_SQL: dict[str, str] = {}
