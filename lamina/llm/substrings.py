"""Substring dedup with repeated-phrase automata.

Words are runs of bytes other than space and 0x09-0x0D. A window is 13 consecutive words of one document; every word
under a window that also starts in a document of a smaller id is removed. Windows are judged on the input. Null, empty
and short texts have no window and lose nothing. Rows that repeat an id are one document's texts: none is the smaller
of the other. A null id is neither smaller nor larger, so such rows neither lose words nor make others lose any. An empty
table gives an empty result. Ids of any type that has an order will do; those that aren't whole numbers are numbered in
order first. Other columns are ignored by :func:`remove_repeats` and carried by :func:`cut_repeats`.

1. Each window is represented by the smallest hash among its 6-word phrases. A window in two documents has its phrase in
   both, so phrases seen in one document only rule out their windows. About a quarter of the words start such a phrase.
2. Windows with a shared phrase are hashed whole; each gets the smallest document that has it. They meet by phrase, those
   of the most frequent phrases by their own hash, so that a phrase in a third of all documents is spread over tasks.
3. Consecutive windows with one earlier document make a passage. That document is asked once for the passage's own words,
   and they are sent to every shard whose documents may hold them.
4. Each shard compiles its passages into an Aho-Corasick automaton over word numbers and streams its documents through
   it. Only what the automaton finds, word by word, is removed: hashes pick candidates and decide nothing.

Steps 2 to 4 read the documents by shard, and all three read one exchange of the texts.
What a task sees of a hash is brought down to one document before it is sent, so that a passage in a third of all
documents costs a row for each slice of the input, not for each document.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, materialize, read_table, shuffle_partitions, slices, texts_of, unused

WINDOW, PHRASE = 13, 6
#: Text looked at together in one task, and text of a shard at most (or of one document), in bytes.
SLICE, SHARD = 4 << 20, 16 << 20
SEGMENT = 1 << 20
#: A phrase that so many slices of the input share is frequent; the most frequent ones, so many at most, have their windows spread.
FREQUENT, MAX_FREQUENT = 64, 50_000

_rng = np.random.default_rng(13)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1 << 60, 1 << 62)) * 2 + 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        n = max(n, SEGMENT + (1 << 16))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            step = np.full(n, base, dtype=np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
    return _powers["up"], _powers["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of a byte array. Equal words have equal hashes wherever they stand."""
    edge = np.diff(np.concatenate([[True], _IS_SPACE[data], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(int(np.searchsorted(starts, a + SEGMENT)), i + 1)
        b = ends[j - 1]
        up, down = _power_tables(int(b - a) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data[a:b]] * up[: b - a])])
        out[i:j] = (total[ends[i:j] - a] - total[starts[i:j] - a]) * down[starts[i:j] - a]
        i = j
    return starts, _mixed(out)


def hash_runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(_BASE) + words[j : j + n]
    return _mixed(h)


class Words:
    """Word and window hashes of some texts: ``doc`` and ``pos`` say in which text, at which word, each window starts."""

    def __init__(self, texts: list[bytes], window: int = WINDOW):
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
        starts, self.words = hash_words(np.frombuffer(b"\n".join(texts), dtype=np.uint8))
        of = np.searchsorted(begins, starts, side="right") - 1
        self.n_words = np.bincount(of, minlength=len(texts))
        n = len(starts) - window + 1
        self.at = np.flatnonzero(of[:n] == of[window - 1 :]) if n > 0 else np.empty(0, np.int64)
        self.doc = of[self.at]
        self.pos = self.at - np.concatenate([[0], np.cumsum(self.n_words)[:-1]]).astype(np.int64)[self.doc]
        self.window = window

    def phrases(self, k: int = PHRASE) -> np.ndarray:
        """For each window, the smallest hash of its ``k``-word phrases."""
        h = hash_runs(self.words, min(k, self.window))
        span, low = self.window - min(k, self.window) + 1, h
        width = 1
        while width < span:  # minima over ever wider stretches, the last two of which overlap
            step = min(width, span - width)
            low = np.minimum(low[: len(low) - step], low[step:])
            width += step
        return low[self.at] if len(self.at) else np.empty(0, np.uint64)

    def hashes(self) -> np.ndarray:
        return hash_runs(self.words, self.window)[self.at] if len(self.at) else np.empty(0, np.uint64)


def _short(h: np.ndarray) -> np.ndarray:
    """Phrase hashes without the 16 bits that pick a bucket: six bytes tell phrases of a bucket apart well enough for a filter."""
    return h & np.uint64((1 << 48) - 1)


def _six(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8")[:, None].view(np.uint8)[:, :6]).tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(48)) % np.uint64(n)).astype(np.int32)


def _edges(*columns: np.ndarray) -> np.ndarray:
    """True at each row that differs from the one before."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _groups(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    at = np.flatnonzero(_edges(keys))
    return zip(at, np.append(at, len(keys))[1:], strict=True)


_KEYED = pa.schema([("bucket", pa.int32()), ("direct", pa.bool_()), ("hashes", pa.binary()), ("ids", pa.binary())])
_REPLY = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("n", pa.int32())])


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t.encode() for t in texts_of(batch.column("text"))]


def shared_phrases(docs: DataFrame, n_buckets: int) -> DataFrame:
    """(doc_id, hash, n): phrases that a document shares with another; some come twice. ``n`` counts the slices of the input seen to have the phrase."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.filter(batch.column("doc_id").is_valid()), SLICE):
                words = Words(_texts(part))
                phrase = words.phrases()
                new = _edges(words.doc, phrase)
                phrase, ids = phrase[new], part.column("doc_id").to_numpy()[words.doc[new]]
                order = np.lexsort((ids, phrase))
                phrase, ids = phrase[order], ids[order]
                first = _edges(phrase)
                group = np.cumsum(first) - 1
                least = ids[first][group]
                twice = np.bincount(group, weights=ids != least, minlength=1) > 0 if len(group) else np.empty(0, bool)
                rows = []
                # Shared within this slice: its documents are told so, by way of any bucket.
                known = twice[group] if len(group) else np.empty(0, bool)
                for direct, keep, key in ((False, first, None), (True, known, ids)):
                    h, d = phrase[keep], ids[keep]
                    b = _bucket(h, n_buckets) if key is None else ((d ^ (d >> 7)) % n_buckets).astype(np.int32)
                    o = np.lexsort((h, d, b))
                    h, d, b = h[o], d[o], b[o]
                    rows += [(int(b[s]), direct, _six(h[s:e]), d[s:e].astype("<i8").tobytes()) for s, e in _groups(b)]
                if rows:
                    yield batch_of(_KEYED, **dict(zip(_KEYED.names, zip(*rows, strict=True), strict=True)))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(list)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for b, direct, h, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if direct:
                    out.append((_from_six(h), np.frombuffer(d, dtype="<i8"), np.zeros(len(h) // 6, dtype=np.int32)))
                else:
                    held[b].append((_from_six(h), np.frombuffer(d, dtype="<i8")))
        for entries in held.values():
            h, d = (np.concatenate(x) for x in zip(*entries, strict=True))
            o = np.lexsort((d, h))
            h, d = h[o], d[o]
            first = _edges(h)
            group = np.cumsum(first) - 1
            other = np.bincount(group, weights=d != d[first][group]) > 0
            keep = other[group]
            out.append((h[keep], d[keep], np.bincount(group)[group][keep].astype(np.int32)))
        for h, d, n in out:
            for at in range(0, len(h), 100_000):
                some = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(d[some], pa.int64()), pa.array(h[some].view(np.int64), pa.int64()), pa.array(n[some], pa.int32())], schema=_REPLY)

    sent = docs.select("doc_id", "text").mapInArrow(send, "bucket int, direct boolean, hashes binary, ids binary")
    return sent.repartition("bucket").mapInArrow(answer, "doc_id bigint, hash bigint, n int")


def frequent_phrases(shared: DataFrame) -> np.ndarray:
    """The short hashes of the most frequent phrases, MAX_FREQUENT at most, in order. All documents' windows of such a phrase are keyed alike, so none is missed."""
    many = shared.where(F.col("n") >= FREQUENT).groupBy("hash").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "hash").limit(MAX_FREQUENT)
    return np.sort(np.array([r["hash"] for r in many.select("hash").collect()], dtype=np.int64).view(np.uint64))


#: A place: ``n`` consecutive windows of a document from word ``pos`` on that start in document ``source`` too, there from word ``source_pos`` on.
_PLACE = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("source", pa.int64()), ("source_pos", pa.int32())])
_PLACE_DDL = "doc_id bigint, pos int, n int, source bigint, source_pos int"
#: Windows sent to be compared: ``hashes`` of consecutive ones from ``pos`` on that have one phrase; or a place, without hashes.
_SENT = pa.schema([("key", pa.int64()), *_PLACE, ("hashes", pa.list_(pa.int64()))])
_SENT_DDL = f"key bigint, {_PLACE_DDL}, hashes array<bigint>"


def _joined_places(p: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Places (document, pos, n, source, source_pos) in order, those that continue one another as one."""
    d, pos, n, source, source_pos = p
    o = np.lexsort((source_pos, source, pos, d))
    d, pos, n, source, source_pos = d[o], pos[o], n[o], source[o], source_pos[o]
    new = _edges(d, source)
    new[1:] |= (pos[1:] != pos[:-1] + n[:-1]) | (source_pos[1:] != source_pos[:-1] + n[:-1])
    at = np.flatnonzero(new)
    return d[at], pos[at], np.add.reduceat(n, at) if len(at) else n[at], source[at], source_pos[at]


def _places(h: np.ndarray, d: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Of windows (hash, document, word): which are in no smaller document among these, and the places of the others."""
    o = np.lexsort((pos, d, h))
    h, d, pos = h[o], d[o], pos[o]
    edge = _edges(h)
    first = np.flatnonzero(edge)[np.cumsum(edge) - 1]
    later = d > d[first]
    return o[~later], _joined_places((d[later], pos[later], np.ones(int(later.sum()), dtype=np.int64), d[first[later]], pos[first[later]]))


def _try_windows(held: Held, shared: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Windows that may recur, keyed by their phrase, and places of those seen here to start in a smaller document, which are not sent.

    A row is a run of windows with one phrase, so there are as many rows as shared phrases at most; windows of frequent
    phrases are keyed one by one. Documents are taken in order of id and text, so that a task run again sends the same.
    """

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows or not told.num_rows:
            return _SENT.empty_table()
        docs = docs.filter(docs.column("doc_id").is_valid()).sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        who, known = told.column("doc_id").to_numpy(), told.column("hash").to_numpy().view(np.uint64)
        o = np.lexsort((known, who))
        who, known = who[o], known[o]
        out = [_SENT.empty_table()]
        for batch in docs.to_batches():
            for part in slices(batch, SLICE):
                ids = part.column("doc_id").to_numpy()
                words = Words(_texts(part))
                phrase = words.phrases()
                edge = np.searchsorted(words.doc, np.arange(len(ids) + 1))
                maybe = np.zeros(len(phrase), dtype=bool)
                for i, (s, e) in enumerate(zip(np.searchsorted(who, ids), np.searchsorted(who, ids, side="right"), strict=True)):
                    if s < e and edge[i] < edge[i + 1]:
                        p, k = _short(phrase[edge[i] : edge[i + 1]]), known[s:e]
                        maybe[edge[i] : edge[i + 1]] = k[np.minimum(np.searchsorted(k, p), len(k) - 1)] == p
                h, d, pos, key = words.hashes()[maybe], ids[words.doc[maybe]], words.pos[maybe], phrase[maybe]
                sent, places = _places(h, d, pos)
                out.append(pa.table([pa.array(places[0]), *[pa.array(c, f.type) for c, f in zip(places, _PLACE, strict=True)], pa.nulls(len(places[0]), _SENT.field("hashes").type)], schema=_SENT))
                sent = np.sort(sent)
                h, d, pos, key = h[sent], d[sent], pos[sent], key[sent]
                if len(frequent) and len(key):
                    own = frequent[np.minimum(np.searchsorted(frequent, _short(key)), len(frequent) - 1)] == _short(key)
                    key = np.where(own, h, key)
                new = _edges(key, d)
                new[1:] |= pos[1:] != pos[:-1] + 1
                at = np.flatnonzero(new)
                runs = pa.ListArray.from_arrays(pa.array(np.append(at, len(h)), pa.int32()), pa.array(h.view(np.int64)))
                none = [pa.nulls(len(at), f.type) for f in list(_PLACE)[2:]]
                out.append(pa.table([pa.array(key[at].view(np.int64)), pa.array(d[at]), pa.array(pos[at], pa.int32()), *none, runs], schema=_SENT))
        return pa.concat_tables(out)

    told = shared.select("doc_id", "hash", _shard("doc_id", held.n_shards).alias("told_shard"))
    return held.docs.groupBy("shard").cogroup(told.groupBy("told_shard")).applyInArrow(run, _SENT_DDL)


def _columns(table: pa.Table) -> tuple[np.ndarray, ...]:
    return tuple(table.column(f.name).to_numpy().astype(np.int64) for f in _PLACE)


def earlier_places(held: Held, shared: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Places of all windows that start in a smaller document too, the smallest that was seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=_SENT)
        yield from table.filter(table.column("hashes").is_null()).select(_PLACE.names).to_batches()
        w = table.filter(table.column("hashes").is_valid()).combine_chunks()
        if not w.num_rows:
            return
        runs = w.column("hashes").combine_chunks()
        size = runs.value_lengths().to_numpy().astype(np.int64)
        h = runs.flatten().to_numpy().view(np.uint64)
        step = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
        _, places = _places(h, np.repeat(w.column("doc_id").to_numpy(), size), np.repeat(w.column("pos").to_numpy().astype(np.int64), size) + step)
        yield from pa.table([pa.array(c, f.type) for c, f in zip(places, _PLACE, strict=True)], schema=_PLACE).to_batches(max_chunksize=100_000)

    return _try_windows(held, shared, frequent).repartition("key").mapInArrow(run, _PLACE_DDL)


def wanted(places: DataFrame, n_shards: int) -> DataFrame:
    """(source_shard, source, start, n, to): passages of ``n`` words that shard ``to`` needs from document ``source``, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("to", pa.int32()), *_PLACE]))
        if not table.num_rows:
            return
        d, _, n, source, start = _joined_places(_columns(table))
        who, at = np.unique(table.column("doc_id").to_numpy(), return_index=True)
        to = table.column("to").to_numpy()[at][np.searchsorted(who, d)]
        found = np.unique(np.column_stack([source, start, n + WINDOW - 1, to]), axis=0)
        names = pa.schema([("source", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("to", pa.int32())])
        yield from pa.table([pa.array(found[:, i], f.type) for i, f in enumerate(names)], schema=names).to_batches(max_chunksize=100_000)

    by_shard = places.select(_shard("doc_id", n_shards).alias("to"), *_PLACE.names).repartition("to")
    return by_shard.mapInArrow(run, "source bigint, start int, n int, to int").select(_shard("source", n_shards).alias("source_shard"), "source", "start", "n", "to")


def _shard(column: str, n: int):
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def passages(held: DataFrame, requests: DataFrame) -> DataFrame:
    """(passage_shard, source, words): the words asked for, from the texts that have them. Words are joined by single spaces.

    A passage that many shards want is read out once; its words meet the shards that want it in a join.
    """

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        want = defaultdict(list)
        for s, start, n in zip(*(asked.column(c).to_pylist() for c in ("source", "start", "n")), strict=True):
            want[s].append((start, n))
        out = []
        for doc_id, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True) if want else ():
            if doc_id in want:
                words = (text or "").encode().split()
                out += [(doc_id, start, n, b" ".join(words[start : start + n]).decode()) for start, n in want[doc_id] if start + n <= len(words)]
        source, start, n, words = zip(*out, strict=True) if out else ((),) * 4
        return pa.table({"source": pa.array(source, pa.int64()), "start": pa.array(start, pa.int32()), "n": pa.array(n, pa.int32()), "words": pa.array(words, pa.string())})

    asked = requests.select("source_shard", "source", "start", "n").distinct()
    read = held.groupBy("shard").cogroup(asked.groupBy("source_shard")).applyInArrow(run, "source bigint, start int, n int, words string")
    return requests.select("source", "start", "n", F.col("to").alias("passage_shard")).join(read, ["source", "start", "n"]).select("passage_shard", "source", "words")


def covered(docs: list[tuple[int, list[bytes]]], phrases: dict[tuple[bytes, ...], int]) -> Iterator[np.ndarray]:
    """For each (id, words), which words lie under a phrase whose source id is smaller; ``phrases`` maps words to their smallest source."""
    numbers: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    sizes, sources = [], []
    for words, source in phrases.items():
        automaton.add_word(tuple(numbers.setdefault(w, len(numbers) + 1) for w in words), len(sizes))
        sizes.append(len(words))
        sources.append(source)
    if sizes:
        automaton.make_automaton()
    for doc_id, words in docs:
        change = np.zeros(len(words) + 1, dtype=np.int64)
        if sizes and words and doc_id is not None:
            for end, k in automaton.iter(tuple(numbers.get(w, 0) for w in words)):
                if sources[k] < doc_id:
                    change[end + 1 - sizes[k]] += 1
                    change[end + 1] -= 1
        yield np.cumsum(change[:-1]) > 0


def _locate(docs: pa.Table, found: pa.Table, emit, schema: pa.Schema) -> pa.Table:
    phrases: dict[tuple[bytes, ...], int] = {}
    for source, text in zip(found.column("source").to_pylist(), found.column("words").to_pylist(), strict=True):
        key = tuple(text.encode().split())
        phrases[key] = min(source, phrases.get(key, source))
    ids, texts = docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()
    split = [(t or "").encode().split() for t in texts]
    rows = [r for x in zip(ids, texts, split, covered(list(zip(ids, split, strict=True)), phrases), strict=True) if (r := emit(*x))]
    return pa.table({f.name: pa.array(c, f.type) for f, c in zip(schema, zip(*rows, strict=True) if rows else [()] * len(schema), strict=True)}, schema=schema)


@dataclass
class Held:
    """Documents by shard; a row without an id goes by its text, so that such rows are spread."""

    docs: DataFrame
    n_shards: int


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id as a long, text), and for ids that aren't whole numbers (_no, _own): the numbers they got, in their order."""
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    ids = docs.select(F.col("doc_id").alias("_own")).where("_own is not null").distinct()
    ordered = ids.repartitionByRange(shuffle_partitions(docs.sparkSession), "_own").sortWithinPartitions("_own")
    numbers = materialize(ordered.withColumn("_no", F.monotonically_increasing_id()))
    rows = docs.select(F.col("doc_id").alias("_own"), "text").join(numbers, "_own", "left")
    return rows.select(F.col("_no").alias("doc_id"), "text"), numbers


def _found(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents by shard, passages by the shard that may hold them)."""
    spark = docs.sparkSession
    n = 4 * shuffle_partitions(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(n, int(size // SHARD) + 1)
    shard = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(n_shards)).cast("int")
    held = Held(docs.select(shard.alias("shard"), "doc_id", "text"), n_shards)
    shared = materialize(shared_phrases(docs, n))
    places = earlier_places(held, shared, frequent_phrases(shared))
    return held.docs, passages(held.docs, wanted(places, n_shards))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    docs, numbers = _numbered(docs)
    held, found = _found(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def emit(doc_id, _, words, gone):
        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
        return doc_id, len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        return _locate(docs, found, emit, schema)

    judged = held.groupBy("shard").cogroup(found.groupBy("passage_shard")).applyInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    if numbers is None:
        return judged
    return judged.join(numbers, judged["doc_id"] == numbers["_no"], "left").select(F.col("_own").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def cut_text(text: str, gone: np.ndarray) -> str:
    """``text`` without the words marked in ``gone``: a word goes with the white space before it, or after it at the start; what stays is unchanged."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    edge = np.diff(np.concatenate([[True], _IS_SPACE[data], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    keep = np.ones(len(data), dtype=bool)
    for i in np.flatnonzero(gone):
        keep[(ends[i - 1] if i else 0) : ends[i]] = False
    return data[keep].tobytes().decode().lstrip(" \t\n\x0b\x0c\r") if len(gone) and gone[0] else data[keep].tobytes().decode()


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text``; all rows and columns stay. Rows of one id and text are cut alike."""
    rows, numbers = _numbered(docs)
    held, found = _found(rows)
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.string()), ("text", pa.string())])

    def emit(doc_id, text, _, gone):
        if not gone.any():
            return None
        return doc_id, hashlib.sha256(text.encode()).hexdigest(), cut_text(text, gone)

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        return _locate(docs, found, emit, schema)

    judged = held.groupBy("shard").cogroup(found.groupBy("passage_shard")).applyInArrow(run, "doc_id bigint, hash string, text string")
    if numbers is not None:
        judged = judged.join(numbers, judged["doc_id"] == numbers["_no"]).select(F.col("_own").alias("doc_id"), "hash", "text")
    id_, hash_, cut_ = (unused(n, docs) for n in ("_id", "_hash", "_cut"))
    cuts = materialize(judged.select(F.col("doc_id").alias(id_), F.col("hash").alias(hash_), F.col("text").alias(cut_)).dropDuplicates([id_, hash_]))
    joined = docs.join(cuts, (docs["doc_id"] == F.col(id_)) & (F.sha2(docs["text"], 256) == F.col(hash_)), "left")
    return joined.withColumn("text", F.coalesce(cut_, docs["text"])).select(*docs.columns)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
