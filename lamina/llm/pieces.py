"""SentencePiece encoding and decoding by a max-plus scan.

A text is encoded as the pieces of a model whose scores sum highest (of equal sums, the longest piece before each edge,
from the end on). Code points without a piece become byte pieces, at ten below the lowest score. A space goes before
the text and spaces are written as the model's mark, so decoding gives a text back exactly unless it holds that mark
itself, which becomes a space. Scores are held as integers (1/1024), so sums are exact in any order.

A model made for merges gives no log-probabilities: its scores are whole numbers that only rank its pieces, and their sums
mean nothing. The piece of rank r is then given -log(r + RANK_SHIFT), as Zipf's law (with Mandelbrot's shift) has it for the
r-th most frequent one. Models with scores of other kinds are taken as they are.

Giant texts are cut into chunks. A chunk's state at its start is how far into it the first piece edge lies. Its transfer
matrix holds, for every state at its start and every state at its end, the best score between. Matrices combine
associatively (max-plus products), which gives every chunk the scores of its start states; each chunk then finds which
start state each end state comes from, and, once the end states are picked from last to first, traces its own pieces.

Null and empty texts have no pieces. Every input row gives one row, repeated ids and rows included; an empty table gives
none; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, materialize, read_table, shuffle_partitions, slices

CHUNK, BLOCK = 32_768, 64
SLICE = 1 << 19
NEG = -(1 << 62)
MARK = "▁"
#: Pre-tokens whose pieces a worker remembers: so many of late, and as many from before.
HELD = 150_000
#: Of 1 to 5,000, the shift by which most words of the small table get the merges' own pieces (82 %; 65 % at 1).
RANK_SHIFT = 200
#: Bits of a piece's hash by which most that is no piece is told without a search.
TOP = 17
#: Stretches up to this length are solved side by side.
SHORT = 32

_UNIT = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.multiply.accumulate(np.full(65, _BASE, dtype=np.uint64)) * np.uint64(pow(int(_BASE), -1, 1 << 64))
_lattices: dict[str, Lattice] = {}


class Lattice:
    """Pieces of a model as a lattice over text."""

    def __init__(self, scores: dict[str, tuple[int, int]], byte_ids: list[int], names: list[str]):
        self.pieces, self.byte_ids, self.names = scores, byte_ids, names
        self.longest = max(map(len, scores))
        self.unknown = min(s for _, s in scores.values()) - 10 * 1024
        #: No piece has a newline, or a mark after anything else: then every path has an edge there.
        self.edges = not any("\n" in p or MARK in p.lstrip(MARK) for p in scores)
        self.single = {p for p in scores if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, (_, score) in scores.items():
            self.automaton.add_word(p, (len(p), score))
        self.automaton.make_automaton()
        #: Text of each id; a byte piece under 0x80 is its character wherever it stands.
        self.text = [chr(byte_ids.index(i)) if i in byte_ids[:128] else n for i, n in enumerate(names)]
        self.high = {i: b for b, i in enumerate(byte_ids) if b >= 128}
        self.memo: dict[str, tuple[bytes, int]] = {}
        self.older: dict[str, tuple[bytes, int]] = {}
        self.tables = None

    @classmethod
    def load(cls, path: str) -> Lattice:
        if path not in _lattices:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            n = sp.get_piece_size()
            names = [sp.id_to_piece(i) for i in range(n)]
            plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
            raw = [sp.get_score(i) for i in plain]
            if all(float(s).is_integer() for s in raw):
                for r, k in enumerate(sorted(range(len(raw)), key=lambda k: -raw[k])):
                    raw[k] = -math.log(RANK_SHIFT + r)
            scores = {names[i]: (i, max(round(s * 1024), -(1 << 30))) for i, s in zip(plain, raw, strict=True)}
            _lattices[path] = cls(scores, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], names)
        return _lattices[path]

    def forward(self, t: str, best: list[int], core: int) -> tuple[list[int], list[int]]:
        """Best score of a path to each place of ``t`` and where its last piece starts (-1: it was there at entry).

        ``best`` has the scores at entry; pieces start before ``core`` only. The automaton names the pieces at each
        place by their end, the longest first, which is the order that settles ties.
        """
        back = [-1] * (len(t) + 1)
        found = self.automaton.iter(t)
        if not self.single.issuperset(t):
            alone = [(i, (1, self.unknown)) for i, c in enumerate(t) if c not in self.single]
            found = sorted([*found, *alone], key=lambda m: (m[0], -m[1][0]))
        for i, (n, score) in found:
            s = i + 1 - n
            if s < core and best[s] > NEG and best[s] + score > best[i + 1]:
                best[i + 1], back[i + 1] = best[s] + score, s
        return best, back

    def ids_between(self, t: str, back: list[int], e: int) -> tuple[list[int], int]:
        """Ids on the path that ends at ``e``, and its first place."""
        parts = []
        while back[e] >= 0:
            s = back[e]
            p = self.pieces.get(t[s:e])
            parts.append([p[0]] if p else [self.byte_ids[b] for b in t[s:e].encode()])
            e = s
        return [i for p in reversed(parts) for i in p], e

    def unit(self, t: str) -> tuple[bytes, int]:
        """Ids (little-endian, 32 bits) and score of a stretch with edges at both ends."""
        if (found := self.memo.get(t)) is None:
            best, back = self.forward(t, [0] + [NEG] * len(t), len(t))
            found = np.array(self.ids_between(t, back, len(t))[0], dtype="<u4").tobytes(), best[len(t)]
            if len(self.memo) < HELD and len(t) <= CHUNK:
                self.memo[t] = found
        return found

    def _tables(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length: hashes of its pieces in order, their scores and ids, and which top bits some hash has."""
        if self.tables is None:
            self.tables = [(np.empty(0, np.uint64),) * 4]
            for n in range(1, self.longest + 1):
                own = [(p, *v) for p, v in self.pieces.items() if len(p) == n]
                chars = np.frombuffer("".join([p for p, *_ in own]).encode("utf-32-le"), dtype="<u4").reshape(len(own), n).astype(np.uint64)
                h = np.zeros(len(own), dtype=np.uint64)
                for i in range(n):
                    h = h * _BASE + chars[:, i] + np.uint64(1)
                o = np.argsort(h)
                some = np.zeros(1 << TOP, dtype=bool)
                some[h >> np.uint64(64 - TOP)] = True
                self.tables.append((h[o], np.array([s for *_, s in own], dtype=np.int64)[o], np.array([i for _, i, _ in own], dtype=np.uint32)[o], some))
        return self.tables

    def learn(self, units: list[str]) -> None:
        """Remember the best paths of many short stretches, all of whose characters are pieces, found side by side.

        It is the same recursion as :meth:`forward`, one place and piece length at a time over all stretches. Pieces
        are looked up by hash; a path whose pieces don't spell the stretch is left to :meth:`unit`.
        """
        units = sorted(units, key=len, reverse=True)
        lengths = np.array([len(u) for u in units])
        width = int(lengths[0])
        chars = np.frombuffer("".join([u.ljust(width, "\0") for u in units]).encode("utf-32-le"), dtype="<u4").reshape(len(units), width)
        prefix = np.zeros((width + 1, len(units)), dtype=np.uint64)
        for e in range(width):
            prefix[e + 1] = prefix[e] * _BASE + chars[:, e] + np.uint64(1)
        best = np.full((width + 1, len(units)), NEG, dtype=np.int64)
        best[0] = 0
        step, ident = np.zeros((width + 1, len(units)), dtype=np.int8), np.zeros((width + 1, len(units)), dtype=np.uint32)
        tables = self._tables()
        for e in range(1, width + 1):
            n = int(np.searchsorted(-lengths, -e, side="right"))  # stretches that reach this place
            for k in range(min(e, self.longest), 0, -1):
                known, score, ids, some = tables[k]
                if not len(known):
                    continue
                h = prefix[e, :n] - prefix[e - k, :n] * _POWERS[k]
                hit = np.flatnonzero(some[h >> np.uint64(64 - TOP)])
                if not len(hit):
                    continue
                h = h[hit]
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                right = known[at] == h
                hit, at = hit[right], at[right]
                total = best[e - k, hit] + score[at]
                up = total > best[e, hit]
                hit = hit[up]
                best[e, hit], step[e, hit], ident[e, hit] = total[up], k, ids[at[up]]
        rows, place, trail = np.arange(len(units)), lengths.copy(), []
        while len(rows):
            trail.append((rows, ident[place, rows]))
            place = place - step[place, rows]
            rows, place = rows[place > 0], place[place > 0]
        owner = np.concatenate([r for r, _ in trail])
        ids = np.concatenate([i for _, i in trail])
        order = np.lexsort((-np.arange(len(owner)), owner))
        flat = ids[order].astype("<u4")
        ends = np.cumsum(np.bincount(owner, minlength=len(units)))
        raw, text, top = flat.tobytes(), [self.names[i] for i in flat.tolist()], best[lengths, np.arange(len(units))].tolist()
        start = 0
        for u, e, s in zip(units, ends.tolist(), top, strict=True):
            if "".join(text[start:e]) == u:
                self.memo[u] = raw[4 * start : 4 * e], s
            start = e

    def units(self, t: str) -> list[str]:
        if not self.edges:
            return [t] if t else []
        if MARK * 2 in t or "\0" in t:
            return _UNIT.findall(t)
        return [u for u in t.replace(MARK, "\0" + MARK).replace("\n", "\0\n\0").split("\0") if u]

    def know(self, split: list[list[str]]) -> None:
        """Learn the short stretches among ``split`` that are not remembered. Those met again move from the older half to the newer."""
        met: set[str] = set().union(*split)
        new = met.difference(self.memo)
        if len(self.memo) + len(new) > HELD:
            self.memo, self.older, new = {}, self.memo, met
        memo, older, single = self.memo, self.older, self.single
        short = []
        for u in new:
            if u in older:
                memo[u] = older[u]
            elif len(u) <= SHORT and single.issuperset(u):
                short.append(u)
        if short:
            self.learn(short)

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, int]]:
        """Ids and score of whole texts."""
        split = [self.units(marked(t)) for t in texts]
        self.know(split)
        out = []
        for units in split:
            out.append(self.solved(units))
        return out

    def solved(self, units: list[str]) -> tuple[bytes, int]:
        """Ids and score of stretches one after the other."""
        if not units:
            return b"", 0
        found = list(map(self.memo.get, units))
        if None in found:
            found = [self.unit(u) for u in units]
        ids, scores = zip(*found, strict=True)
        return b"".join(ids), sum(scores)

    def encode(self, text: str) -> tuple[bytes, int]:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        names, ids = self.text, ids.tolist()
        if self.high.keys().isdisjoint(ids):
            text = "".join([names[i] for i in ids])
        else:
            raw = b"".join([bytes([self.high[i]]) if i in self.high else names[i].encode() for i in ids])
            text = raw.decode(errors="replace")
        text = text.replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def marked(text: str) -> str:
    return (MARK + text.replace(" ", MARK)) if text else ""


class Chunk:
    """A chunk of a giant text: ``core`` characters of ``t``, and what follows as far as a piece may reach."""

    def __init__(self, lattice: Lattice, t: str, core: int, found: tuple[int, int] | None = None):
        """``found`` are the first and last edge within the chunk where they are known already (-1: it has none)."""
        self.lattice, self.t, self.core = lattice, t, core
        self.states = lattice.longest
        self.first = self.last = None
        if found is not None:
            if found[0] >= 0:
                self.first, self.last = found
        elif lattice.edges:
            ends = np.cumsum([len(u) for u in lattice.units(t)])
            inner = ends[(ends > 0) & (ends < core)]
            if len(inner):
                self.first, self.last = int(inner[0]), int(inner[-1])

    def _entry(self, start: np.ndarray, n: int) -> list[int]:
        best = [NEG] * (n + 1)
        for i, s in enumerate(start[: n + 1].tolist()):
            best[i] = s
        return best

    def _exits(self, best: list[int], at: int) -> np.ndarray:
        out = np.full(self.states, NEG, dtype=np.int64)
        tail = best[self.core - at : self.core - at + self.states]
        out[: len(tail)] = tail
        return out

    def middle(self) -> tuple[bytes, int]:
        """Ids and score between the first and the last edge, the same for all states."""
        if self.first is None:
            return b"", 0
        units = self.lattice.units(self.t[self.first : self.last])
        self.lattice.know([units])
        return self.lattice.solved(units)

    def matrix(self, middle: int | None = None) -> np.ndarray:
        """Best score from each state at the start to each at the end; ``middle`` is the score of :meth:`middle`."""
        n, lat = self.states, self.lattice
        out = np.full((n, n), NEG, dtype=np.int64)
        one = np.full((n, n), NEG, dtype=np.int64)
        np.fill_diagonal(one, 0)
        if self.first is None:
            for i in range(min(n, self.core)):
                out[i] = self._exits(lat.forward(self.t, self._entry(one[i], len(self.t)), self.core)[0], 0)
            return out
        head = self.t[: self.first]
        middle = self.middle()[1] if middle is None else middle
        tail = self.t[self.last :]
        exits = self._exits(lat.forward(tail, [0] + [NEG] * len(tail), self.core - self.last)[0], self.last)
        for i in range(min(n, self.first + 1)):
            reach = lat.forward(head, self._entry(one[i], len(head)), len(head))[0][len(head)]
            if reach > NEG:
                out[i] = np.where(exits > NEG, exits + reach + middle, NEG)
        return out

    def trace(self, start: np.ndarray) -> Trace:
        return Trace(self, start)


class Trace:
    """A chunk whose scores at the start states are known."""

    def __init__(self, chunk: Chunk, start: np.ndarray):
        self.c, lat = chunk, chunk.lattice
        if chunk.first is None:
            self.tail, self.shift = chunk.t, 0
            _, self.back = lat.forward(self.tail, chunk._entry(start, len(self.tail)), chunk.core)
        else:
            head = chunk.t[: chunk.first]
            _, back = lat.forward(head, chunk._entry(start, len(head)), len(head))
            self.head, self.entry = lat.ids_between(head, back, len(head))
            self.tail, self.shift = chunk.t[chunk.last :], chunk.last
            _, self.back = lat.forward(self.tail, [0] + [NEG] * len(self.tail), chunk.core - chunk.last)

    def _to(self, state: int) -> tuple[list[int], int]:
        return self.c.lattice.ids_between(self.tail, self.back, self.c.core - self.shift + state)

    def origins(self) -> np.ndarray:
        """The start state that each end state comes from."""
        n = self.c.states
        out = np.zeros(n, dtype=np.int8)
        for j in range(min(n, len(self.tail) - (self.c.core - self.shift) + 1)):
            out[j] = self._to(j)[1] if self.c.first is None else self.entry
        return out

    def ids(self, state: int, middle: bytes | None = None) -> bytes:
        tail = np.array(self._to(state)[0], dtype="<u4").tobytes()
        if self.c.first is None:
            return tail
        return np.array(self.head, dtype="<u4").tobytes() + (self.c.middle()[0] if middle is None else middle) + tail


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return np.maximum((a[:, :, None] + np.maximum(b, NEG // 2)[None, :, :]).max(axis=1), NEG)


def follow(start: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores at a chunk's end states from those at its start states."""
    return combine(np.maximum(start, NEG // 2)[None, :], m)[0]


def chunks_of(t: str, longest: int, size: int) -> Iterator[tuple[str, int]]:
    """(chunk with what follows it, its own length); no chunk is shorter than a piece can be."""
    size = max(size, longest + 1)
    cuts = list(range(0, len(t), size))
    if len(cuts) > 1 and len(t) - cuts[-1] <= longest:
        cuts.pop()
    for s, e in zip(cuts, [*cuts[1:], len(t)], strict=True):
        yield t[s : min(len(t), e + longest - 1)], e - s


def _matrix_of(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="<i8").reshape(-1, n)


def encode_documents(docs: DataFrame, model_path: str, chunk: int = CHUNK, block: int = BLOCK, check: bool = False) -> DataFrame:
    """(doc_id, ids, score, text) of every row; ids are little-endian unsigned 32-bit.

    With ``check`` the ids are decoded where they were made, and ``round_trip`` (the text came back, marks as spaces)
    stands in place of the text, so that texts don't travel twice.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice.load(model_path)
        for b in batches:
            schema = pa.schema([("doc_id", b.schema.field("doc_id").type), ("ids", pa.binary()), ("score", pa.int64()), ("round_trip", pa.bool_()) if check else ("text", pa.string())])
            for part in slices(b, SLICE):
                texts = part.column("text").to_pylist()
                found = lattice.encode_all(texts)
                last = {"round_trip": [lattice.decode(np.frombuffer(i, dtype="<u4")) == t.replace(MARK, " ") for t, (i, _) in zip(texts, found, strict=True)]} if check else {"text": texts}
                yield batch_of(schema, doc_id=part.column("doc_id"), ids=[i for i, _ in found], score=[s for _, s in found], **last)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice.load(model_path)
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            schema = pa.schema([("doc_id", b.schema.field("doc_id").type), ("uid", pa.int64()), ("k", pa.int32()), ("core", pa.int32()), ("part", pa.string())])
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                uid += 1
                rows = [(doc_id, uid, k, core, part) for k, (part, core) in enumerate(chunks_of(marked(text), lattice.longest, chunk))]
                yield batch_of(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    giant = F.length("text") > chunk
    short = docs.where(~giant).mapInArrow(whole, f"doc_id {id_type}, ids binary, score bigint, " + ("round_trip boolean" if check else "text string"))
    chunks = materialize(docs.where(giant).mapInArrow(parts, f"doc_id {id_type}, uid bigint, k int, core int, part string"))
    whole_ones = _scan(chunks, model_path, block)
    if check:
        whole_ones = decode_documents(whole_ones, model_path).select("doc_id", "ids", "score", (F.col("decoded") == F.translate("text", MARK, " ")).alias("round_trip"))
    return short.union(whole_ones)


def _scan(chunks: DataFrame, model_path: str, block: int) -> DataFrame:
    """The giant documents of ``chunks`` (doc_id, uid, k, core, part), each encoded whole."""

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice.load(model_path)
        schema = pa.schema([("uid", pa.int64()), ("k", pa.int32()), ("m", pa.binary()), ("first", pa.int32()), ("last", pa.int32()), ("middle", pa.binary())])
        for whole in batches:
            for b in slices(whole, SLICE, "part"):
                rows = []
                for t, n in zip(b.column("part").to_pylist(), b.column("core").to_pylist(), strict=True):
                    c = Chunk(lattice, t, n)
                    ids, score = c.middle()
                    rows.append((c.matrix(score).astype("<i8").tobytes(), *((-1, -1) if c.first is None else (c.first, c.last)), ids))
                yield batch_of(schema, uid=b.column("uid"), k=b.column("k"), **dict(zip(schema.names[2:], zip(*rows, strict=True), strict=True)))

    def product(table: pa.Table) -> pa.Table:
        n = Lattice.load(model_path).longest
        rows = sorted(zip(table.column("k").to_pylist(), table.column("m").to_pylist(), strict=True))
        m = _matrix_of(rows[0][1], n)
        for _, raw in rows[1:]:
            m = combine(m, _matrix_of(raw, n))
        return pa.table({"uid": table.column("uid")[:1], "block": table.column("block")[:1], "m": pa.array([m.astype("<i8").tobytes()], pa.binary())})

    def enter_blocks(table: pa.Table) -> pa.Table:
        """Scores at the start of each block of a document: one small matrix for so many chunks is all that comes together."""
        n = Lattice.load(model_path).longest
        rows = sorted(zip(table.column("block").to_pylist(), table.column("m").to_pylist(), strict=True))
        at = np.full(n, NEG, dtype=np.int64)
        at[0] = 0
        out = []
        for _, raw in rows:
            out.append(at.astype("<i8").tobytes())
            at = follow(at, _matrix_of(raw, n))
        return pa.table({"uid": pa.array([table.column("uid")[0].as_py()] * len(rows), pa.int64()), "block": pa.array([k for k, _ in rows], pa.int32()), "at": pa.array(out, pa.binary())})

    def enter_chunks(table: pa.Table, blocks: pa.Table) -> pa.Table:
        n = Lattice.load(model_path).longest
        rows = sorted(zip(table.column("k").to_pylist(), table.column("m").to_pylist(), strict=True))
        at = np.frombuffer(blocks.column("at")[0].as_py(), dtype="<i8") if rows else None
        out, ends = [], []
        for _, raw in rows:
            out.append(at.astype("<i8").tobytes())
            at = follow(at, _matrix_of(raw, n))
            ends.append(int(at[0]))
        uid = table.column("uid")[0].as_py() if rows else None
        return pa.table({"uid": pa.array([uid] * len(rows), pa.int64()), "k": pa.array([k for k, _ in rows], pa.int32()), "at": pa.array(out, pa.binary()), "score": pa.array(ends, pa.int64())})

    def trace_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice.load(model_path)
        for b in batches:
            out = []
            for t, n, at, *found in zip(*(b.column(c).to_pylist() for c in ("part", "core", "at", "first", "last")), strict=True):
                out.append(Chunk(lattice, t, n, found).trace(np.frombuffer(at, dtype="<i8")).origins().tobytes())
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("k"), pa.array(out, pa.binary())], names=["uid", "k", "origins"])

    def pick(table: pa.Table) -> pa.Table:
        """End states from the last chunk to the first: a few bytes for each chunk of one document."""
        rows = sorted(zip(table.column("k").to_pylist(), table.column("origins").to_pylist(), strict=True), reverse=True)
        state, out = 0, []
        for k, raw in rows:
            out.append((k, state))
            state = int(np.frombuffer(raw, dtype=np.int8)[state])
        return pa.table({"uid": pa.array([table.column("uid")[0].as_py()] * len(out), pa.int64()), "k": pa.array([k for k, _ in out], pa.int32()), "state": pa.array([s for _, s in out], pa.int32())})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice.load(model_path)
        for b in batches:
            ids, own = [], []
            for t, n, at, state, middle, *found in zip(*(b.column(c).to_pylist() for c in ("part", "core", "at", "state", "middle", "first", "last")), strict=True):
                ids.append(Chunk(lattice, t, n, found).trace(np.frombuffer(at, dtype="<i8")).ids(state, middle))
                own.append(t[:n])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("uid"), b.column("k"), pa.array(ids, pa.binary()), pa.array(own, pa.string()), b.column("score")], names=["doc_id", "uid", "k", "ids", "own", "score"])

    id_type = chunks.schema["doc_id"].dataType.simpleString()
    # Chunks take time by their number, not by their bytes on disk: they are dealt by number to a fixed count of tasks.
    dealt = chunks.select("uid", "k", "core", "part").repartition(shuffle_partitions(chunks.sparkSession), "uid", "k")
    solved = materialize(dealt.mapInArrow(transfer, "uid bigint, k int, m binary, first int, last int, middle binary").withColumn("block", F.floor(F.col("k") / block).cast("int")))
    m = solved.select("uid", "k", "block", "m")
    blocks = m.groupBy("uid", "block").applyInArrow(product, "uid bigint, block int, m binary").groupBy("uid").applyInArrow(enter_blocks, "uid bigint, block int, at binary")
    entered = materialize(m.groupBy("uid", "block").cogroup(blocks.groupBy("uid", "block")).applyInArrow(enter_chunks, "uid bigint, k int, at binary, score bigint"))
    with_scores = chunks.join(solved.select("uid", "k", "first", "last", "middle"), ["uid", "k"]).join(entered, ["uid", "k"])
    states = with_scores.select("uid", "k", "core", "part", "at", "first", "last").mapInArrow(trace_back, "uid bigint, k int, origins binary").groupBy("uid").applyInArrow(pick, "uid bigint, k int, state int")
    written = with_scores.join(states, ["uid", "k"]).select("doc_id", "uid", "k", "core", "part", "at", "score", "state", "first", "last", "middle").mapInArrow(write, f"doc_id {id_type}, uid bigint, k int, ids binary, own string, score bigint")
    parts = F.array_sort(F.collect_list(F.struct("k", "ids", "own")))
    whole = written.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), parts.alias("parts"), F.max_by("score", "k").alias("score"))
    ids = F.aggregate(F.col("parts.ids"), F.lit(b""), lambda a, x: F.concat(a, x))
    return whole.select("doc_id", ids.alias("ids"), "score", F.translate(F.substring(F.array_join("parts.own", ""), 2, (1 << 31) - 1), MARK, " ").alias("text"))


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` with a column ``decoded``."""
    schema = T.StructType([*encoded.schema, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice.load(model_path)
        for batch in batches:
            for b in slices(batch, SLICE, "ids"):
                decoded = [lattice.decode(np.frombuffer(i, dtype="<u4")) for i in b.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(decoded, pa.string())], names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, score, round_trip): the whole text of every document encoded and decoded again."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    both = encode_documents(read_table(spark, sf_dir, "documents"), path, check=True)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), (F.col("score") / 1024).alias("score"), "round_trip")


QUERIES = {"op8_sentencepiece": op8_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
