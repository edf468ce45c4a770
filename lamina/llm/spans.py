"""Words of Arrow texts as spans of bytes: a byte transducer finds them, prefix sums hash them, a hash table groups them exactly.

Everything is numpy over chunks of about ``LIMIT`` bytes. A text longer than that comes in parts cut after a separator;
each part may start with some words of the part before, marked as not fresh. A single word is never cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
LIMIT = 1 << 21

#: What a byte is to the transducer: the first two kinds end words.
SPACE, BREAK, PLAIN, CAPITAL, SYMBOL, CONTINUATION = range(6)
#: State after a byte of each kind: 0 outside a word, 1 inside.
NEXT = np.array([0, 0, 1, 1, 1, 1], dtype=np.uint8)
#: Output of (state, kind): 1 a word starts here, 2 the word before this byte has ended.
OUTPUT = np.array([[0, 0, 1, 1, 1, 1], [2, 2, 0, 0, 0, 0]], dtype=np.uint8)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_kinds(spaces: bytes = b" \t\n\x0b\x0c\r", breaks: bytes = b"", symbols: bytes = b"") -> np.ndarray:
    """Kind of each of the 256 bytes."""
    kinds = np.full(256, PLAIN, dtype=np.uint8)
    kinds[65:91], kinds[128:192] = CAPITAL, CONTINUATION
    for some, kind in ((symbols, SYMBOL), (spaces, SPACE), (breaks, BREAK)):
        kinds[list(some)] = kind
    return kinds


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64 bits of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BASE = 0xD1342543DE82EF95
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0..n modulo 2**64, kept between calls."""
    if len(_powers.get(base, ())) <= n:
        p = np.full(max(n, LIMIT) + 1, base, dtype=np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p, dtype=np.uint64)
    return _powers[base]


@dataclass
class Words:
    """Words of one chunk. ``data`` has eight spare bytes at its end, so that any word can be read eight bytes at a time."""

    data: np.ndarray
    kinds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray  # of the batch, for each word
    fresh: np.ndarray  # False for words that the part before had already
    texts: np.ndarray  # rows of the batch whose bytes are here, in order
    bounds: np.ndarray  # where each of them starts, then the end
    new: int  # the first byte that no part before had

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes, the same wherever it stands."""
        n = len(self.kinds)
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        up, down = _power(_BASE, n), _power(pow(_BASE, -1, 1 << 64), n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.data[:n]] * up[:n], out=sums[1:])
        return _mixed((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64) * _STEP)

    def texts_at(self, at: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[s:e] for s, e in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)]


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as numbers; a view."""
    return np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
#: Longer spans are compared one by one.
_LONG = 512


def same_bytes(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether ``length`` bytes of ``a`` and of ``b`` are equal, for each pair of positions; both need eight spare bytes at the end."""
    same = np.ones(len(length), dtype=bool)
    for i in np.flatnonzero(length > _LONG).tolist():
        same[i] = bool((a[at_a[i] : at_a[i] + length[i]] == b[at_b[i] : at_b[i] + length[i]]).all())
    x, y, left = _eights(a), _eights(b), np.flatnonzero(length <= _LONG)
    for k in range(0, _LONG, 8):
        left = left[length[left] > k]
        if not len(left):
            break
        mask = _MASK[np.minimum(length[left] - k, 8)]
        same[left] &= ((x[at_a[left] + k] ^ y[at_b[left] + k]) & mask) == 0
    return same


def insert(hashes: np.ndarray, equal: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Puts items into an open-addressing table; returns for each the first item equal to it.

    A round asks each waiting item's slot: an empty one takes the first that asks. ``equal`` (two arrays of item
    numbers) confirms the item that holds it, so colliding hashes only cost another round with the next slot.
    """
    n = len(hashes)
    bits = max(4, (2 * n).bit_length())
    table = np.full(1 << bits, -1, dtype=np.int64)
    slot = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    holder, waiting = np.empty(n, dtype=np.int64), np.arange(n)
    while len(waiting):
        s = slot[waiting]
        free = table[s] < 0
        table[s[free][::-1]] = waiting[free][::-1]
        at = table[s]
        found = at == waiting
        asked = np.flatnonzero(~found)
        asked = asked[hashes[waiting[asked]] == hashes[at[asked]]]
        found[asked] = equal(waiting[asked], at[asked])
        holder[waiting[found]] = at[found]
        waiting = waiting[~found]
        slot[waiting] = (slot[waiting] + 1) & ((1 << bits) - 1)
    return holder


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, null as empty, and where each text starts, then the end."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8), at


def _split(data: np.ndarray, kinds: np.ndarray, fold: bool, texts: np.ndarray, bounds: np.ndarray, new: int) -> Words:
    """One pass of the transducer. What it remembers of the past is the kind of the last byte, so its states are looked up for all bytes at once."""
    n = len(data)
    kind = kinds[data]
    state = np.zeros(n + 1, dtype=np.uint8)
    state[1:] = NEXT[kind]
    last = state[bounds[1:]].copy()
    state[bounds[:-1]] = 0  # each text starts outside a word
    out = OUTPUT[state[:-1], kind]
    start = np.flatnonzero(out == 1)
    row = np.searchsorted(bounds, start, "right") - 1
    ends = out == 2
    over = np.zeros(n + 1, dtype=bool)
    over[:-1] = ends
    over[bounds[1:][(last == 1) & (bounds[1:] > bounds[:-1])]] = True  # words that the end of a text ends
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = LOWER[data] if fold else data
    return Words(padded, kind, start, np.flatnonzero(over), texts[row] if len(start) else row, start >= new, texts, bounds, new)


def words(column: pa.Array, kinds: np.ndarray, fold: bool = False, context: int = 0, limit: int = LIMIT) -> Iterator[Words]:
    """Words of all texts of a column, chunk by chunk; ``fold`` lower-cases A-Z after the kinds are told.

    Parts of a long text start with the last ``context`` words before them, which are not fresh.
    """
    data, at = bytes_of(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        if at[j] - at[i] <= limit:
            yield _split(data[at[i] : at[j]], kinds, fold, np.arange(i, j), at[i : j + 1] - at[i], 0)
            i = j
            continue
        pos = begin = int(at[i])
        while pos < at[j]:
            cut = min(pos + limit, int(at[j]))
            if cut < at[j]:
                ends = np.flatnonzero(kinds[data[pos:cut]] <= BREAK)
                cut = pos + int(ends[-1]) + 1 if len(ends) else cut
                while not len(ends) and cut < at[j]:  # a word longer than the limit
                    far = min(cut + limit, int(at[j]))
                    ends = np.flatnonzero(kinds[data[cut:far]] <= BREAK)[:1]
                    cut = cut + int(ends[0]) + 1 if len(ends) else far
            w = _split(data[begin:cut], kinds, fold, np.arange(i, i + 1), np.array([0, cut - begin]), pos - begin)
            yield w
            kept = w.start[-context:] if context else w.start[:0]
            begin, pos = begin + int(kept[0]) if len(kept) else cut, cut
        i = j
