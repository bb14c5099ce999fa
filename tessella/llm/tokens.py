"""Words and word hashes of many texts at once, on the UTF-8 bytes of an Arrow column.

Texts are handled in chunks of about a megabyte, so memory does not follow the batch size; one
text longer than that is a chunk of its own. Words are runs of bytes that are not ASCII white
space, which is the same as on code points. A word's hash joins a polynomial mod 2^64 with one
modulo a prime, well mixed afterwards: the first alone gives long words of a certain structure
(Thue-Morse strings) the same value in whatever base.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U64 = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


class _Powers:
    """Powers of an odd number mod 2^64 and of its inverse, as many as have been needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            room = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                x = np.full(room, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers(_R)


class _PrimePowers:
    """The same modulo a prime below 2^31, so that products of two residues fit 64 bits."""

    def __init__(self, prime: int, base: int):
        self.prime, self.base = prime, {"up": base, "down": pow(base, -1, prime)}
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        for name, base in self.base.items():
            x = getattr(self, name)
            while len(x) < n:
                x = np.concatenate([x, x * U64(pow(base, len(x), self.prime)) % U64(self.prime)])
            setattr(self, name, x)
        return self.up[:n], self.down[:n]

    def values(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Residues of the byte ranges; bytes count from 1."""
        up, down = self.get(len(data))
        each = (data.astype(np.uint64) + U64(1)) * up  # below 2^39
        if len(each) > 1 << 24:
            each %= U64(self.prime)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
        return (total[end] - total[start]) % U64(self.prime) * down[start] % U64(self.prime)


_PRIME = _PrimePowers((1 << 31) - 1, 1_103_515_245)
_OTHER_PRIME = _PrimePowers((1 << 31) - 19, 1_812_433_253)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


@dataclass
class Words:
    """Words of the texts first..first+n of a batch: byte range, text and hash of each, and a second
    hash if it was asked for, which no residue of the first decides."""

    first: int
    n: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    second: np.ndarray | None = None

    def bounds(self) -> np.ndarray:
        """n + 1 offsets: where each text's words start in the word arrays."""
        return np.searchsorted(self.doc, np.arange(self.n + 1))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), o


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return _LOWER[data]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets from 0) of each chunk."""
    data, o = buffers(column)
    i, n = 0, len(o) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(o, o[i] + limit, side="right")) - 1)
        j = min(max(j, i + 1), n)
        yield i, data[o[i] : o[j]], o[i : j + 1] - o[i]
        i = j


def ranges(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function from byte ranges (start, end) to their hashes, which are still to be mixed."""
    up, down = _POWERS.get(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up, dtype=np.uint64)])
    padded = np.append(down, U64(0))
    return lambda start, end: (total[end] - total[start]) * padded[start] + (end - start).astype(np.uint64)


def words(first: int, data: np.ndarray, offsets: np.ndarray, lower: bool = False, second: bool = False) -> Words:
    n, docs = len(data), len(offsets) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return Words(first, docs, data, none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    inside = _NOT_SPACE[data]
    begins = offsets[:-1][offsets[:-1] < n]
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    head[begins] = inside[begins]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    tail[ends] = inside[ends]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    up, down = _POWERS.get(n)
    total = np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up, dtype=np.uint64)
    before = np.where(start > 0, total[start - 1], U64(0))
    value = (total[end - 1] - before) * down[start] + (end - start).astype(np.uint64)
    seen = _LOWER[data] if lower else data
    residue = _PRIME.values(seen, start, end)
    more = mix((residue << U64(31)) | _OTHER_PRIME.values(seen, start, end)) if second else None
    return Words(first, docs, data, start, end, np.searchsorted(offsets, start, side="right") - 1, mix(value + mix(residue)), more)


def windows(hashes: np.ndarray, doc: np.ndarray, size: int, base: int = _R) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of size words within one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    total = np.zeros(n, np.uint64)
    factor = 1
    for k in range(size):
        total += hashes[k : k + n] * U64(factor)
        factor = factor * base % (1 << 64)
    return at, mix(total[at])


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, hash) of all shingles. A text of fewer words has one: the whole of it."""
    at, value = windows(w.hash, w.doc, size)
    b = w.bounds()
    length = np.diff(b)
    short = np.flatnonzero((length > 0) & (length < size))
    if len(short):
        own = np.array([_whole(w.hash[b[d] : b[d + 1]]) for d in short], np.uint64)
        at, value = np.concatenate([at, b[short]]), np.concatenate([value, own])
        order = np.argsort(at, kind="stable")
        at, value = at[order], value[order]
    return w.doc[at], at, value


def _whole(hashes: np.ndarray) -> int:
    value = 0
    for k, h in enumerate(hashes.tolist()):
        value = (value + h * pow(_R, k, 1 << 64)) % (1 << 64)
    return int(mix(np.array([value ^ (len(hashes) << 56)], np.uint64))[0])


def distinct(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text, hash) pairs."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[keep], value[keep]
