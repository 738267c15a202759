"""Words of Arrow string columns as 64-bit hashes, in whole-buffer numpy passes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Text bytes handled at a time; a longer text is handled alone.
SLICE_BYTES = 1 << 20
_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def lower_az() -> np.ndarray:
    t = np.arange(256, dtype="u1")
    t[65:91] += 32
    return t


def is_space() -> np.ndarray:
    """Separators of the word rule: space and the control characters from tab to carriage return."""
    t = np.zeros(256, bool)
    t[[9, 10, 11, 12, 13, 32]] = True
    return t


def not_letter() -> np.ndarray:
    """Separators that leave ASCII letters and all bytes of longer characters."""
    t = np.ones(256, bool)
    t[65:91] = t[97:123] = False
    t[128:] = False
    return t


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Sorted:
    """A sorted array of well-mixed hashes with an index on their top bits, so that a search starts where its hash must be."""

    def __init__(self, h: np.ndarray):
        self.order = np.argsort(h)
        self.h = np.append(h[self.order], np.uint64(0))
        self.n = len(h)
        self.shift = np.uint64(64 - max(1, self.n.bit_length()))
        self.start = np.searchsorted(self.h[:-1], np.arange(1 << int(64 - self.shift), dtype="u8") << self.shift).astype("i4")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position in the sorted array, -1 where absent."""
        at = self.start[h >> self.shift]
        out = np.full(len(h), -1, "i4")
        open_ = np.arange(len(h))
        while len(open_):
            i = at[open_]
            here, want = self.h[i], h[open_]
            hit = (here == want) & (i < self.n)
            out[open_[hit]] = i[hit]
            more = (here < want) & (i < self.n)
            open_ = open_[more]
            at[open_] += 1
        return out


class Memory:
    """Numbers 0, 1, ... of hashes in the order they were added: a large sorted table, and a small one that is merged into it as it grows."""

    def __init__(self):
        self.keys, self.old = np.zeros(0, "u8"), 0
        self.tables = (Sorted(self.keys), Sorted(self.keys))

    def __len__(self) -> int:
        return len(self.keys)

    def add(self, h: np.ndarray) -> None:
        """Distinct hashes that are not there yet."""
        self.keys = np.concatenate([self.keys, h])
        if len(self.keys) - self.old > max(20_000, self.old // 2):
            self.old = len(self.keys)
            self.tables = (Sorted(self.keys), Sorted(self.keys[:0]))
        else:
            self.tables = (self.tables[0], Sorted(self.keys[self.old :]))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where absent."""
        large, small = self.tables
        at = large.find(h)
        out = np.where(at >= 0, large.order[at] if large.n else -1, -1)
        rest = np.flatnonzero(at < 0)
        if len(rest) and small.n:
            at = small.find(h[rest])
            out[rest] = np.where(at >= 0, self.old + small.order[at], -1)
        return out


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for m in (_MULT, pow(_MULT, -1, 1 << 64)):
        p = np.empty(n, "u8")
        p[0] = 1
        filled = 1
        while filled < n:
            step = min(filled, n - filled)
            p[filled : filled + step] = p[:step] * np.uint64(pow(m, filled, 1 << 64))
            filled += step
        out.append(p)
    return out[0], out[1]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other (null: empty), and where each begins (one more entry: the end)."""
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        off = np.frombuffer(texts.buffers()[1], "i8")
    else:
        texts = texts if pa.types.is_binary(texts.type) else texts.cast(pa.string())
        off = np.frombuffer(texts.buffers()[1], "i4") if len(texts) else np.zeros(1, "i4")
    off = off[texts.offset : texts.offset + len(texts) + 1].astype("i8")
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, "u1")[off[0] : off[-1]] if raw is not None and raw.size else np.zeros(0, "u1")
    return data, off - off[0]


@lru_cache(1)
def _malloc_trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


def trim() -> None:
    """Give freed memory back: workers are used again by later stages, and what one held must not add up."""
    pa.default_memory_pool().release_unused()
    if f := _malloc_trim():
        f(0)


_HELD: dict[str, Callable[[], None]] = {}


def claim(owner: str, release: Callable[[], None] | None = None) -> None:
    """Called as a task begins: what other operators' tasks have left in this worker goes, and `release` is what frees what this one will leave."""
    others = [k for k in _HELD if k != owner]
    for k in others:
        _HELD.pop(k)()
    if others:
        trim()
    if release:
        _HELD[owner] = release


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most `most` bytes of text each, or one row; nulls become empty texts."""
    texts = batch.column(column).fill_null("")
    batch = batch.set_column(column, batch.schema.field(column), texts)
    _, off = buffers(texts)
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    trim()


def spans(data: np.ndarray, off: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and document index of every word; a word never spans two documents."""
    inside = ~sep[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = off[:-1][off[:-1] < len(data)]
    first[begins] = inside[begins]
    start = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = off[1:-1] - 1
    ends = ends[(ends >= 0) & (ends < len(data))]
    last[ends] = inside[ends]
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, side="right") - 1


class Hasher:
    """Hashes of byte ranges of one buffer, each byte first looked up in a table."""

    def __init__(self, data: np.ndarray, table: np.ndarray):
        up, self.down = _powers(1 << max(20, (len(data) - 1).bit_length()))
        self.sums = np.zeros(len(data) + 1, "u8")
        np.cumsum((table[data].astype("u8") + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def words(data: np.ndarray, off: np.ndarray, sep: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes), document index and hash of every word."""
    start, end, doc = spans(data, off, sep)
    if not len(start):
        z = np.zeros(0, "i8")
        return z, z, z, np.zeros(0, "u8")
    return start, end, doc, Hasher(data, lower)(start, end)


_ORDER = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `width` words; of a text with fewer words, of all its words as one."""
    data, off = buffers(texts)
    _, _, doc, h = words(data, off, is_space(), lower_az())
    count = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), "i8")
    at = np.r_[0, np.cumsum(count)]
    k = len(h) - width + 1
    g = np.zeros(max(k, 0), "u8")
    for i in range(width):
        if k > 0:
            g += h[i : i + k] * _ORDER[i]
    g = mix(g)
    out = []
    for i, n in enumerate(count):
        if n >= width:
            out.append(np.unique(g[at[i] : at[i] + n - width + 1]))
        elif n:
            w = h[at[i] : at[i + 1]]
            out.append(mix((w * np.array(_ORDER[:n])).sum(dtype="u8", keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, "u8"))
    return out
