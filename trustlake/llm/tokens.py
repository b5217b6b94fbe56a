"""Words of many texts at once, in numpy.

Texts stay in the Arrow buffer they came in. A word is a pair of byte places and
a 64-bit hash; Python makes no object for it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15  # odd, 5 modulo 8
_P_INV = pow(_P, -1, 1 << 64)
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
CHUNK = 2_000_000

#: [\x20\x09-\x0D]
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: All but letters; a byte of a longer UTF-8 sequence counts as a letter.
NON_LETTER = np.ones(256, bool)
NON_LETTER[65:91] = NON_LETTER[97:123] = NON_LETTER[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i for i < n, modulo 2^64."""
    if len(_POW[0]) < n:
        for k, base in enumerate((_P, _P_INV)):
            step = np.full(max(n, CHUNK + 1), base, np.uint64)
            step[0] = 1
            _POW[k] = np.cumprod(step, dtype=np.uint64)
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = hash of data[i:j] times P^i."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_VALUES[data] * powers(len(data) + 1)[0][: len(data)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * _POW[1][start] + (end - start).astype(np.uint64))


@dataclass
class Texts:
    """Bytes of a run of texts: text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray
    row: int  # of text 0, in its batch

    def __len__(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[Texts]:
    """The texts of an Arrow string or binary column (null: empty), in runs of about ``most`` bytes."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(min(n, max(lo + 1, np.searchsorted(offsets, offsets[lo] + most, side="right") - 1)))
        yield Texts(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo)
        lo = hi


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    #: words of text i are first[i] .. first[i + 1]
    first: np.ndarray


def words(t: Texts, separators: np.ndarray = WHITE, lower: bool = True, kinds: np.ndarray | None = None) -> Words:
    """Runs of bytes that are no separators. With ``kinds``, also cut where two bytes of different kinds meet (kind 0: never)."""
    n = len(t.data)
    data = LOWER[t.data] if lower else t.data
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(separators[data], out=inside[1:-1])
    edge = np.zeros(n + 1, bool)
    edge[t.offsets] = True
    if kinds is not None and n > 1:
        k = kinds[data]
        edge[1:-1] |= (k[1:] != k[:-1]) & (k[1:] > 0) & (k[:-1] > 0)
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    first = np.searchsorted(start, t.offsets)
    doc = np.repeat(np.arange(len(t)), np.diff(first))
    prefix = prefix_hash(data)
    return Words(start, end, doc, span_hash(prefix, start, end), first)


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow array of the byte spans."""
    n = end - start
    offsets = np.zeros(len(n) + 1, np.int32)
    np.cumsum(n, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], n)
    return pa.Array.from_buffers(kind, len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))])


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for each i; empty ranges give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), values.dtype if values.dtype.kind != "b" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def merged(parts: Iterable[tuple[np.ndarray, np.ndarray, pa.Array]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(hashes, counts, words) parts as one, equal hashes summed."""
    parts = list(parts)
    h = np.concatenate([p[0] for p in parts])
    u, at, back = np.unique(h, return_index=True, return_inverse=True)
    return u, np.bincount(back, np.concatenate([p[1] for p in parts]), len(u)).astype(np.int64), pa.concat_arrays([p[2] for p in parts]).take(pa.array(at))


def counted(t: Texts, w: Words, kind: pa.DataType, lower: bool = True, pick: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Distinct words with their counts."""
    h = w.hash if pick is None else w.hash[pick]
    start, end = (w.start, w.end) if pick is None else (w.start[pick], w.end[pick])
    u, at, n = np.unique(h, return_index=True, return_counts=True)
    return u, n, strings(LOWER[t.data] if lower else t.data, start[at], end[at], kind)


class Index:
    """Sorted hashes with a number each, for caches that grow: new ones gather in a small part first."""

    SMALL = 100_000

    def __init__(self) -> None:
        self.parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]

    def __len__(self) -> int:
        return sum(len(k) for k, _ in self.parts)

    def find(self, u: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        out = np.full(len(u), -1, np.int64)
        for keys, values in self.parts:
            if len(keys):
                k = np.minimum(np.searchsorted(keys, u), len(keys) - 1)
                hit = keys[k] == u
                out[hit] = values[k[hit]]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """``keys``: sorted, and not there yet."""
        self.parts[1] = self._merged(self.parts[1], (keys, values))
        if len(self.parts[1][0]) > self.SMALL:
            self.parts = [self._merged(*self.parts), (np.zeros(0, np.uint64), np.zeros(0, np.int64))]

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        at = np.searchsorted(a[0], b[0])
        return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])
