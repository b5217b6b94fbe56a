"""Piece lattices over many short units at once, in numpy.

A *unit* is a short string. Its lattice has a node at each character boundary
and an edge for each vocabulary piece that spells the characters between two
nodes. A character that no piece spells gets one edge through its UTF-8 byte
pieces. Units are handled together: edges of all units are sorted by the place
where they end, so one forward step serves every unit.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

#: Units are at most this long, which keeps scaled forward sums inside a double.
MAX_UNIT = 96
_BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = "▁"


@dataclass
class Edges:
    start: np.ndarray  # node
    end: np.ndarray  # node
    piece: np.ndarray  # id, or -1 - code point for a character through its bytes
    step: np.ndarray  # end of the edge, counted from the start of its unit
    first: np.ndarray  # first node of each unit
    last: np.ndarray  # last node of each unit
    nodes: int


class Vocabulary:
    """The pieces of a public sentencepiece model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte_ids = np.zeros(256, np.int64)
        ids: dict[str, int] = {}
        for i, p in enumerate(self.pieces):
            if m := re.fullmatch(r"<0x([0-9A-F]{2})>", p):
                self.byte_ids[int(m[1], 16)] = i
            elif not model.is_control(i) and not model.is_unknown(i):
                ids[p] = i
        self.ids = ids
        prefixes: dict[str, int] = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                prefixes.setdefault(p[:k], -1)
            prefixes[p] = i
        hashed = {int(self._hash(p)): i for p, i in prefixes.items()}
        if len(hashed) != len(prefixes):
            raise ValueError("two prefixes share a hash")
        keys = np.array(sorted(hashed), np.uint64)
        self.keys, self.values = keys, np.array([hashed[int(k)] for k in keys], np.int64)
        self.longest = max(map(len, ids))

    @staticmethod
    def _hash(text: str) -> np.uint64:
        h = 0
        for c in text:
            h = ((h + ord(c) + 1) * int(_BASE)) & 0xFFFFFFFFFFFFFFFF
        return np.uint64(h)

    def edges(self, units: list[str]) -> Edges:
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        unit_start = np.concatenate([[0], np.cumsum(lengths)])
        unit = np.repeat(np.arange(len(units)), lengths)
        first = unit_start[:-1] + np.arange(len(units))
        stop = unit_start[1:][unit]
        live = np.arange(len(codes))
        h = np.zeros(len(codes), np.uint64)
        starts, lens, ids = [], [], []
        for k in range(1, self.longest + 1):
            h = (h + codes[live + k - 1] + np.uint64(1)) * _BASE
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            known = self.keys[at] == h
            value = self.values[at]
            hit = known & (value >= 0)
            if k == 1:
                lone = live[~hit]
                starts.append(lone)
                lens.append(np.ones(len(lone), np.int64))
                ids.append(-1 - codes[lone].astype(np.int64))
            starts.append(live[hit])
            lens.append(np.full(int(hit.sum()), k, np.int64))
            ids.append(value[hit])
            go = known & (live + k < stop[live])
            live, h = live[go], h[go]
            if not len(live):
                break
        s, n, p = np.concatenate(starts), np.concatenate(lens), np.concatenate(ids)
        start = s + unit[s]
        step = start + n - first[unit[s]]
        # Ties by length: sums are then added in one order, whatever else is in the batch.
        order = np.argsort((step * np.int64(len(codes) + len(units)) + start + n) * 32 + n)
        return Edges(start[order], (start + n)[order], p[order], step[order], first, first + lengths, len(codes) + len(units))

    def weights(self, piece: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Rows of ``table`` (pieces x columns) for each edge; bytes of a lone character multiply."""
        out = table[np.maximum(piece, 0)]
        lone = np.flatnonzero(piece < 0)
        if len(lone):
            code, back = np.unique(-1 - piece[lone], return_inverse=True)
            byte, there = utf8(code)
            out[lone] = np.where(there[:, :, None], table[self.byte_ids[byte]], 1.0).prod(axis=1)[back]
        return out


def utf8(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of code points (surrogates too), n x 4, and which of them there are."""
    code = code.astype(np.int64)[:, None]
    size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    k = np.arange(4)[None, :]
    shift = np.maximum(6 * (size - 1 - k), 0)
    first = np.choose(size - 1, [0, 0xC0, 0xE0, 0xF0])
    byte = np.where(k == 0, first | code >> shift, 0x80 | code >> shift & 0x3F)
    return byte & 0xFF, k < size


def _sweep(n_nodes: int, seed: np.ndarray, src: np.ndarray, dst: np.ndarray, step: np.ndarray, w: np.ndarray) -> np.ndarray:
    alpha = np.zeros((n_nodes, w.shape[1]))
    alpha[seed] = 1.0
    cuts = np.flatnonzero(np.diff(step)) + 1
    for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(step)]])):
        if lo == hi:
            continue
        d = dst[lo:hi]
        heads = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1])
        alpha[d[heads]] = np.add.reduceat(alpha[src[lo:hi]] * w[lo:hi], heads, axis=0)
    return alpha


def forward(e: Edges, w: np.ndarray) -> np.ndarray:
    """Sum over all segmentations up to each node. ``w``: edges x columns."""
    return _sweep(e.nodes, e.first, e.start, e.end, e.step, w)


def backward(e: Edges, w: np.ndarray) -> np.ndarray:
    """Sum over all segmentations from each node to the end of its unit."""
    unit = np.searchsorted(e.first, e.start, side="right") - 1
    left = e.start - e.first[unit]
    order = np.argsort((e.start - left * np.int64(e.nodes)) * 32 + (e.end - e.start))
    return _sweep(e.nodes, e.last, e.end[order], e.start[order], left[order], w[order])
