"""Operator 8: sampled segmentations by forward filtering, backward sampling; lossless decoding.

A text is read as units that no piece of the public vocabulary crosses: a run of
spaces with the run of other characters after it, and each line feed. Forward
sums over a unit's piece lattice are computed once per distinct unit; then every
occurrence walks backward from the unit's end, drawing at each node the piece
that ends there in proportion to the forward sum before it. Draws come from a
counter-based generator seeded by (seed, doc_id, place), so a row gets the same
segmentation on every run, machine and partitioning.

The vocabulary file gives merge ranks, not probabilities; a piece of rank r has
weight 1 / (r + 10), a fixed rule. Characters that no piece spells go through
byte pieces. Spaces are written U+2581 and a text gets one in front, as the
vocabulary expects; a U+2581 of the text itself goes through its bytes, so
decoding gives back every text exactly.

Cases. Null and empty texts have no pieces and decode to the empty text.
Repeated rows (same doc_id and text) get the same pieces; a null doc_id seeds as
0. Units over 96 bytes are cut, at character borders. An empty table gives no
rows; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens
from .lattice import MAX_UNIT, SPACE, Vocabulary, forward
from .op5_language import default_path, vocabulary

SCALE = 300.0
#: Stands for a U+2581 of the text; no text can hold it.
_OWN = "\ud800"
_SPACE_BYTES = SPACE.encode()


def piece_weights(v: Vocabulary) -> np.ndarray:
    rank = np.arange(len(v.pieces), dtype=np.float64)
    out = 1.0 / (rank + 10.0)
    out[v.byte_ids] = 1e-6
    return out[:, None]


def splitmix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Draws segmentations; holds the lattices of at most MOST distinct units."""

    MOST = 250_000

    def __init__(self, path: str) -> None:
        self.v = vocabulary(path)
        self.w = piece_weights(self.v)
        lone = [p.replace(SPACE, " ").encode() for p in self.v.pieces]
        for b, i in enumerate(self.v.byte_ids.tolist()):
            lone[i] = bytes([b])
        self.spelled = np.frombuffer(b"".join(lone), np.uint8)
        self.length = np.fromiter(map(len, lone), np.int64, len(lone))
        self.begin = np.cumsum(self.length) - self.length
        self.reset()

    def reset(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.last = np.zeros(0, np.int64)
        self.key, self.source, self.piece = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.is_first = np.zeros(0, bool)

    def learn(self, hashes: np.ndarray, raw: list[bytes]) -> None:
        keys, sources, pieces, firsts, lasts = [self.key], [self.source], [self.piece], [self.is_first], [self.last]
        base = len(self.is_first)
        for lo in range(0, len(raw), 4000):
            units = [x.decode().replace(SPACE, _OWN).replace(" ", SPACE) if _SPACE_BYTES in x else x.decode().replace(" ", SPACE) for x in raw[lo : lo + 4000]]
            e = self.v.edges(units)
            w = self.v.weights(e.piece, self.w) * SCALE ** (e.end - e.start)[:, None]
            a = forward(e, w)[:, 0]
            order = np.argsort(e.end * 32 + (e.end - e.start))
            end, mass = e.end[order], a[e.start[order]] * w[order, 0]
            heads = np.flatnonzero(np.diff(end, prepend=-1))
            size = np.diff(np.append(heads, len(end)))
            # Shares in whole 2^-32, so a draw never depends on what else is in the batch; a node's last edge takes the rest.
            part = np.floor(mass / np.repeat(np.add.reduceat(mass, heads), size) * 2.0**32).astype(np.int64)
            total = np.cumsum(part)
            share = np.minimum(total - np.repeat(total[heads] - part[heads], size), 1 << 32)
            share[np.append(heads[1:], len(end)) - 1] = 1 << 32
            keys.append(((base + end) << 32) + share)
            sources.append((base + e.start[order]).astype(np.int32))
            pieces.append(e.piece[order].astype(np.int32))
            first = np.zeros(e.nodes, bool)
            first[e.first] = True
            firsts.append(first)
            lasts.append(base + e.last)
            base += e.nodes
        self.key, self.source, self.piece, self.is_first = map(np.concatenate, (keys, sources, pieces, firsts))
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known)
        self.known, self.last = known[order], np.concatenate(lasts)[order]

    def cuts(self, t: tokens.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of units."""
        d = t.data
        space, feed = d == 32, d == 10
        start = np.zeros(len(d) + 1, bool)
        start[1:-1] = (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
        start[t.offsets] = True
        at = np.flatnonzero(start[:-1])
        end = np.append(at[1:], len(d))
        long = np.flatnonzero(end - at > MAX_UNIT)
        if len(long):
            more = []
            for k in long:
                x = at[k] + MAX_UNIT - 4
                while x < end[k]:
                    while d[x] & 0xC0 == 0x80:
                        x -= 1
                    more.append(x)
                    x += MAX_UNIT - 4
            at = np.sort(np.concatenate([at, np.array(more, np.int64)]))
            end = np.append(at[1:], len(d))
        return at, end

    def __call__(self, t: tokens.Texts, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, and where each text's begin. Texts have their space in front already."""
        if not len(t.data):
            return np.zeros(0, np.int32), np.zeros(len(t) + 1, np.int64)
        at, end = self.cuts(t)
        h = tokens.span_hash(tokens.prefix_hash(t.data), at, end)
        u, one, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(u) > self.MOST:
            self.reset()
        fresh = np.flatnonzero(~np.isin(u, self.known, assume_unique=True))
        if len(fresh):
            self.learn(u[fresh], tokens.strings(t.data, at[one[fresh]], end[one[fresh]], pa.binary()).to_pylist())
        node = self.last[np.searchsorted(self.known, u)][back]
        first = np.searchsorted(at, t.offsets)
        doc = np.repeat(np.arange(len(t)), np.diff(first))
        counter = splitmix(seeds[doc] ^ splitmix((np.arange(len(at)) - first[doc]).astype(np.uint64)))
        live, count, steps = np.arange(len(at)), np.zeros(len(at), np.int64), []
        while len(live):
            counter = splitmix(counter)
            k = np.searchsorted(self.key, (node << 32) + (counter >> np.uint64(32)).astype(np.int64), side="right")
            steps.append((live, self.piece[k]))
            count[live] += 1
            node = self.source[k].astype(np.int64)
            go = ~self.is_first[node]
            live, node, counter = live[go], node[go], counter[go]
        stop = np.cumsum(count)
        ids = np.empty(int(stop[-1]), np.int32)
        for k, (who, piece) in enumerate(steps):
            ids[stop[who] - 1 - k] = piece
        begin = np.append(stop - count, len(ids))[first]
        lone = np.flatnonzero(ids < 0)
        if len(lone):
            codes, back = np.unique(-1 - ids[lone], return_inverse=True)
            spelled = [self.v.byte_ids[list(_SPACE_BYTES if c == ord(_OWN) else chr(c).encode())] for c in codes.tolist()]
            n = np.ones(len(ids), np.int64)
            n[lone] = np.fromiter(map(len, spelled), np.int64, len(spelled))[back]
            place = np.cumsum(n) - n
            out = np.empty(int(n.sum()), np.int32)
            whole = ids >= 0
            out[place[whole]] = ids[whole]
            for j in range(int(n[lone].max())):
                has = n[lone] > j
                out[place[lone[has]] + j] = np.array([s[j] if len(s) > j else -1 for s in spelled])[back[has]]
            ids, begin = out, np.append(place, len(out))[begin]
        return ids, begin

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of one row's pieces, without the space in front."""
        n = self.length[ids]
        begin = np.cumsum(n) - n
        return self.spelled[np.arange(int(n.sum())) + np.repeat(self.begin[ids] - begin, n)].tobytes()[1:]


_SAMPLERS: dict[str, Sampler] = {}


def sampler(path: str) -> Sampler:
    if path not in _SAMPLERS:
        _SAMPLERS[path] = Sampler(path)
    return _SAMPLERS[path]


def _encode(path: str, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(path)
        for b in batches:
            doc_id = b.column("doc_id")
            key = splitmix(doc_id.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(seed))
            for t in tokens.chunks(b.column("text"), 2_000_000):
                ids, begin = s(t, key[t.row : t.row + len(t)])
                same = [s.decode(ids[begin[i] : begin[i + 1]]) == t.data[t.offsets[i] + 1 : t.offsets[i + 1]].tobytes() for i in range(len(t))]
                yield pa.RecordBatch.from_pydict({"doc_id": doc_id.slice(t.row, len(t)), "ids": pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids)), "lossless": pa.array(same, pa.bool_())})

    return run


def sample(docs: DataFrame, path: str | None = None, seed: int = 7) -> DataFrame:
    """(doc_id, ids, lossless): a sampled segmentation of each row, and whether it decodes to the row's text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text == "", "").otherwise(F.concat(F.lit(" "), text)).alias("text"))
    return base.mapInArrow(_encode(path or default_path(), seed), "doc_id long, ids array<int>, lossless boolean")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids) rows."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [sampler(path).decode(np.array(x or [], np.int64)).decode() for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": pa.array(out, pa.string())})

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op8_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.size("ids").alias("n_pieces"), "lossless", "ids")
