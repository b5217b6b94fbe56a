"""Operator 2: bounded-space online packing of documents into training sequences.

Each input partition keeps a fixed number of open windows. A document's ids
(with an end id) are cut into whole windows and one rest; the rest goes into the
open window that it fills best. When it fits none, the fullest window is filled
up with the head of the rest and emitted (a gap under ``MIN_CUT`` ids is left as
padding instead), and the tail opens a window in its place. Windows still open
when a partition ends are merged over a fixed number of neighbouring partitions:
their ids are laid end to end, cut into whole windows, and what remains into
powers of two, so merging adds no padding.

Cases. Null text is the empty text: its one id is the end id. Rows are packed
one by one, so repeated rows are packed each. Very long texts are cut. An empty
table gives no rows. Columns other than ``doc_id`` and ``text`` are not read.
The result depends on the order of rows in the input's partitions, not on
timing: a lost task computes the same rows again.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

WINDOW = 2048
OPEN_WINDOWS = 32
END_ID = 1
MIN_CUT = 8
#: Partitions whose open windows are merged together.
MERGE = 64
_SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")
# The vocabulary's rules never join letters, digits and signs of ASCII, but for an apostrophe and what follows it.
KINDS = np.full(256, 3, np.uint8)
KINDS[65:91] = KINDS[97:123] = 1
KINDS[48:58] = 2
KINDS[:33] = KINDS[127:] = KINDS[ord("'")] = 0
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts, through a bounded cache of word ids.

    The vocabulary's rules drop white space and never join across it, nor across
    kinds of characters, so a text's ids are those of its words. Texts that spell a special token are
    given to the tokenizer whole.
    """

    MOST = 600_000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.reset()

    def reset(self) -> None:
        self.index = tokens.Index()
        #: Ids of word k are pool[at[k]:at[k + 1]].
        self.at, self.pool = np.zeros(1, np.int64), np.zeros(0, np.uint16)

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def __call__(self, t: tokens.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin."""
        w = tokens.words(t, lower=False, kinds=KINDS)
        u, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.index) + len(u) > self.MOST:
            self.reset()
        k = self.index.find(u)
        fresh = np.flatnonzero(k < 0)
        if len(fresh):
            got = self.encode(tokens.strings(t.data, w.start[at[fresh]], w.end[at[fresh]], pa.string()).to_pylist())
            n = np.fromiter(map(len, got), np.int64, len(got))
            k[fresh] = np.arange(len(got)) + len(self.at) - 1
            self.index.add(u[fresh], k[fresh])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(n)])
            self.pool = np.concatenate([self.pool, np.fromiter(itertools.chain.from_iterable(got), np.uint16, int(n.sum()))])
        k = k[back]
        n = self.at[k + 1] - self.at[k]
        begin = np.cumsum(n) - n
        ids = self.pool[np.arange(int(n.sum())) + np.repeat(self.at[k] - begin, n)]
        first = np.concatenate([begin, [len(ids)]])[w.first]
        raw = t.data.tobytes()
        if any(s in raw for s in _SPECIAL):
            parts = []
            for i in range(len(t)):
                text = raw[t.offsets[i] : t.offsets[i + 1]]
                parts.append(np.array(self.encode([text.decode()])[0], np.uint16) if any(s in text for s in _SPECIAL) else ids[first[i] : first[i + 1]])
            first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts)
        return ids, first


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Windows:
    """The open windows of one partition."""

    def __init__(self, size: int, most: int, min_cut: int, first_id: int) -> None:
        self.size, self.most, self.min_cut, self.next = size, most, min_cut, first_id
        self.free: list[int] = []
        self.pieces: list[list[tuple]] = []  # (start, length, sequence_id, offset, document)
        self.ids: list[int] = []

    def place(self, document: object, n: int) -> Iterator[list[tuple]]:
        """Place a document of n ids; yields the pieces of each window that is emitted."""
        at = 0
        while n - at >= self.size:
            yield [(at, self.size, self.take_id(), 0, document)]
            at += self.size
        rest = n - at
        if not rest:
            return
        fits = [(free, k) for k, free in enumerate(self.free) if free >= rest]
        if fits:
            yield from self.put(min(fits)[1], document, at, rest)
            return
        if len(self.free) >= self.most:
            k = self.free.index(min(self.free))
            if (gap := self.free[k]) >= self.min_cut:
                yield from self.put(k, document, at, gap)
                at, rest = at + gap, rest - gap
            else:
                yield self.close(k)
        self.free.append(self.size)
        self.pieces.append([])
        self.ids.append(self.take_id())
        yield from self.put(len(self.free) - 1, document, at, rest)

    def take_id(self) -> int:
        self.next += 1
        return self.next - 1

    def put(self, k: int, document: object, at: int, n: int) -> Iterator[list[tuple]]:
        self.pieces[k].append((at, n, self.ids[k], self.size - self.free[k], document))
        self.free[k] -= n
        if not self.free[k]:
            yield self.close(k)

    def close(self, k: int) -> list[tuple]:
        out = self.pieces[k]
        for x in (self.free, self.pieces, self.ids):
            x[k] = x[-1]
            x.pop()
        return out


class _Rows:
    """Output rows, as columns."""

    def __init__(self) -> None:
        self.columns: list[list] = [[] for _ in range(8)]

    def add(self, doc_id, start, length, ids, doc_tokens, sequence_id, offset, keep) -> None:
        raw = ids.astype("<u4").tobytes()
        for column, x in zip(self.columns, (doc_id, start, length, zlib.crc32(raw), doc_tokens, sequence_id, offset, raw if keep else None)):
            column.append(x)

    def batch(self, more: dict | None = None) -> pa.RecordBatch:
        names = [x.split()[0] for x in PIECE.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.binary()]
        out = pa.RecordBatch.from_pydict({k: pa.array(v, t) for k, v, t in zip(names, self.columns, kinds)} | (more or {}))
        self.columns = [[] for _ in range(8)]
        return out


def _pack(path: str, size: int, most: int, min_cut: int, merge: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        pid = TaskContext.get().partitionId()
        encode, windows, rows = encoder(path), Windows(size, most, min_cut, pid << 31), _Rows()

        def batch(group: int | None) -> pa.RecordBatch:
            return rows.batch({"merge_group": pa.array([group] * len(rows.columns[0]), pa.int64())})

        def emit(pieces: list[tuple], keep: bool) -> None:
            for start, n, sid, offset, (doc_id, ids) in pieces:
                rows.add(doc_id, start, n, ids[start : start + n], len(ids), sid, offset, keep)

        for b in batches:
            doc_ids = b.column("doc_id").to_pylist()
            for t in tokens.chunks(b.column("text"), 2_000_000):
                ids, first = encode(t)
                for i in range(len(t)):
                    own = np.append(ids[first[i] : first[i + 1]], np.uint16(END_ID))
                    for pieces in windows.place((doc_ids[t.row + i], own), len(own)):
                        emit(pieces, keep_ids)
                if rows.columns[0]:
                    yield batch(None)
        for pieces in windows.pieces:
            emit(pieces, True)
        if rows.columns[0]:
            yield batch(pid // merge)

    return run


def _merge(size: int, keep_ids: bool):
    def run(key: tuple, left: pa.Table) -> pa.Table:
        left = left.sort_by([("sequence_id", "ascending"), ("offset", "ascending"), ("doc_id", "ascending")])
        total = sum(left["length"].to_pylist())
        cuts = [size] * (total // size) + [1 << k for k in range(size.bit_length(), -1, -1) if total % size >> k & 1]
        rows, sid, at = _Rows(), (1 << 62) + (key[0].as_py() << 31), 0
        for r in left.to_pylist():
            ids, done = np.frombuffer(r["ids"], "<u4"), 0
            while done < len(ids):
                n = min(len(ids) - done, cuts[0] - at)
                rows.add(r["doc_id"], r["start"] + done, n, ids[done : done + n], r["doc_tokens"], sid, at, keep_ids)
                done, at = done + n, at + n
                if at == cuts[0]:
                    cuts, sid, at = cuts[1:], sid + 1, 0
        return pa.Table.from_batches([rows.batch()])

    return run


def pack(docs: DataFrame, path: str | None = None, size: int = WINDOW, open_windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT, merge: int = MERGE, ids: bool = True) -> DataFrame:
    """A row per piece. With ``ids`` each row holds its token ids (little-endian unsigned 32-bit), else only their crc32."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run = _pack(path or default_path(), size, open_windows, min_cut, merge, ids)
    rows = common.stash(base.mapInArrow(run, f"{PIECE}, merge_group long"), "op2_pieces")
    done = rows.where("merge_group is null").drop("merge_group")
    left = rows.where("merge_group is not null").groupBy("merge_group").applyInArrow(_merge(size, ids), PIECE)
    out = done.unionByName(left)
    return out if ids else out.drop("ids")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), ids=False)
