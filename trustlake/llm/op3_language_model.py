"""Operator 3: language-model scoring by a hierarchical Pitman-Yor model.

Three families of restaurants, each the parent of the one before:

* *After a word*: the context is the word before (or the beginning); dishes are
  words and the end. One restaurant for every word of the training texts.
* *Words*: a single restaurant that all those contexts share; its customers are
  their tables.
* *Spelling*: bytes given three bytes before (in 32 kinds), with two, one and no
  byte as parents; its customers are tables of words.

Neither words, contexts nor cells (a word after a word) are bounded. Cells live in
Spark, dealt to buckets by their word, so that a Gibbs sweep finds a word's cells
and its place in the parent together; each sweep draws every cell's tables anew,
then those of the words, given the restaurants' totals of the sweep before
(parallel Gibbs), and discounts and strengths are drawn from their posterior. After
burn-in, predictive probabilities are averaged over samples.

What the driver gathers is bounded: totals of the ``KNOWN`` most frequent contexts,
and the ``HEAVY`` most frequent words, whose cells are dealt to ``SPLIT`` buckets.
Totals of all other (*far*) contexts stay in Spark. A cell with one customer has one
table, so once the first exchange has told every bucket how many such cells a far
context has, only contexts with several larger cells change beyond a bucket's sight:
between two sweeps buckets send their tables of those to parts dealt by context and
get the sums back. Parts also count far restaurants by customers and by tables, for
discounts and strengths. For scoring, totals are joined to the tokens that need them.

Tokens travel packed: a task sends, for each bucket, its words in order, each with
the contexts and documents it stands in, compressed. Back come sums for documents.

Cases. Null text is empty: one token, the end. Repeated rows are scored (and, in
training, counted) each. Without training rows all words are unknown. An empty
table gives no rows. Words are told apart by a 64-bit hash. Only ``doc_id`` and
``text`` are read, more than once: ``docs`` must give its rows in the same order
each time, as a scan of files does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens
from .pitman_yor import EXACT, Hierarchy, draw, histogram, resample

FOLDS, FOLD = 7, 2
KNOWN = 1 << 18
HEAVY, SPLIT = 64, 32
BURN, SAMPLES = 2, 3
KINDS = 32
STOP = 32  # the byte that ends a word
#: Bytes of a bucket, about, and entries that a task gathers before it sends them.
BUCKET, GATHER = 8_000_000, 700_000
SLICES = 16
#: Words and contexts as numbers: 0 is the end (as a word) and the beginning (as a context), the KNOWN most frequent words follow by rank, all others are their hash with the highest bit.
END, FAR = np.uint64(0), np.uint64(1 << 63)
_ZSTD = pa.Codec("zstd", 1)


# -- spelling
def _kind() -> np.ndarray:
    """Byte -> kind: a-z each, the end of a word, digits, other signs, and three of what is beyond ASCII."""
    out = np.full(256, 28, np.int64)
    out[48:58] = 27
    out[STOP] = 26
    out[97:123] = np.arange(26)
    out[128:] = 29 + np.arange(128) % 3
    return out


KIND = _kind()


def _as_words(column: pa.Array) -> tuple[tokens.Texts, tokens.Words]:
    """Each text as one word."""
    t = next(tokens.chunks(column, 1 << 40))
    start, end = t.offsets[:-1], t.offsets[1:]
    return t, tokens.Words(start, end, np.arange(len(t)), tokens.span_hash(tokens.prefix_hash(t.data), start, end), np.arange(len(t) + 1))


def letters(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and bytes that spell the words, and where each word's begin."""
    n = end - start + 1
    begin = np.concatenate([[0], np.cumsum(n)])
    inside = np.arange(begin[-1]) - np.repeat(begin[:-1], n)
    byte = data[np.minimum(np.repeat(start, n) + inside, max(0, len(data) - 1))].astype(np.int64) if len(data) else np.zeros(begin[-1], np.int64)
    byte[begin[1:] - 1] = STOP
    kind = KIND[byte]
    before = [np.where(inside >= k, np.concatenate([np.full(k, KIND[STOP]), kind])[: len(kind)], KIND[STOP]) for k in (1, 2, 3)]
    return before[0] + KINDS * (before[1] + KINDS * before[2]), byte, begin


class Spelling:
    """Natural logarithms of the letters' probabilities. A context that training never saw has its parent's row, so only rows of others are kept."""

    def __init__(self, table: np.ndarray, seen: np.ndarray) -> None:
        keep = np.zeros(len(table), bool)
        keep[seen] = True
        pairs = np.arange(KINDS**2)
        # One row for each two bytes stands for all unseen contexts that end so: they are equal.
        stand_in = np.full(KINDS**2, -1)
        unseen = np.flatnonzero(~keep)
        stand_in[unseen % KINDS**2] = unseen
        rows = np.concatenate([seen, stand_in[pairs[stand_in >= 0]]])
        number = np.full(len(table), -1, np.int32)
        number[rows] = np.arange(len(rows))
        number[unseen] = number[stand_in[unseen % KINDS**2]]
        self.row, self.log = number, np.log(table[rows]).astype(np.float32)

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Logarithm of the probability that the words are spelled so (the end is the word without a byte)."""
        context, byte, first = letters(data, start, end)
        return tokens.sums(self.log[self.row[context], byte].astype(np.float64), first)

    @property
    def end(self) -> float:
        return float(self(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64))[0])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.trim()
    parts, held = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        if parts:
            _, n, word = tokens.merged(parts)
            parts.clear()
            yield pa.RecordBatch.from_pydict({"word": word, "n": pa.array(n)})

    for b in batches:
        for t in tokens.chunks(b.column("text")):
            got = tokens.counted(t, tokens.words(t), pa.binary())
            parts.append(got)
            held += len(got[0])
        if held > GATHER:
            yield from out()
            held = 0
    yield from out()


def _count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of the spelling; a word counts as often as it would be served at a table of its own if all its tokens shared one context."""
    total = np.zeros(KINDS**3 * 256, np.int64)
    for b in batches:
        for lo in range(0, b.num_rows, 50_000):
            t, w = _as_words(b.column("word").slice(lo, 50_000))
            n = b.column("n").slice(lo, 50_000).to_numpy()
            rng = np.random.default_rng(int(w.hash[0] & np.uint64(0xFFFFFFFF)))
            tables = draw(n, np.full(len(n), 0.5), np.full(len(n), 0.01), 0.5, rng)
            context, byte, first = letters(t.data, w.start, w.end)
            np.add.at(total, context * 256 + byte, np.repeat(tables, np.diff(first)))
    cell = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"cell": pa.array(cell, pa.int64()), "n": pa.array(total[cell], pa.int64())})


# -- tokens on their way
def pack(x: np.ndarray) -> bytes:
    """Bytes of the numbers, plane by plane, compressed."""
    return x.nbytes.to_bytes(8, "little") + _ZSTD.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), asbytes=True) if len(x) else b""


def unpack(raw: bytes, kind) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    planes = np.frombuffer(_ZSTD.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class Known:
    """Numbers of the most frequent words, by rank, and how they are spelled."""

    def __init__(self, by_rank: np.ndarray, heavy: int, spells: np.ndarray) -> None:
        by = np.argsort(by_rank)
        self.hash, self.number = by_rank[by], (by + 1).astype(np.uint64)
        self.heavy = min(heavy, len(by))  # numbers up to this one are heavy, the end among them
        self.spells = spells.astype(np.float32)  # of the end and of each number

    @staticmethod
    def find(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there)."""
        if not len(sorted_):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        k = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
        return k, sorted_[k] == x

    def numbers(self, h: np.ndarray) -> np.ndarray:
        k, hit = self.find(self.hash, h)
        return np.where(hit, self.number[k], h | FAR) if len(self.hash) else h | FAR


def stream(t: tokens.Texts, known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, context and text of all tokens with the ends, plainly."""
    w = tokens.words(t)
    text = np.repeat(np.arange(len(t)), np.diff(w.first) + 1)
    word = np.full(len(text), END, np.uint64)
    word[np.arange(len(w.hash)) + w.doc] = known.numbers(w.hash)
    context = np.concatenate([np.zeros(1, np.uint64), word[:-1]])
    context[np.flatnonzero(np.diff(text, prepend=-1))] = END
    return word, context, text


def within(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Differences inside runs of the given sizes; what a run begins with stays."""
    out = x.copy()
    out[1:] -= x[:-1]
    first = np.cumsum(sizes.astype(np.int64)) - sizes
    out[first] = x[first]
    return out


def summed(d: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The inverse."""
    total = np.cumsum(d, dtype=d.dtype)
    first = np.cumsum(sizes.astype(np.int64)) - sizes
    return total - np.repeat(total[first] - d[first], sizes.astype(np.int64))


#: A row on its way: words of a bucket, how many entries each has, the spelling of those that aren't known, and the entries.
SENT = "bucket int, base long, words binary, sizes binary, spells binary, contexts binary, texts binary, times binary"
KIND_OF = {"words": "<u8", "sizes": "<u4", "spells": "<f4", "contexts": "<u8", "texts": "<u4", "times": "<u4"}


def _heads(*sorted_: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_[0]), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in sorted_], axis=0)
    return np.flatnonzero(new)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens.mix(h) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Gathered:
    """Tokens of some texts of a task. Words and contexts are numbered, so that one sort of one number for each token puts them in order."""

    def __init__(self, known: Known, spelling: Spelling, buckets: int, with_texts: bool) -> None:
        self.known, self.spelling, self.buckets, self.with_texts = known, spelling, buckets, with_texts
        self.index, self.spells = tokens.Index(), np.zeros(0, np.float32)
        self.clear()

    def clear(self) -> None:
        if len(self.index) > 400_000:
            self.index, self.spells = tokens.Index(), np.zeros(0, np.float32)
        self.words: list[np.ndarray] = []
        self.texts: list[np.ndarray] = []
        self.base, self.many = -1, 0

    def add(self, t: tokens.Texts, row: np.ndarray) -> None:
        if self.base < 0:
            self.base = int(row[0])
        w = tokens.words(t)
        text = np.repeat(row - self.base, np.diff(w.first) + 1)
        u, at, own = np.unique(w.hash, return_index=True, return_inverse=True)
        number = self.known.numbers(u)
        word = np.full(len(text), END, np.uint64)
        word[np.arange(len(w.hash)) + w.doc] = number[own]
        far = np.flatnonzero(number >= FAR)
        far = far[np.argsort(number[far])]
        fresh = far[self.index.find(number[far]) < 0]
        if len(fresh):
            got = self.spelling(tokens.LOWER[t.data], w.start[at[fresh]], w.end[at[fresh]])
            self.index.add(number[fresh], len(self.spells) + np.arange(len(fresh)))
            self.spells = np.concatenate([self.spells, got.astype(np.float32)])
        self.words.append(word)
        self.texts.append(text)
        self.many += len(word)

    def out(self) -> pa.RecordBatch:
        word, text = np.concatenate(self.words), np.concatenate(self.texts)
        u, own = np.unique(word, return_inverse=True)
        before = np.concatenate([[len(u)], own[:-1]])
        before[np.flatnonzero(np.diff(text, prepend=-1))] = len(u)
        context = np.append(u, END)
        # Contexts in order, the beginning first: what is sorted by their places is sorted by their numbers.
        place = np.append(np.arange(1, len(u) + 1), 0)
        # A unit is a word, or one of the parts that a heavy word's contexts are dealt to.
        heavy = u <= np.uint64(self.known.heavy)
        split = (tokens.mix(context) % np.uint64(SPLIT)).astype(np.int64)
        size = np.where(heavy, SPLIT, 1)
        first = np.cumsum(size) - size
        of = np.repeat(np.arange(len(u)), size)
        part = np.arange(len(of)) - first[of]
        bucket = _bucket(u[of] * np.uint64(2 * SPLIT) + (part + heavy[of]).astype(np.uint64), self.buckets)
        by = np.lexsort((part, of, bucket))
        rank = np.empty(len(of), np.uint64)
        rank[by] = np.arange(len(of), dtype=np.uint64)
        unit = first[own] + np.where(heavy[own], split[before], 0)
        before, context = place[before], np.concatenate([context[-1:], context[:-1]])
        key = np.sort(rank[unit] << np.uint64(42) | before.astype(np.uint64) << np.uint64(21) | (text.astype(np.uint64) if self.with_texts else np.uint64(0)))
        head = _heads(key)
        n, key = np.diff(np.append(head, len(key))), key[head]
        low = np.uint64((1 << 21) - 1)
        unit, before, text = (key >> np.uint64(42)).astype(np.int64), (key >> np.uint64(21) & low).astype(np.int64), (key & low).astype(np.int64)
        own, where = of[by][unit], bucket[by][unit]
        rows: dict[str, list] = {k: [] for k in ("bucket", "base", *KIND_OF)}
        cuts = _heads(where).tolist()
        starts = _heads(unit)
        edges = np.searchsorted(starts, [*cuts, len(where)])
        for i, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], len(where)])):
            f = starts[edges[i] : edges[i + 1]]
            words, sizes = u[own[f]], np.diff(np.append(f, hi))
            far = words[words >= FAR]
            values = {"words": within(words, np.array([len(words)])), "sizes": sizes, "spells": self.spells[self.index.find(far)] if len(far) else np.zeros(0), "contexts": within(context[before[lo:hi]], sizes), "texts": text[lo:hi] if self.with_texts else text[:0], "times": n[lo:hi]}
            rows["bucket"].append(int(where[lo]))
            rows["base"].append(self.base)
            for k, v in values.items():
                rows[k].append(pack(v.astype(KIND_OF[k])))
        kinds = {"bucket": pa.int32(), "base": pa.int64()}
        return pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in rows.items()})


def _send(known: Known, spelling: Spelling, buckets: int, with_texts: bool):
    """Tokens by bucket of their word; ``with_texts``: for each document, else for the task's texts together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        g = Gathered(known, spelling, buckets, with_texts)
        for b in batches:
            row = b.column("row").to_numpy()
            for t in tokens.chunks(b.column("text")):
                if g.many and (g.many + len(t.data) // 2 > 2 * GATHER or row[t.row] - g.base > 1_000_000):
                    yield g.out()
                    g.clear()
                g.add(t, row[t.row : t.row + len(t)])
                if g.many > GATHER:
                    yield g.out()
                    g.clear()
        if g.many:
            yield g.out()

    return run


def opened(r: dict, known_spells: np.ndarray) -> dict[str, np.ndarray]:
    """A row that was sent."""
    v = {k: unpack(r[k], kind) for k, kind in KIND_OF.items()}
    v["words"] = np.cumsum(v["words"], dtype=np.uint64)
    v["contexts"] = summed(v["contexts"], v["sizes"])
    far = v["words"] >= FAR
    spells = known_spells[np.where(far, 0, v["words"]).astype(np.int64)].copy()
    spells[far] = v["spells"]
    v["spells"] = spells
    return v


# -- cells
#: Cells of a bucket: words with their customers' cells; t: tables of a cell, now and summed over samples; served: the words' tables; p: the words' probability in each sample.
CELL_KINDS = {"words": "<u8", "sizes": "<u4", "spells": "<f4", "contexts": "<u8", "n": "<u4", "t": "<u4", "sum_t": "<u4", "served": "<u4", "p": "<f8"}
#: For each cell of several customers in a far context: how many cells of one customer the context has, and whether it has more cells of several ("shared").
CELL_KINDS |= {"single": "<u4", "shared": "u1"}
#: What the bucket tells of far contexts, by part: their tables in cells of several customers and, the first time, customers, cells of one customer and of several. Later only of shared ones (``ask_single``: in all buckets); all tables of the others are in ``shut``.
ASK_KINDS = {"ask": "<u8", "ask_t": "<u4", "ask_single": "<u4", "ask_n": "<u4", "ask_more": "<u4", "shut": "<u4"}
CELLS = ", ".join(["bucket int", *[f"{k} binary" for k in CELL_KINDS | ASK_KINDS]])
#: What scoring reads of them.
SCORED = ("words", "sizes", "contexts", "n", "sum_t", "p")
#: Buckets whose far contexts make a part.
PART = 8


def _row(bucket: int, c: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    none = np.zeros(0)
    return {"bucket": pa.array([bucket], pa.int32())} | {k: pa.array([pack(c.get(k, none).astype(kind))], pa.binary()) for k, kind in (CELL_KINDS | ASK_KINDS).items()}


def _by_part(contexts: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct contexts in order of their parts, and the place of each one that was given."""
    u, back = np.unique(contexts, return_inverse=True)
    by = np.argsort(_bucket(u, parts), kind="stable")
    place = np.empty(len(u), np.int64)
    place[by] = np.arange(len(u))
    return u[by], place[back]


def _gather(known_spells: np.ndarray, parts: int):
    """Cells with their customers; to begin with one table each."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        common.trim()
        rows = [opened(r, known_spells) for r in group.select(list(KIND_OF)).to_pylist()]
        word, spell = (np.concatenate([np.repeat(v[k], v["sizes"].astype(np.int64)) for v in rows]) for k in ("words", "spells"))
        context, times = (np.concatenate([v[k] for v in rows]) for k in ("contexts", "times"))
        by = np.lexsort((context, word))
        word, context, spell, times = word[by], context[by], spell[by], times[by].astype(np.int64)
        head = _heads(word, context)
        n = np.add.reduceat(times, head)
        word, context, spell = word[head], context[head], spell[head]
        first = _heads(word)
        sizes = np.diff(np.append(first, len(word)))
        one = np.ones(len(n), np.uint32)
        far = context >= FAR
        ask, at = _by_part(context[far], parts)
        count = lambda x: np.bincount(at, x, len(ask))
        more = count(n[far] > 1)
        told = {"ask": ask, "ask_t": more, "ask_single": count(n[far] == 1), "ask_n": count(n[far]), "ask_more": more}
        return pa.table(_row(key[0].as_py(), told | {"words": word[first], "sizes": sizes, "spells": spell[first], "contexts": context, "n": n, "t": one, "sum_t": 0 * one, "served": np.ones(len(first))}))

    return run


@dataclass
class State:
    """What sweeps share: parameters, totals, and what is known of contexts and heavy words. All of bounded size."""

    d: float = 0.5  # after a word
    theta: float = 1.0
    d0: float = 0.5  # words
    theta0: float = 1.0
    customers: float = 0.0  # of the words' restaurant, and its tables
    tables: float = 0.0
    n: np.ndarray = field(default_factory=lambda: np.zeros(1))  # customers of each known context
    t: np.ndarray = field(default_factory=lambda: np.zeros(1))
    heavy_p: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of the heavy words, by number

    def word_p(self, words: np.ndarray, customers: np.ndarray, served: np.ndarray, spell: np.ndarray) -> np.ndarray:
        """Probability of the words in their restaurant."""
        p = (np.maximum(customers - self.d0 * served, 0) + (self.theta0 + self.d0 * self.tables) * np.exp(spell.astype(np.float64))) / (self.theta0 + self.customers)
        heavy = words < np.uint64(len(self.heavy_p))
        return np.where(heavy, self.heavy_p[np.where(heavy, words, 0).astype(np.int64)], p) if len(self.heavy_p) else p

    def share(self) -> np.ndarray:
        """What each known context leaves to the words' restaurant."""
        return (self.theta + self.d * self.t) / (self.theta + self.n)


#: Between sweeps: what a bucket tells a part, and what parts say: to buckets (what 0), or how many far restaurants have so many customers (1) or tables (2: none but cells of one customer, 3: others). ``single`` has the numbers, ``t`` how many there are.
TOLD = "part int, bucket int, ask binary, t binary, single binary, n binary, more binary"
SAID = "what int, bucket int, part int, t binary, single binary, shared binary"


def _tell(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        for b in batches:
            rows: list[tuple] = []
            for r in b.to_pylist():
                v = {k: unpack(r[k], kind) for k, kind in ASK_KINDS.items()}
                part = _bucket(v["ask"], parts)
                cuts = _heads(part).tolist() if len(part) else []
                for lo, hi in zip(cuts, [*cuts[1:], len(part)]):
                    rows.append((int(part[lo]), r["bucket"], *[pack(v[k][lo:hi]) for k in ("ask", "ask_t", "ask_single", "ask_n", "ask_more")]))
                if len(v["shut"]):
                    size, n = np.unique(v["shut"], return_counts=True)
                    rows.append((-1 - r["bucket"] % SLICES, -1, b"", pack(n), pack(size.astype("<i8")), b"", b""))
            if rows:
                kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["part", "bucket", "ask", "t", "single", "n", "more"])

    return run


def tally(size: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sizes, and how many there are of each."""
    u, back = np.unique(size, return_inverse=True)
    return u.astype(np.int64), np.bincount(back, n, len(u)).astype(np.int64)


def _say(first: bool):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        common.trim()
        part, told, rows = key[0].as_py(), group.to_pylist(), []
        counted = lambda what, size, n: rows.append((what, -1, part, pack(n), pack(size), b"")) if len(size) else None
        if part < 0:
            counted(3, *tally(*(np.concatenate([unpack(r[k], "<i8") for r in told]) for k in ("single", "t"))))
        else:
            v = [{k: unpack(r[k], ASK_KINDS[f]) for k, f in (("ask", "ask"), ("t", "ask_t"), ("single", "ask_single"), ("n", "ask_n"), ("more", "ask_more"))} for r in told]
            u, at = np.unique(np.concatenate([x["ask"] for x in v]), return_inverse=True)
            total = lambda k: np.bincount(at, np.concatenate([x[k] for x in v]), len(u)).astype(np.int64)
            t, single = total("t"), np.zeros(len(u), np.int64)
            more = total("more") if first else np.full(len(u), 2)
            if first:
                single = total("single")
                counted(1, *tally(total("n"), np.ones(len(u))))
            else:
                single[at] = np.concatenate([x["single"] for x in v])
            for what, these in ((2, more == 0), (3, more > 0)):
                counted(what, *tally((single + t)[these], np.ones(these.sum())))
            lo = 0
            for r, x in zip(told, v):
                mine = at[lo : lo + len(x["ask"])]
                lo += len(x["ask"])
                if first:
                    mine = mine[x["more"] > 0]
                if len(mine):
                    rows.append((0, r["bucket"], part, pack(t[mine].astype("<u4")), pack(single[mine].astype("<u4")) if first else b"", pack((more[mine] > 1).astype("u1")) if first else b""))
        kinds = [pa.int32()] * 3 + [pa.binary()] * 3
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["what", "bucket", "part", "t", "single", "shared"])

    return run


def _exchange(m: Model, first: bool) -> DataFrame:
    """Far contexts' totals, for the buckets and, counted, for the driver."""
    told = m.cells.select("bucket", *ASK_KINDS).mapInArrow(_tell(m.parts), TOLD)
    said = common.stash(told.groupBy("part").applyInArrow(_say(first), SAID), "op3_far", "none")
    got = said.where("what > 0").select("what", "single", "t").toArrow().to_pylist()
    none = [np.zeros(0, np.int64)]
    counts = {what: tally(*(np.concatenate(none + [unpack(r[k], "<i8") for r in got if r["what"] == what]) for k in ("single", "t"))) for what in (1, 2, 3)}
    if first:
        m.far_n, m.far_still = counts[1], counts[2]
    m.far_t = tuple(np.concatenate(x) for x in zip(m.far_still, counts[3]))
    return said


def _heard(c: dict[str, np.ndarray], said: list[dict], parts: int) -> np.ndarray:
    """The other tables in the restaurant, for each cell of several customers in a far context. What is said first is kept with the cells."""
    at = np.flatnonzero((c["contexts"] >= FAR) & (c["n"] > 1))
    said = sorted(said, key=lambda r: r["part"])
    t, single, shared = (np.concatenate([np.zeros(0, kind), *[unpack(r[k], kind) for r in said]]) for k, kind in (("t", "<u4"), ("single", "<u4"), ("shared", "u1")))
    if len(c["single"]) < len(at):
        _, place = _by_part(c["contexts"][at], parts)
        c["single"], c["shared"] = single[place], shared[place]
        t = t[np.unique(place[c["shared"] > 0])]
    out = c["single"].astype(np.float64)
    some = np.flatnonzero(c["shared"])
    if len(some):
        _, place = _by_part(c["contexts"][at[some]], parts)
        out[some] += t[place].astype(np.float64) - c["t"][at[some]]
    return out


def _step(s: State, number: int, sample: bool, parts: int):
    """A Gibbs step of a bucket: every cell, then every word that is not heavy."""

    def run(r: dict, said: list[dict]) -> dict[str, pa.Array]:
        c = {k: unpack(r[k], kind) for k, kind in CELL_KINDS.items()}
        rng = np.random.default_rng([number, r["bucket"]])
        sizes = c["sizes"].astype(np.int64)
        first = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(sizes)), sizes)
        customers = np.add.reduceat(c["t"].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        p = s.word_p(c["words"], customers, c["served"], c["spells"])
        many = np.flatnonzero(c["n"] > 1)
        near = c["contexts"][many] < FAR
        others = np.zeros(len(many))
        others[near] = np.maximum(s.t[c["contexts"][many][near].astype(np.int64)] - c["t"][many][near], 0)
        others[~near] = _heard(c, said, parts)
        q = p[of[many]]
        t = c["t"].copy()
        t[many] = draw(c["n"][many], (s.theta + s.d * others) * q, s.d * q, s.d, rng)
        c["t"] = t
        customers = np.add.reduceat(t.astype(np.int64), first) if len(first) else customers
        base = np.exp(c["spells"].astype(np.float64))
        c["served"] = draw(customers, (s.theta0 + s.d0 * np.maximum(s.tables - c["served"], 0)) * base, s.d0 * base, s.d0, rng)
        if sample:
            c["sum_t"] = c["sum_t"] + t
            c["p"] = np.concatenate([c["p"], s.word_p(c["words"], customers, c["served"], c["spells"])])
        far, shared = many[~near], c["shared"] > 0
        c["shut"] = c["single"][~shared] + t[far[~shared]]
        c["ask"], at = _by_part(c["contexts"][far[shared]], parts)
        c["ask_t"] = np.bincount(at, t[far[shared]], len(c["ask"]))
        c["ask_single"] = np.zeros(len(c["ask"]), np.int64)
        c["ask_single"][at] = c["single"][shared]
        return _row(r["bucket"], c)

    return run


def _sweep(m: Model, s: State, number: int, sample: bool, said: DataFrame | None) -> DataFrame:
    """All buckets' steps. Cells travel only to meet what was said of far contexts."""
    step = _step(replace(s, n=np.zeros(0), t=s.t.astype(np.float32)), number, sample, m.parts)
    cells = m.cells.select("bucket", *CELL_KINDS)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_pydict(step(r, []))

    def met(key: tuple, own: pa.Table, said: pa.Table) -> pa.Table:
        common.trim()
        return pa.table(step(own.to_pylist()[0], said.to_pylist()))

    if said is None:
        return cells.mapInArrow(alone, CELLS)
    return cells.groupBy("bucket").cogroup(said.where("what = 0").groupBy("bucket")).applyInArrow(met, CELLS)


def _totals(contexts: int, heavy: int):
    """Customers and tables of known contexts, slice by slice, and of heavy words; cells and other words by customers and tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, t = np.zeros(contexts, np.int64), np.zeros(contexts, np.int64)
        cells, words, both = np.zeros((EXACT + 1, EXACT + 1), np.int64), np.zeros((EXACT + 1, EXACT + 1), np.int64), np.zeros(2, np.int64)
        mine = np.zeros((heavy + 1, 2), np.int64)
        for b in batches:
            for r in b.to_pylist():
                c = {k: unpack(r[k], CELL_KINDS[k]) for k in ("words", "sizes", "contexts", "n", "t", "served")}
                near = c["contexts"] < FAR
                at = c["contexts"][near].astype(np.int64)
                n += np.bincount(at, c["n"][near], contexts).astype(np.int64)
                t += np.bincount(at, c["t"][near], contexts).astype(np.int64)
                cells += histogram(c["n"], c["t"])
                first = np.cumsum(c["sizes"].astype(np.int64)) - c["sizes"]
                own = np.add.reduceat(c["t"].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
                all_n = np.add.reduceat(c["n"].astype(np.int64), first) if len(first) else own
                hit = c["words"] <= np.uint64(heavy)
                np.add.at(mine, c["words"][hit].astype(np.int64), np.stack([own[hit], all_n[hit]], axis=1))
                words += histogram(own[~hit], c["served"][~hit])
                both += [int(own[~hit].sum()), int(c["served"][~hit].sum())]
        rest = np.concatenate([cells.ravel(), words.ravel(), both, mine.ravel()])
        edge = np.linspace(0, contexts, SLICES + 1).astype(int)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES + 1), pa.int32()), "n": pa.array([*[pack(n[a:z]) for a, z in zip(edge, edge[1:])], pack(rest)], pa.binary()), "t": pa.array([*[pack(t[a:z]) for a, z in zip(edge, edge[1:])], b""], pa.binary())})

    return run


def _add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, t = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        for x, y in zip(b.column("n").to_pylist(), b.column("t").to_pylist()):
            x, y = unpack(x, "<i8"), unpack(y, "<i8")
            n, t = (x + n if len(n) else x), (y + t if len(t) else y)
    yield pa.RecordBatch.from_pydict({"slice": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([pack(n)], pa.binary()), "t": pa.array([pack(t)], pa.binary())})


class Model:
    """The fitted model: cells in Spark, the rest of bounded size."""

    known: Known
    spelling: Spelling
    cells: DataFrame
    samples: list[State]
    total: int
    types: int
    buckets: int
    parts: int
    heavy_n: np.ndarray
    #: Far restaurants counted: sizes and how many, by customers, by tables, and by tables where those never change.
    far_n: tuple[np.ndarray, np.ndarray]
    far_t: tuple[np.ndarray, np.ndarray]
    far_still: tuple[np.ndarray, np.ndarray]

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1.0) / (self.total + self.types + 1.0))


def fit(train: DataFrame, burn: int = BURN, samples: int = SAMPLES, seed: int = 5) -> Model:
    """The model of ``train`` (row, text)."""
    m, rng = Model(), np.random.default_rng(seed)
    words = common.stash(train.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "op3_words")
    s = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    ends = train.count()
    m.total, m.types = (s["n"] or 0) + ends, s["v"] + int(ends > 0)
    got = words.select("word", "n").mapInArrow(_count_letters, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    common.tidy(train.sparkSession)
    cell, n = got["cell"].to_numpy(), got["n"].to_numpy()
    parents = [np.arange(KINDS**k) % KINDS ** (k - 1) for k in (3, 2, 1)]
    m.spelling = Spelling(Hierarchy(cell // 256, cell % 256, n, parents, 256).averaged(), np.unique(cell // 256))
    top = words.orderBy(F.desc("n"), "word").limit(KNOWN).mapInArrow(_known(m.spelling), "h long, spell float").toArrow()
    m.known = Known(top["h"].to_numpy().view(np.uint64), HEAVY, np.append(m.spelling.end, top["spell"].to_numpy()))
    m.buckets = max(1, math.ceil(m.total * 5 / BUCKET))
    sent = train.select("row", "text").mapInArrow(_send(m.known, m.spelling, m.buckets, False), SENT)
    m.parts = math.ceil(m.buckets / PART)
    m.cells = common.stash(sent.groupBy("bucket").applyInArrow(_gather(m.known.spells, m.parts), CELLS), "op3_cells", "none")
    common.drop(words)
    del sent, got, top
    common.tidy(train.sparkSession)
    state, m.samples = State(heavy_p=np.full(m.known.heavy + 1, 1.0 / (m.known.heavy + 1))), []
    served = np.ones(m.known.heavy + 1, np.int64)
    said, speak, any_far = None, False, True
    for number in range(burn + samples + 1):
        if number:
            swept = common.stash(_sweep(m, state, number, number > burn, said if speak else None), "op3_cells", "none")
            common.drop(m.cells)
            m.cells = swept
            del swept
        if said is not None:
            common.drop(said)
            said = None
            common.tidy(train.sparkSession)
        if any_far:
            said = _exchange(m, not number)
            speak = not said.where("what = 0").isEmpty()
            any_far = speak or number > 0  # without a larger cell in a far context, nothing there ever changes
        state, served = _refreshed(m, state, served, rng)
        if number > burn:
            m.samples.append(state)
    if said is not None:
        common.drop(said)
    return m


def _known(spelling: Spelling):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                t, w = _as_words(b.column("word"))
                yield pa.RecordBatch.from_pydict({"h": pa.array(w.hash.view(np.int64)), "spell": pa.array(spelling(t.data, w.start, w.end).astype(np.float32))})

    return run


def _refreshed(m: Model, old: State, served: np.ndarray, rng: np.random.Generator) -> tuple[State, np.ndarray]:
    """The shared state after a sweep: totals, the heavy words' tables, parameters."""
    size, heavy = len(m.known.hash) + 1, m.known.heavy
    spell = m.known.spells[: heavy + 1].astype(np.float64)
    got = m.cells.mapInArrow(_totals(size, heavy), "slice int, n binary, t binary").groupBy("slice").applyInArrow(_add, "slice int, n binary, t binary").orderBy("slice").toArrow()
    n = [unpack(x, "<i8") for x in got["n"].to_pylist()]
    t = [unpack(x, "<i8") for x in got["t"].to_pylist()]
    square = (EXACT + 1) ** 2
    rest = n[SLICES] if n else np.zeros(2 * square + 2 + 2 * (heavy + 1), np.int64)
    s = State(old.d, old.theta, old.d0, old.theta0)
    s.n, s.t = (np.concatenate(x[:SLICES]) if n else np.zeros(size, np.int64) for x in (n, t))
    cells, words = rest[:square].reshape(EXACT + 1, -1), rest[square : 2 * square].reshape(EXACT + 1, -1)
    customers, tables = rest[2 * square : 2 * square + 2].tolist()
    mine, m.heavy_n = rest[2 * square + 2 :].reshape(-1, 2).T
    base = np.exp(spell)
    before = tables + int(np.minimum(served, mine).sum())
    served = draw(mine, (s.theta0 + s.d0 * np.maximum(before - served, 0)) * base, s.d0 * base, s.d0, rng)
    s.customers, s.tables = float(customers + mine.sum()), float(tables + served.sum())
    s.d, s.theta = resample(s.n, s.t, cells, s.d, s.theta, rng, m.far_n, m.far_t)
    s.d0, s.theta0 = resample(np.array([s.customers]), np.array([s.tables]), words + histogram(mine, served), s.d0, s.theta0, rng)
    s.heavy_p = (np.maximum(mine - s.d0 * served, 0) + (s.theta0 + s.d0 * s.tables) * base) / (s.theta0 + s.customers)
    return s, served


# -- scoring
#: Sums for the documents of a task (kind 0: rows, known tokens, base, score) and tokens whose context is not known to all (kind 1).
FOUND = "base long, rows binary, tokens binary, known binary, basis binary, score binary, far binary, far_row binary, far_times binary, far_seat binary, far_p binary"
FOUND_KINDS = {"rows": "<i8", "tokens": "<i8", "known": "<i8", "basis": "<f8", "score": "<f8", "far": "<u8", "far_row": "<i8", "far_times": "<i8", "far_seat": "<f8", "far_p": "<f8"}


def _score(m: Model):
    """A bucket's cells meet its tokens: one row of sums for each row that was sent."""
    samples = [replace(s, n=np.zeros(0), t=np.zeros(0)) for s in m.samples]
    norms = [(s.theta + s.n).astype(np.float32) for s in m.samples]
    shares = [s.share().astype(np.float32) for s in m.samples]
    total, types, heavy, heavy_n, spells = m.total, m.types, m.known.heavy, m.heavy_n, m.known.spells
    some = max(1, len(samples))

    def run(key: tuple, sent: pa.Table, cells: pa.Table) -> pa.Table:
        common.trim()
        rows = cells.to_pylist()
        c = {k: unpack(rows[0][k] if rows else b"", CELL_KINDS[k]) for k in SCORED}
        sizes = c["sizes"].astype(np.int64)
        first = np.cumsum(sizes) - sizes
        counts = np.add.reduceat(c["n"].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        of_word = c["p"].reshape(len(samples), -1) if len(first) else np.zeros((len(samples), 0))
        # Cells in order of (word, context), as numbers.
        u, number = np.unique(c["contexts"], return_inverse=True)
        cell = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) << np.uint64(32) | number.astype(np.uint64)
        out: list[dict] = []
        for r in sent.to_pylist():
            v = opened(r, spells)
            # The words, their counts in training, and their probability in each sample.
            k, hit = Known.find(c["words"], v["words"])
            is_heavy = v["words"] <= np.uint64(heavy)
            count = np.where(hit, counts[k], 0) if len(counts) else np.zeros(len(k), np.int64)
            count = np.where(is_heavy, heavy_n[np.where(is_heavy, v["words"], 0).astype(np.int64)], count)
            p = []
            for i, s in enumerate(samples):
                none = np.zeros(len(k))
                new = s.word_p(v["words"], none, none, v["spells"])
                p.append(np.where(hit & ~is_heavy, of_word[i][k], new) if len(counts) else new)
            basis = np.log10((count + 1.0) / (total + types + 1.0))
            # The cells.
            word = np.repeat(np.arange(len(k)), v["sizes"].astype(np.int64))
            x, there = Known.find(u, v["contexts"])
            at, found = Known.find(cell, k[word].astype(np.uint64) << np.uint64(32) | x.astype(np.uint64))
            found &= there & hit[word]
            n = np.where(found, c["n"][at], 0).astype(np.float64) if len(cell) else np.zeros(len(word))
            t = np.where(found, c["sum_t"][at], 0) / some if len(cell) else np.zeros(len(word))
            near = v["contexts"] < FAR
            context = np.where(near, v["contexts"], 0).astype(np.int64)
            score = np.zeros(len(word))
            for s, norm, share, q in zip(samples, norms, shares, p):
                score += (n - s.d * t) / norm[context] + share[context] * q[word]
            with np.errstate(divide="ignore"):
                score = np.where(near, v["times"] * np.log10(score / some), 0.0)
            text = v["texts"].astype(np.int64)
            hits = np.bincount(text)
            mine = np.flatnonzero(hits)
            sums = {"rows": r["base"] + mine, "tokens": np.bincount(text, v["times"])[mine], "known": np.bincount(text, v["times"] * (count > 0)[word])[mine], "basis": np.bincount(text, v["times"] * basis[word])[mine], "score": np.bincount(text, score)[mine]}
            far = np.flatnonzero(~near)
            d = np.mean([s.d for s in samples] or [0.0])
            sums |= {"far": v["contexts"][far], "far_row": r["base"] + text[far], "far_times": v["times"][far], "far_seat": n[far] - d * t[far], "far_p": np.mean([q[word[far]] for q in p], axis=0) if samples else n[far]}
            out.append({"base": r["base"]} | {k: pack(v.astype(FOUND_KINDS[k])) for k, v in sums.items()})
        return pa.table({"base": pa.array([r["base"] for r in out], pa.int64())} | {k: pa.array([r[k] for r in out], pa.binary()) for k in FOUND_KINDS})

    return run


def _near(key: tuple, group: pa.Table) -> pa.Table:
    """The documents that one task sent together: what all buckets say of them, added up."""
    common.trim()
    v = {k: np.concatenate([np.zeros(0, FOUND_KINDS[k]), *[unpack(x, FOUND_KINDS[k]) for x in group[k].to_pylist()]]) for k in ("rows", "tokens", "known", "basis", "score")}
    u, back = np.unique(v["rows"], return_inverse=True)
    return pa.table({"row": pa.array(u, pa.int64())} | {n: pa.array(np.bincount(back, v[k], len(u)).astype(np.int64)) for n, k in (("n_tokens", "tokens"), ("n_known", "known"))} | {"base": pa.array(np.bincount(back, v["basis"], len(u))), "score": pa.array(np.bincount(back, v["score"], len(u)))})


def _far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = {k: np.concatenate([np.zeros(0, FOUND_KINDS[k]), *[unpack(x, FOUND_KINDS[k]) for x in b.column(k).to_pylist()]]) for k in FOUND_KINDS if k.startswith("far")}
        yield pa.RecordBatch.from_pydict({"context": pa.array(v["far"].view(np.int64)), "row": pa.array(v["far_row"]), "times": pa.array(v["far_times"]), "seat": pa.array(v["far_seat"]), "p": pa.array(v["far_p"])})


def _far_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Customers and tables that a bucket holds of contexts that are not known to all."""
    for b in batches:
        for r in b.select(["contexts", "n", "sum_t"]).to_pylist():
            context, n, t = (unpack(r[k], CELL_KINDS[k]) for k in ("contexts", "n", "sum_t"))
            far = context >= FAR
            u, back = np.unique(context[far], return_inverse=True)
            yield pa.RecordBatch.from_pydict({"context": pa.array(u.view(np.int64)), "n": pa.array(np.bincount(back, n[far], len(u)).astype(np.int64)), "t": pa.array(np.bincount(back, t[far], len(u)).astype(np.int64))})


def score(docs: DataFrame, folds: int = FOLDS, fold: int = FOLD) -> DataFrame:
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    m = fit(base.where(common.fold("doc_id", folds) != fold).select("row", "text"))
    common.tidy(docs.sparkSession)
    rows = base.select("row", "doc_id")
    sent = base.select("row", "text").mapInArrow(_send(m.known, m.spelling, m.buckets, True), SENT)
    found = sent.groupBy("bucket").cogroup(m.cells.select("bucket", *SCORED).groupBy("bucket")).applyInArrow(_score(m), FOUND)
    found = common.stash(found, "op3_found", "none")
    del sent
    common.tidy(docs.sparkSession)
    near = found.select("base", "rows", "tokens", "known", "basis", "score").groupBy("base").applyInArrow(_near, "row long, n_tokens long, n_known long, base double, score double")
    samples = max(1, len(m.samples))
    d, theta = (float(np.mean([getattr(s, k) for s in m.samples] or [1.0])) for k in ("d", "theta"))
    far = m.cells.select("contexts", "n", "sum_t").mapInArrow(_far_contexts, "context long, n long, t long").groupBy("context").agg(F.sum("n").alias("n"), (F.sum("t") / samples).alias("t"))
    far = found.select(*[k for k in FOUND_KINDS if k.startswith("far")]).mapInArrow(_far, "context long, row long, times long, seat double, p double").join(far, "context", "left")
    n, t = F.coalesce("n", F.lit(0)), F.coalesce("t", F.lit(0.0))
    p = (F.col("seat") + (theta + d * t) * F.col("p")) / (theta + n)
    far = far.select("row", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base"), (F.col("times") * F.log10(p)).alias("score"))
    sums = near.unionByName(far).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    return rows.join(sums, "row").select("doc_id", (common.fold("doc_id", folds) == fold).alias("held_out"), "n_tokens", "n_known", F.lit(m.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
