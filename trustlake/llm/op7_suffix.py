"""Operator 7: removal of byte strings that repeat across documents, by rank doubling over sampled suffixes.

Positions are ranked by what follows them and reranked at growing lengths; a
position whose rank is unique leaves, the rest go on until the threshold of 50
bytes is passed. Three things keep this within bounds:

* Only *anchors* are ranked: positions whose 24-byte string has the least hash
  among the 27 such strings of some 50-byte string. Every 50-byte string holds an
  anchor at the same place wherever it stands, so nothing is missed.
* Round one ranks the 24 bytes at each anchor. A block of documents sends each
  distinct rank once to the bucket the rank belongs to, where ranks are sorted;
  back comes one bit a rank: unique, or not.
* Round two takes the anchors left and ranks every 50-byte string around them,
  from the 76 bytes that can hold one. Equal surroundings of a block are sent
  once, with the smallest doc_id; back come 27 bits, one a string: does it start
  in a smaller document.

Texts that equal a smaller document's are settled first and take no part.

Cases. Null text is empty; texts under 50 bytes lose nothing. Rows that share a
doc_id are never smaller than each other. Matches never cross documents. Repeated
passages inside one document stay, unless a smaller document has them. An empty
table gives no rows. A doc_id that is null is taken as larger than all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

LENGTH = 50
GRAM = 24
SPAN = LENGTH - GRAM + 1  # grams in a string of LENGTH bytes, and strings that hold a given gram
AROUND = LENGTH + SPAN - 1
#: Texts of a block; a text of more bytes than LONG is a block of its own. Bytes are read SEGMENT by SEGMENT.
BLOCK, LONG, SEGMENT = 512, 65_536, 1_000_000
#: The strings around an anchor that more blocks hold are settled one by one.
HOT = 64
#: Bytes of ranks a bucket of round one holds, and of surroundings in round two, about.
BUCKET = 4_000_000
BROADCAST_ROWS = 200_000
LAST = (1 << 63) - 1
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _slide(v: np.ndarray, w: int, op) -> np.ndarray:
    """op over v[i:i + w] for each i."""
    k = 1
    while 2 * k <= w:
        v = op(v[:-k], v[k:])
        k *= 2
    return op(v[: len(v) - (w - k)], v[w - k :]) if w > k else v


class Anchors:
    """Anchors of a run of texts: their places, documents, ranks (hashes of 24 bytes), and what surrounds them. Memory grows with their number, not with the bytes: those are read in segments."""

    def __init__(self, t: tokens.Texts) -> None:
        self.t = t
        parts = [self._segment(t, lo, min(lo + SEGMENT, len(t.data))) for lo in range(0, len(t.data), SEGMENT)] or [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        self.at, self.rank, self.doc, self.full = (np.concatenate([x[k] for x in parts]) for k in range(4))
        self.lo = np.minimum(SPAN - 1, self.at - t.offsets[self.doc])
        self.hi = np.minimum(LENGTH, t.offsets[self.doc + 1] - self.at)

    @staticmethod
    def _segment(t: tokens.Texts, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """Anchors at places from lo to hi, found from the bytes of all strings that can hold them."""
        a, z = max(0, lo - (SPAN - 1)), min(len(t.data), hi + LENGTH)
        first = np.searchsorted(t.offsets, a, side="right") - 1
        offsets = np.clip(t.offsets[first : np.searchsorted(t.offsets, z) + 1], a, z) - a
        stop = np.repeat(offsets[1:], np.diff(offsets))
        prefix = tokens.prefix_hash(t.data[a:z])
        if z - a < LENGTH:
            at, v = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        else:
            i = np.arange(z - a - GRAM + 1)
            v = tokens.span_hash(prefix, i, i + GRAM)
            v[i + GRAM > stop[: len(i)]] = _NONE
            least = _slide(v, SPAN, np.minimum)
            least[np.arange(LENGTH, LENGTH + len(least)) > stop[: len(least)]] = 0
            padded = np.zeros(len(v) + SPAN - 1, np.uint64)
            padded[SPAN - 1 : SPAN - 1 + len(least)] = least
            at = np.flatnonzero(_slide(padded, SPAN, np.maximum) == v)
            # A place past the last string of its document has no string of its own.
            at = at[(v[at] != _NONE) & (at >= lo - a) & (at < hi - a)]
        # Anchors are the least of their neighbours: mixed once more, their ranks spread evenly over the buckets.
        rank = tokens.mix(v[at])
        doc = np.searchsorted(t.offsets, at + a, side="right") - 1
        before, after = np.minimum(SPAN - 1, at + a - t.offsets[doc]), np.minimum(LENGTH, t.offsets[doc + 1] - at - a)
        full = tokens.span_hash(prefix, at - before, at + after) * np.uint64(0xC2B2AE3D27D4EB4F) + (before * 64 + after).astype(np.uint64)
        return at + a, rank, doc, full

    def keys(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct ranks in order, their buckets, and for each anchor its rank's place."""
        u, back = np.unique(self.rank, return_inverse=True)
        return u, _bucket(u, buckets), back

    def shared_inside(self, u: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Ranks that two documents of this block hold."""
        low, high = np.full(len(u), len(self.t)), np.full(len(u), -1)
        np.minimum.at(low, back, self.doc)
        np.maximum.at(high, back, self.doc)
        return low < high


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _block(t: pa.Table) -> tuple[tokens.Texts, np.ndarray, pa.Table]:
    """A block's rows in a fixed order, as one run of texts."""
    t = t.sort_by([("row", "ascending")]).combine_chunks()
    column = t["text"].combine_chunks() if isinstance(t["text"], pa.ChunkedArray) else t["text"]
    run = next(iter(tokens.chunks(column, 1 << 40)), tokens.Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64), 0))
    return run, t["order"].to_numpy().astype(np.int64), t


def _parts(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, places) of a sorted array of buckets."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]])):
        if hi > lo:
            yield int(bucket[lo]), slice(int(lo), int(hi))


def _round_one(buckets: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()

        def out(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            a = Anchors(_block(pa.Table.from_batches(held))[0])
            u, bucket, _ = a.keys(buckets)
            raw = u.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            rows = [(b, raw[part].tobytes()) for b, part in _parts(bucket)]
            return pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int64()), "ranks": pa.array([r[1] for r in rows], pa.binary())})

        # Long texts are blocks of their own and stand among the rows of others.
        held: dict[int, list[pa.RecordBatch]] = {}
        for b in batches:
            blocks = b.column("block").to_numpy()
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(blocks)]])):
                if hi == lo:
                    continue
                block = int(blocks[lo])
                if block >= 0:
                    for done in [k for k in held if k != block]:
                        yield out(done, held.pop(done))
                    held.setdefault(block, []).append(b.slice(int(lo), int(hi - lo)))
                else:
                    yield out(block, [b.slice(int(lo), int(hi - lo))])
        for block in list(held):
            yield out(block, held.pop(block))

    return emit


def _low48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _answer_one(hot: int):
    """One bucket of round one: for each block, two bits for each of its ranks: another block has it, and more than ``hot`` blocks do."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        common.trim()
        group = group.sort_by("block")
        ranks = [_low48(x) for x in group["ranks"].to_pylist()]
        # One sort for all blocks: equal ranks stand side by side.
        every = np.concatenate(ranks)
        by = np.argsort(every)
        head = np.flatnonzero(np.concatenate([[True], every[by][1:] != every[by][:-1]])) if len(by) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(by)))
        blocks = np.empty(len(by), np.int64)
        blocks[by] = np.repeat(size, size)
        cuts = np.cumsum([len(r) for r in ranks])[:-1]
        bits = [np.packbits(np.concatenate([x > 1, x > hot])).tobytes() for x in np.split(blocks, cuts)]
        return pa.table({"block": group["block"], "kind": pa.array([1] * len(bits), pa.int32()), "bucket": group["bucket"], "bits": pa.array(bits, pa.binary())})

    return run


def windows(around: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(j, surroundings that hold a whole string from their j-th byte on, its hash), for each j."""
    prefix = np.zeros((len(around), AROUND + 1), np.uint64)
    np.cumsum(tokens._VALUES[around] * tokens.powers(AROUND + 1)[0][:AROUND], axis=1, dtype=np.uint64, out=prefix[:, 1:])
    for j in range(SPAN):
        ok = np.flatnonzero((j >= SPAN - 1 - lo) & (j + LENGTH <= SPAN - 1 + hi))
        if len(ok):
            yield j, ok, tokens.mix((prefix[ok, j + LENGTH] - prefix[ok, j]) * tokens.powers(AROUND + 1)[1][j])


class Left:
    """What round one leaves of a block: anchors that are not unique.

    Equal surroundings are settled together. Those of a rank that very many blocks
    hold would all meet in one bucket; such an anchor's strings go one by one, to
    the bucket of the string: where a passage begins and ends its surroundings
    differ from document to document, its strings don't.
    """

    def __init__(self, t: tokens.Texts, order: np.ndarray, bits: dict[int, bytes], buckets: int, buckets2: int) -> None:
        a = Anchors(t)
        u, bucket, back = a.keys(buckets)
        keep, hot = a.shared_inside(u, back), np.zeros(len(u), bool)
        for b, part in _parts(bucket):
            n = part.stop - part.start
            got = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=2 * n).astype(bool)
            keep[part] |= got[:n]
            hot[part] = got[n:]
        self.t, self.block_order = t, order
        pick = np.flatnonzero((keep & ~hot)[back])
        self.at, self.doc, self.lo, self.hi = a.at[pick], a.doc[pick], a.lo[pick], a.hi[pick]
        full, rank = a.full[pick], a.rank[pick]
        self.order = order[self.doc]
        # Distinct surroundings, by bucket of their rank; the first of each has the smallest document.
        where = _bucket(rank, buckets2)
        by = np.lexsort((self.at, self.order, full, rank, where))
        new = np.ones(len(by), bool)
        new[1:] = (full[by][1:] != full[by][:-1]) | (rank[by][1:] != rank[by][:-1])
        self.first = by[new]
        self.of = np.empty(len(by), np.int64)
        self.of[by] = np.cumsum(new) - 1
        self.rank, self.bucket = rank[self.first], where[self.first]
        self._hot(a, np.flatnonzero(hot[back]), buckets2)

    def around(self, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        place = (at - (SPAN - 1))[:, None] + np.arange(AROUND)
        inside = (np.arange(AROUND) >= (SPAN - 1 - lo)[:, None]) & (np.arange(AROUND) < (SPAN - 1 + hi)[:, None])
        return np.where(inside, self.t.data[np.clip(place, 0, max(0, len(self.t.data) - 1))], 0).astype(np.uint8) if len(at) else np.zeros((0, AROUND), np.uint8)

    def _hot(self, a: Anchors, pick: np.ndarray, buckets2: int) -> None:
        start, h = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for k in range(0, len(pick), 20_000):
            p = pick[k : k + 20_000]
            for j, ok, hashes in windows(self.around(a.at[p], a.lo[p], a.hi[p]), a.lo[p], a.hi[p]):
                start.append(a.at[p][ok] - (SPAN - 1) + j)
                h.append(hashes)
        # A string may stand around several anchors.
        self.hot_start, one = np.unique(np.concatenate(start), return_index=True)
        h = np.concatenate(h)[one]
        self.hot_order = self.block_order[np.searchsorted(self.t.offsets, self.hot_start, side="right") - 1]
        where = _bucket(h, buckets2)
        by = np.lexsort((self.hot_order, h, where))
        new = np.ones(len(by), bool)
        new[1:] = h[by][1:] != h[by][:-1]
        first = by[new]
        self.hot_of = np.empty(len(by), np.int64)
        self.hot_of[by] = np.cumsum(new) - 1
        self.hot, self.hot_bucket, self.hot_least = h[first], where[first], self.hot_order[first]


def _round_two(buckets: int, buckets2: int):
    def run(key: tuple, texts: pa.Table, info: pa.Table) -> pa.Table:
        common.trim()
        rows: list[tuple] = []
        if texts.num_rows:
            t, order, _ = _block(texts)
            left = Left(t, order, dict(zip(info["bucket"].to_pylist(), info["bits"].to_pylist())), buckets, buckets2)
            f = left.first
            lo, hi = left.lo[f], left.hi[f]
            around = left.around(left.at[f], lo, hi)
            for b, part in _parts(left.bucket):
                rows.append((b, left.rank[part].astype("<u8").tobytes(), around[part].tobytes(), lo[part].astype(np.uint8).tobytes(), hi[part].astype(np.uint8).tobytes(), left.order[f[part]].astype("<i8").tobytes()))
            for b, part in _parts(left.hot_bucket):
                rows.append((b, left.hot[part].astype("<u8").tobytes(), None, None, None, left.hot_least[part].astype("<i8").tobytes()))
        kinds = [pa.int32()] + [pa.binary()] * 5
        out = {k: pa.array([r[i] for r in rows], kinds[i]) for i, k in enumerate(("bucket", "ranks", "around", "lo", "hi", "orders"))}
        return pa.table({"block": pa.array([key[0].as_py()] * len(rows), pa.int64()), **out})

    return run


def _smaller(h: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Entries whose hash some entry with a smaller order has."""
    by = np.lexsort((order, h))
    heads = np.flatnonzero(np.concatenate([[True], h[by][1:] != h[by][:-1]])) if len(by) else np.zeros(0, np.int64)
    out = np.empty(len(by), bool)
    out[by] = np.repeat(order[by[heads]], np.diff(np.append(heads, len(by)))) < order[by]
    return out


def _answer_two(key: tuple, group: pa.Table) -> pa.Table:
    """One bucket of round two: for each block, 27 bits for each of its surroundings (kind 2), and one for each single string (kind 3)."""
    common.trim()
    group = group.sort_by("block")
    single = np.array(group["around"].is_null())
    out: list[tuple] = []
    for kind, part in ((2, group.filter(pa.array(~single))), (3, group.filter(pa.array(single)))):
        if not part.num_rows:
            continue
        get = lambda name, form: np.concatenate([np.frombuffer(x, form) for x in part[name].to_pylist()])  # noqa: B023, E731
        rank, order = get("ranks", "<u8"), get("orders", "<i8")
        if kind == 3:
            bits = _smaller(rank, order).astype(np.int32)
        else:
            lo, hi, around = get("lo", np.uint8).astype(np.int64), get("hi", np.uint8).astype(np.int64), get("around", np.uint8).reshape(-1, AROUND)
            bits = np.zeros(len(rank), np.int32)
            _, same, many = np.unique(rank, return_inverse=True, return_counts=True)
            live = np.flatnonzero(many[same] > 1)
            for j, ok, h in windows(around[live], lo[live], hi[live]):
                at = live[ok]
                bits[at] |= _smaller(tokens.mix(h ^ tokens.mix(rank[at])), order[at]).astype(np.int32) << j
        cuts = np.cumsum([len(x) // 8 for x in part["ranks"].to_pylist()])[:-1]
        out += [(b, kind, k, x.astype("<i4").tobytes()) for b, k, x in zip(part["block"].to_pylist(), part["bucket"].to_pylist(), np.split(bits, cuts))]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.table({c: pa.array([r[i] for r in out], kinds[i]) for i, c in enumerate(("block", "kind", "bucket", "bits"))})


def covered(left: Left, bits: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    """Bytes that a repeated string covers."""
    # A document after the first of its block with the same surroundings repeats every string of them.
    all_bits = (1 << SPAN) - 1
    own = np.where(left.order > left.order[left.first][left.of], all_bits, bits[left.of]) if len(left.at) else np.zeros(0, np.int64)
    starts = [left.hot_start[(left.hot_order > left.hot_least[left.hot_of]) | (hot[left.hot_of] > 0)] if len(left.hot_start) else np.zeros(0, np.int64)]
    for j in range(SPAN):
        hit = (own >> j & 1).astype(bool) & (j >= SPAN - 1 - left.lo) & (j + LENGTH <= SPAN - 1 + left.hi)
        starts.append(left.at[hit] - (SPAN - 1) + j)
    gone = np.zeros(n, bool)
    s = np.unique(np.concatenate(starts))
    heads = np.flatnonzero(np.concatenate([[True], np.diff(s) > LENGTH])) if len(s) else np.zeros(0, np.int64)
    for a, z in zip(s[heads].tolist(), s[np.append(heads[1:], len(s)) - 1].tolist() if len(s) else []):
        gone[a : z + LENGTH] = True
    return gone


def whole_characters(t: tokens.Texts, gone: np.ndarray) -> np.ndarray:
    """Bytes to remove so that no UTF-8 character is cut in two."""
    begin = (t.data & 0xC0) != 0x80
    begin[t.offsets[:-1][np.diff(t.offsets) > 0]] = True
    character = np.cumsum(begin) - 1
    return (np.bincount(character, gone, int(begin.sum())) > 0)[character] if len(gone) else gone


def _apply(buckets: int, buckets2: int, names: list[str], characters: bool):
    def run(key: tuple, texts: pa.Table, info: pa.Table) -> pa.Table:
        common.trim()
        t, order, rows = _block(texts)
        got = list(zip(info["kind"].to_pylist(), info["bucket"].to_pylist(), info["bits"].to_pylist()))
        left = Left(t, order, {b: x for k, b, x in got if k == 1}, buckets, buckets2)
        two, three = ({b: x for k, b, x in got if k == kind} for kind in (2, 3))
        bits, hot = (np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(found[b], "<i4") for b, _ in _parts(buckets_)]]) for found, buckets_ in ((two, left.bucket), (three, left.hot_bucket)))
        gone = covered(left, bits, hot, len(t.data))
        inside = np.concatenate([[False], gone, [False]])
        edge = np.zeros(len(t.data) + 1, bool)
        edge[t.offsets] = True
        begin = np.flatnonzero(gone & (~inside[:-2] | edge[:-1]))
        end = np.flatnonzero(gone & (~inside[2:] | edge[1:])) + 1
        first = np.searchsorted(begin, t.offsets)
        base = np.repeat(t.offsets[:-1], np.diff(first))
        spans = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], ["start", "end"]))
        gone = whole_characters(t, gone) if characters else gone
        kept = np.concatenate([[0], np.cumsum(~gone)])[t.offsets]
        text = pa.Array.from_buffers(pa.string() if characters else pa.binary(), len(t), [None, pa.py_buffer(kept.astype(np.int32)), pa.py_buffer(t.data[~gone].tobytes())])
        return pa.table({**{k: rows[k] for k in names}, "n_bytes": pa.array(np.diff(t.offsets)), "kept": text, "spans": spans})

    return run


def dedup(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), scanned: bool = True, hot: int = HOT, characters: bool = False) -> DataFrame:
    """Columns ``carry`` of each row, its n_bytes, spans (removed byte ranges) and kept (remaining bytes).

    ``scanned``: ``docs`` reads files, so its rows come in the same order each
    time. Otherwise they are written first. ``characters``: kept is text, without the
    characters of which a byte was removed; spans tell of bytes as ever.
    """
    if not scanned:
        docs = common.stash(docs, "op7_docs")
    t = common.TMP
    own = [F.col(c).alias(f"{t}c{i}") for i, c in enumerate(carry)]
    names = [f"{t}c{i}" for i in range(len(carry))]
    at = F.monotonically_increasing_id()
    base = docs.select(*own, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("order"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), at.alias("row"))
    base = base.withColumn("block", F.when(F.length("text") > LONG, -1 - F.col("row")).otherwise(F.floor(F.col("row") / BLOCK)).cast("long")).withColumn("sha", F.sha2("text", 256))
    copies = base.groupBy("sha").agg(F.min("order").alias("least"), F.max("order").alias("most"), F.sum(F.length("text")).alias("n")).where("least < most and n >= 100")
    copies = common.stash(copies.select("sha", "least"), "op7_copies")
    few = copies.count() <= BROADCAST_ROWS
    marked = base.join(F.broadcast(copies) if few else copies, "sha", "left").withColumn("copy", F.coalesce((F.col("order") > F.col("least")) & (F.length("text") >= LENGTH), F.lit(False)))
    whole = marked.where("copy").select(*names, F.length("text").cast("long").alias("n_bytes"), (F.lit("") if characters else F.lit(b"")).alias("kept"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"))).alias("spans"))
    rest = marked.where("not copy").select(*names, "order", "text", "row", "block")
    size = base.agg(F.sum(F.length("text").cast("long")).alias("n")).first()["n"] or 0
    buckets = max(4, math.ceil(size * 2 / (SPAN + 1) * 6 / BUCKET))
    # Blocks lie together in their scan task, so round one moves no text. A shuffled ``rest`` is put in order first.
    lined = rest.select("order", "text", "row", "block")
    lined = lined if few else lined.repartition("block").sortWithinPartitions("block", "row")
    sent = lined.mapInArrow(_round_one(buckets), "bucket int, block long, ranks binary")
    info = "block long, kind int, bucket int, bits binary"
    one = common.stash(sent.groupBy("bucket").applyInArrow(_answer_one(hot), info), "op7_one")
    buckets2 = max(4, math.ceil(size * 0.02 * 100 / BUCKET))
    texts = rest.select("order", "text", "row", "block").groupBy("block")
    around = texts.cogroup(one.groupBy("block")).applyInArrow(_round_two(buckets, buckets2), "block long, bucket int, ranks binary, around binary, lo binary, hi binary, orders binary")
    two = common.stash(around.groupBy("bucket").applyInArrow(_answer_two, info), "op7_two")
    both = one.unionByName(two).groupBy("block")
    kinds = ", ".join(f"{n} {rest.schema[n].dataType.simpleString()}" for n in names)
    done = rest.groupBy("block").cogroup(both).applyInArrow(_apply(buckets, buckets2, names, characters), f"{kinds}, n_bytes long, kept {'string' if characters else 'binary'}, spans array<struct<start:long,end:long>>")
    return done.unionByName(whole).select(*[F.col(f"{t}c{i}").alias(c) for i, c in enumerate(carry)], "n_bytes", "kept", "spans")


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup(common.table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
