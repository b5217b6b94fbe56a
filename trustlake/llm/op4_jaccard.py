"""Operator 4: n-gram Jaccard join through a token-group matrix.

Documents with equal shingle sets are one node. Tokens (hashed shingles) have one
global order in each step; a node of n tokens that needs t = ceil(0.75 n) common
ones *shows* its first n - t + l of them, and two nodes that link share at least l
of what they show (l = 1 + n / 16, n being the smaller one's size). Any order is
exact; what it costs depends on the order.

1. Nodes show tokens in the order of their hashes, in packed buckets. A node of
   which other nodes show too few links with nothing and is out.
2. The tokens of those left are counted exactly, all of them. A node needs t tokens
   that others hold too; the new order is by rising frequency.
3. Similar nodes are partitioned into groups: nodes with the same most frequent
   token are dealt to blocks of bounded size, members are compared exactly with the
   leader of all blocks and a few of their own, and what links is a component. A
   component of more than a block's size is a group of its own; the others of a
   block are one group together, linked or not.
4. The matrix stores each group's union of shown tokens. A query node's overlap
   with a group is bounded by the tokens that another component of the group shows;
   only groups that reach the needed overlap are opened.
5. Opened groups are compared with their queries exactly, inside tasks of bounded
   size; out come the links between components, whose components are the result.

Neither step 3's leaders nor the grouping can lose a link: they decide only what
step 5 need not look at, pairs of one component.

Cases. Null or empty texts, or texts without words, have no shingles and no
links. Fewer than five words: the sequence is the one shingle. Rows that share a
doc_id are separate documents with the same name; a null doc_id takes part, and is
the component's only if no row of it has another. Equal sets are linked.
Repeated rows return repeated rows. An empty table gives no rows. Only ``doc_id``
and ``text`` are read, more than once: ``docs`` must give its rows in the same order
each time, as a scan of files does (else this raises).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles, tokens
from .components import components

WORDS = 5
PERCENT = 75
#: Members of a block, and tokens of a block, about.
BLOCK, BLOCK_TOKENS = 512, 400_000
#: Queries that a block is compared with in one go.
QUERIES = 1024
#: Leaders that a block chooses itself.
LEADERS = 8
#: Bytes of a bucket, about; pairs that a task gathers before it sends them.
BUCKET, GATHER = 8_000_000, 500_000
#: Up to this many row numbers are sent to the texts; beyond, texts are shuffled to them.
BROADCAST_ROWS = 400_000

ORACLE_SQL = None  # set below


def needed(n, percent: int = PERCENT):
    """Common tokens that a set of n needs at least: ceil(percent / 100 * n) (numbers or arrays)."""
    return -(-percent * n // 100)


def depth(n):
    """Tokens that two linked sets share at least of what they show, n being the smaller one's size."""
    return 1 + n // 16


def _depth(n: Column) -> Column:
    return 1 + F.floor(n / 16)


def _least_partner(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / 100)


def node_of(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _short(node: bytes) -> int:
    """48 bits of a node, for counts of what others show."""
    return int.from_bytes(node[:6], "little")


def _rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        for b in batches:
            for t in tokens.chunks(b.column("text"), 1_000_000):
                sets = list(shingles.sets(t, words))
                node = [node_of(s) for s in sets]
                short = [None if x is None else _short(x) for x in node]
                yield pa.RecordBatch.from_pydict({"row": b.column("row").slice(t.row, len(t)), "doc_id": b.column("doc_id").slice(t.row, len(t)), "n": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array(node, pa.binary()), "short": pa.array(short, pa.int64())})

    return run


def _narrow(x: np.ndarray) -> bytes:
    """Numbers below 2^48, six bytes each."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _wide(raw: list[bytes]) -> np.ndarray:
    out = np.zeros((sum(map(len, raw)) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _runs(x: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(value, places) of the runs of equal values."""
    cuts = np.flatnonzero(np.diff(x)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(x)]):
        if hi > lo:
            yield int(x[lo]), slice(lo, hi)


def _bucket(t: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Bucket of evenly spread numbers below 2^bits, in their order."""
    return ((t >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _new(*columns: np.ndarray) -> np.ndarray:
    """Rows that differ from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def _show(words: int, percent: int, buckets: int):
    """What each distinct set shows in hash order: (token, node) packed by bucket of the token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        many = 0

        def out() -> Iterator[pa.RecordBatch]:
            t, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            by = np.lexsort((n, t))
            t, n = t[by], n[by]
            new = _new(t, n)
            t, n = t[new], n[new]
            rows = [(b, _narrow(t[part]), _narrow(n[part])) for b, part in _runs(_bucket(t, 48, buckets))]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32()), "tokens": pa.array([r[1] for r in rows], pa.binary()), "nodes": pa.array([r[2] for r in rows], pa.binary())})

        for b in batches:
            for t in tokens.chunks(b.column("text"), 1_000_000):
                for s in shingles.sets(t, words):
                    if n := len(s):
                        shown = tokens.mix(s[: min(n, n - needed(n, percent) + depth(n))]) >> np.uint64(16)
                        held.append((shown, np.full(len(shown), _short(node_of(s)), np.uint64)))
                        many += len(shown)
                if many > GATHER:
                    yield from out()
                    held, many = [], 0
        if held:
            yield from out()

    return run


def _shared(parts: int):
    """One bucket: how many of the tokens that a node shows there another node shows too, packed by part of the node."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        common.trim()
        t, n = _wide(group["tokens"].to_pylist()), _wide(group["nodes"].to_pylist())
        by = np.lexsort((n, t))
        t, n = t[by], n[by]
        new = _new(t, n)
        t, n = t[new], n[new]
        head = np.flatnonzero(_new(t))
        size = np.diff(np.append(head, len(t)))
        u, c = np.unique(n[np.repeat(size > 1, size)], return_counts=True)
        part = (u % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        u, c = u[by], c[by]
        rows = [(k, _narrow(u[at]), c[at].astype("<u4").tobytes()) for k, at in _runs(part[by])]
        kinds = (pa.int32(), pa.binary(), pa.binary())
        return pa.table({name: pa.array([r[i] for r in rows], kinds[i]) for i, name in enumerate(("part", "nodes", "counts"))})

    return run


def _met(key: tuple, group: pa.Table) -> pa.Table:
    """The nodes of a part, with the tokens of all buckets together that others show too."""
    common.trim()
    n, c = _wide(group["nodes"].to_pylist()), _numbers(group["counts"], "<u4")
    u, back = np.unique(n, return_inverse=True)
    return pa.table({"short": pa.array(u.astype(np.int64)), "c": pa.array(np.bincount(back, c, len(u)).astype(np.int64))})


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        for b in batches:
            node = b.column("node").to_pylist()
            for t in tokens.chunks(b.column("text"), 1_000_000):
                sets = list(shingles.sets(t, words))
                own = node[t.row : t.row + len(t)]
                if [node_of(s) for s in sets] != own:
                    raise RuntimeError("rows came in another order than before; write them to files first")
                yield pa.RecordBatch.from_pydict({"node": pa.array(own, pa.binary()), "n": pa.array([len(s) for s in sets], pa.int64()), "tokens": pa.array([s.tobytes() for s in sets], pa.binary())})

    return run


def _numbers(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _spread(buckets: int):
    """Tokens of whole sets, by bucket of the token; a node's tokens side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.cumsum(b.column("n").to_numpy())
            for _, at in _runs(sizes // GATHER):
                part = b.slice(at.start, at.stop - at.start)
                t = _numbers(part.column("tokens"), "<u8")
                node = np.repeat(part.column("id").to_numpy(), part.column("n").to_numpy())
                bucket = _bucket(t, 64, buckets)
                by = np.lexsort((node, bucket))
                t, node, rows = t[by], node[by], []
                for k, at in _runs(bucket[by]):
                    own, size = np.unique(node[at], return_counts=True)
                    rows.append((k, own.tobytes(), size.astype("<u4").tobytes(), t[at].tobytes()))
                kinds = [pa.int32()] + [pa.binary()] * 3
                yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], kinds[i]) for i, c in enumerate(("bucket", "ids", "sizes", "tokens"))})

    return run


def _levels(parts: int):
    """One bucket: the tokens that two nodes or more hold, with their level (2048 times the logarithm of the frequency), back to the nodes."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        common.trim()
        node = np.repeat(_numbers(group["ids"], "<i8"), _numbers(group["sizes"], "<u4"))
        t = _numbers(group["tokens"], "<u8")
        u, back, c = np.unique(t, return_inverse=True, return_counts=True)
        many = c[back] > 1
        node, t, level = node[many], t[many], np.round(2048 * np.log2(c[back][many])).astype("<u2")
        part = node % parts
        by = np.argsort(part, kind="stable")
        node, t, level = node[by], t[by], level[by]
        rows = [(k, node[at].tobytes(), t[at].tobytes(), level[at].tobytes()) for k, at in _runs(part[by])]
        kinds = [pa.int64()] + [pa.binary()] * 3
        return pa.table({c: pa.array([r[i] for r in rows], kinds[i]) for i, c in enumerate(("part", "ids", "tokens", "levels"))})

    return run


def _arrange(percent: int):
    """Nodes that enough others meet: (id, n, most frequent token, mean level, shown tokens that others hold)."""

    def run(key: tuple, nodes: pa.Table, found: pa.Table) -> pa.Table:
        common.trim()
        node, t, level = _numbers(found["ids"], "<i8"), _numbers(found["tokens"], "<u8"), _numbers(found["levels"], "<u2")
        by = np.lexsort((t, level, node))
        node, t, level = node[by], t[by], level[by]
        size = dict(zip(nodes["id"].to_pylist(), nodes["n"].to_pylist()))
        rows = []
        for k, at in _runs(node):
            n, many = size[k], at.stop - at.start
            need = needed(n, percent)
            if many >= need:
                shown = t[at][: min(many, many - need + depth(n))]
                rows.append((k, n, int(t[at.stop - 1].view(np.int64)), float(level[at].sum()) / n, shown.view(np.int64)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
        return pa.table({c: pa.array([r[i] for r in rows], kinds[i]) for i, c in enumerate(("id", "n", "top", "weight", "shown"))})

    return run


class Members:
    """Sets side by side, to be compared with one set at a time."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]) -> None:
        self.ids, self.sets = np.array(ids, np.int64), sets
        self.n = np.array([len(s) for s in sets], np.int64)
        t = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        by = np.argsort(t, kind="stable")
        self.token, self.member = t[by], np.repeat(np.arange(len(sets)), self.n)[by]

    def linked(self, s: np.ndarray, percent: int) -> np.ndarray:
        """Members that link with s."""
        lo, hi = np.searchsorted(self.token, s, "left"), np.searchsorted(self.token, s, "right")
        many = hi - lo
        at = np.arange(many.sum()) + np.repeat(lo - (np.cumsum(many) - many), many)
        both = np.bincount(self.member[at], minlength=len(self.n))
        return np.flatnonzero((100 * both >= percent * (len(s) + self.n - both)) & (both > 0))


def _star(percent: int):
    """Blocks: each member gets the component of the leader that it links with, the leader of all blocks first."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        common.trim()
        group = group.sort_by([("top", "ascending"), ("block", "ascending"), ("leads", "descending"), ("weight", "descending"), ("id", "ascending")])
        top, block, ids, leads = (group[c].to_numpy() for c in ("top", "block", "id", "leads"))
        raw = group["tokens"].to_pylist()
        out_id, out_comp = [], []
        for _, a in _runs(top):
            for _, b in _runs(block[a]):
                at = range(a.start + b.start, a.start + b.stop)
                sets = [np.frombuffer(raw[i], "<u8") for i in at]
                # The leader of all blocks comes first, and once more as a member in its own block.
                mine = [k for k, i in enumerate(at) if not leads[i]]
                m = Members([int(ids[i]) for i in at if not leads[i]], [sets[k] for k in mine])
                comp = np.full(len(mine), -1, np.int64)
                for k, i in enumerate(at):
                    if leads[i]:
                        comp[m.linked(sets[k], percent)] = ids[i]
                for _ in range(LEADERS):
                    free = np.flatnonzero(comp < 0)
                    if not len(free):
                        break
                    hit = m.linked(m.sets[free[0]], percent)
                    comp[hit[comp[hit] < 0]] = m.ids[free[0]]
                out_id.append(m.ids)
                out_comp.append(np.where(comp < 0, m.ids, comp))
        none = np.zeros(0, np.int64)
        return pa.table({"id": np.concatenate([none, *out_id]), "comp": np.concatenate([none, *out_comp])})

    return run


def _open(percent: int):
    """Queries against the members of an opened group: the components that link with theirs."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        common.trim()
        group = group.sort_by([("grp", "ascending"), ("mpart", "ascending"), ("qpart", "ascending"), ("asks", "ascending"), ("id", "ascending")])
        grp, mpart, qpart, asks, ids, comp = (group[c].to_numpy() for c in ("grp", "mpart", "qpart", "asks", "id", "comp"))
        raw, found = group["tokens"].to_pylist(), set()
        cuts = np.flatnonzero(_new(grp, mpart, qpart)).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(grp)]):
            m = [i for i in range(lo, hi) if not asks[i]]
            members = Members([int(ids[i]) for i in m], [np.frombuffer(raw[i], "<u8") for i in m])
            its = comp[m]
            for i in range(lo, hi):
                if asks[i]:
                    for c in np.unique(its[members.linked(np.frombuffer(raw[i], "<u8"), percent)]).tolist():
                        if c != comp[i]:
                            found.add((min(c, int(comp[i])), max(c, int(comp[i]))))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return run


def _bins(size: int | None) -> int:
    return max(1, math.ceil((size or 0) / BUCKET))


class Join:
    def __init__(self, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> None:
        self.words, self.percent = words, percent
        self.texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
        kind = docs.schema["doc_id"].dataType.simpleString()
        self.rows = common.stash(self.texts.mapInArrow(_rows(words), f"row long, doc_id {kind}, n long, node binary, short long"), "op4_rows")
        self.nodes = common.stash(self.rows.where("node is not null").groupBy("node").agg(F.min("n").alias("n"), F.min("short").alias("short"), F.min("row").alias("row")), "op4_nodes")

    def live(self) -> DataFrame:
        """(id, node, n, tokens) of the nodes that may link by what they show in hash order."""
        total = self.rows.agg(F.sum("n").alias("n")).first()["n"] or 0
        sent = self.texts.select("text").mapInArrow(_show(self.words, self.percent, _bins(total * 4)), "bucket int, tokens binary, nodes binary")
        met = sent.groupBy("bucket").applyInArrow(_shared(_bins(total)), "part int, nodes binary, counts binary")
        met = met.groupBy("part").applyInArrow(_met, "short long, c long")
        able = self.nodes.join(met, "short").where(F.col("c") >= _depth(_least_partner(F.col("n"), self.percent))).select("row", "node")
        able = common.stash(able, "op4_able")
        few = able.count() <= BROADCAST_ROWS
        texts = self.texts.select("row", "text").join(F.broadcast(able) if few else able, "row").select("node", "text")
        sets = texts.mapInArrow(_sets(self.words), "node binary, n long, tokens binary")
        return common.stash(sets.withColumn("id", F.monotonically_increasing_id()), "op4_live", "none")

    def arranged(self, live: DataFrame) -> DataFrame:
        """(id, n, top, weight, shown) by exact frequencies."""
        total = live.agg(F.sum("n").alias("n")).first()["n"] or 0
        parts = _bins(total * 12)
        sent = live.select("id", "n", "tokens").mapInArrow(_spread(_bins(total * 10)), "bucket int, ids binary, sizes binary, tokens binary")
        back = sent.groupBy("bucket").applyInArrow(_levels(parts), "part long, ids binary, tokens binary, levels binary")
        nodes = live.select("id", "n", F.pmod("id", F.lit(parts)).alias("part"))
        got = nodes.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(_arrange(self.percent), "id long, n long, top long, weight double, shown array<long>")
        return common.stash(got, "op4_arranged", "none")

    def grouped(self, live: DataFrame, arranged: DataFrame) -> DataFrame:
        """(id, n, comp, grp): components found by leaders, and groups."""
        tops = arranged.groupBy("top").agg(F.count("*").alias("k"), F.sum("n").alias("all"), F.max(F.struct("weight", "id"))["id"].alias("leader")).where("k > 1")
        tops = common.stash(tops.withColumn("blocks", F.ceil(F.greatest(F.col("k") / BLOCK, F.col("all") / BLOCK_TOKENS)).cast("long")), "op4_tops")
        dealt = arranged.join(tops.select("top", "blocks"), "top").select("id", "n", "top", "weight", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), F.lit(False).alias("leads"))
        lead = tops.select(F.col("leader").alias("id"), F.lit(0).cast("long").alias("n"), "top", F.lit(0.0).alias("weight"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("leads"))
        bins = _bins((arranged.agg(F.sum("n").alias("n")).first()["n"] or 0) * 8)
        with_sets = dealt.unionByName(lead).drop("n").join(live.select("id", "tokens"), "id").withColumn("bin", F.pmod(F.xxhash64("top", "block"), F.lit(bins)))
        comp = common.stash(with_sets.groupBy("bin").applyInArrow(_star(self.percent), "id long, comp long"), "op4_comps")
        sizes = comp.groupBy("comp").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).select("comp", F.lit(True).alias("large"))
        placed = dealt.select("id", "n", F.xxhash64("top", "block").alias("pool")).join(comp, "id").join(sizes, "comp", "left")
        placed = placed.select("id", "n", "comp", F.when(F.col("large"), F.col("comp")).otherwise(F.col("pool")).alias("grp"))
        alone = arranged.join(tops.select("top"), "top", "left_anti").select("id", "n", F.col("id").alias("comp"), F.col("id").alias("grp"))
        return common.stash(placed.unionByName(alone), "op4_groups")

    def opened(self, arranged: DataFrame, groups: DataFrame) -> DataFrame:
        """(id, grp): the groups that a query node's bound lets it look into."""
        shown = arranged.select("id", F.explode("shown").alias("token")).join(groups, "id")
        several = shown.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
        held = common.stash(shown.join(several, "token", "left_semi"), "op4_held")
        matrix = held.groupBy("token", "grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("id").alias("first")).withColumnRenamed("grp", "other")
        other = ~((F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("comp"))) & (F.col("first") < F.col("id"))
        bound = held.join(matrix, "token").where(other).groupBy("id", "other").agg(F.count("*").alias("common"), F.first("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        size = (100 * F.col("n") >= self.percent * F.col("least")) & (100 * F.col("most") >= self.percent * F.col("n"))
        low = F.greatest(F.least("n", "least"), _least_partner(F.col("n"), self.percent))
        return common.stash(bound.where((F.col("common") >= _depth(low)) & size).select("id", F.col("other").alias("grp")), "op4_opened")

    def links(self, live: DataFrame, groups: DataFrame, opened: DataFrame) -> DataFrame:
        """(a, b): components of opened groups and of their queries that link."""
        blocks = lambda most: F.ceil(F.greatest(F.count("*") / most, F.sum("n") / (BLOCK_TOKENS * most / BLOCK)))
        opened = opened.join(groups.select("id", "n", "comp"), "id")
        asked = opened.groupBy("grp").agg(blocks(QUERIES).alias("qparts"))
        sizes = groups.join(asked, "grp").groupBy("grp").agg(blocks(BLOCK).alias("mparts"), F.min("qparts").alias("qparts"))
        sizes = common.stash(sizes, "op4_sizes")
        deal = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
        every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        members = groups.join(sizes, "grp").select("grp", "id", "comp", deal("mparts").alias("mpart"), every("qparts").alias("qpart"), F.lit(False).alias("asks"))
        queries = opened.join(sizes, "grp").select("grp", "id", "comp", every("mparts").alias("mpart"), deal("qparts").alias("qpart"), F.lit(True).alias("asks"))
        both = common.stash(members.unionByName(queries), "op4_asked")
        both = both.join(live.select("id", "n", "tokens"), "id")
        size = both.agg(F.sum("n").alias("n")).first()["n"] or 0
        both = both.withColumn("bin", F.pmod(F.xxhash64("grp", "mpart", "qpart"), F.lit(_bins(size * 8)))).drop("n")
        return common.stash(both.groupBy("bin").applyInArrow(_open(self.percent), "a long, b long").distinct(), "op4_links")

    def run(self) -> DataFrame:
        """(row, doc_id, n, comp) of every row; comp names its component (null without shingles)."""
        live = self.live()
        arranged = self.arranged(live)
        groups = self.grouped(live, arranged)
        links = self.links(live, groups, self.opened(arranged, groups))
        joined = components(links).select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        of_live = groups.join(joined, "comp", "left").select("id", F.coalesce("root", "comp").cast("string").alias("root"))
        of_node = live.select("id", "node").join(of_live, "id").select("node", "root")
        rows = self.rows.select("row", "doc_id", "n", "node").join(common.stash(of_node, "op4_roots"), "node", "left")
        return common.stash(rows.select("row", "doc_id", "n", F.coalesce("root", F.hex("node")).alias("comp")), "op4_named")


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    with common.noted() as folders:
        rows = Join(docs, words, percent).run()
        # Written first: Spark can split a large component's rows only where both sides of the join come straight from a shuffle.
        ids = common.stash(rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id")), "op4_ids")
    out = rows.join(ids, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    common.release(out, folders)
    return out


def repeated(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(row) of every row but the first of its component (smallest doc_id, nulls last, then the earliest row); row: monotonically_increasing_id() over ``docs``."""
    rows = Join(docs, words, percent).run().where("comp is not null")
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"].alias("first"), F.count("*").alias("many")).where("many > 1")
    return rows.join(first, "comp").where(F.col("row") != F.col("first")).select("row")


def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows that ``repeated`` names: one row of each component, whatever ids rows have, and every row without words."""
    with common.noted() as folders:
        gone = common.stash(repeated(docs, words, percent), "op4_repeated")
    common.release(gone, folders)
    few = gone.count() <= BROADCAST_ROWS
    row = common.TMP + "row"
    gone = gone.select(F.col("row").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(F.broadcast(gone) if few else gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d
), t AS (SELECT doc_id, unnest(s) AS tok FROM s
), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s
), f AS (SELECT tok FROM t GROUP BY tok HAVING count(*) > 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM t a JOIN f USING (tok) JOIN t b ON a.tok = b.tok AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 75 * (i.n + j.n - c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x
)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2
"""
