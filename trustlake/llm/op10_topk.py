"""Operator 10: exact top-k inner products over norm-sorted vectors.

Components become integers floor(256 * x). Vectors are rotated onto the
eigenvectors of their Gram matrix (the SVD's right vectors), so a few leading
coordinates carry most of an inner product; Cauchy-Schwarz bounds the rest by
the product of residual lengths. Vectors are dealt to classes of length, each a
twentieth longer than the next, and a class to parts of bounded size; what part a
vector belongs to is data, a column, and no partition of Spark's. A first look at the longest vectors gives each query a threshold; parts
whose length times the query's can't reach it are never paired, and inside a
part vectors come by descending length and are dropped by the same kind of bound.
What survives is scored exactly, in integers.

Queries and parts meet in blocks of fixed size, so no task holds all of either.

Cases. Vectors that are null, empty or hold null, NaN or infinite components take
no part, nor do rows with a null vec_id. If components are so large that a score
might not fit a long, this raises: a wrapped score would be wrong in silence. Shorter vectors count as padded with
zeros. Rows that share the query's vec_id are its own. Equal scores go to the
smaller vec_id; repeated candidate rows count each. Fewer than k candidates: all
of them. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 5
PART = 20_000
QUERY_BLOCK = 2048
#: Logarithm of the squared length of one class over the next. Doubles have at most 14,200 such classes.
STEP_LOG = 0.1
#: The longest vectors looked at first, to give every query a threshold.
SEED = 2048
STEP = 1024

ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, e, norm2) of the rows that take part."""
    e = F.col("embedding")
    whole = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & whole)
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long")).alias("e"))
    return rows.withColumn("norm2", F.aggregate("e", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = np.asarray(column.value_lengths())
    out = np.zeros((len(column), width), np.int64)
    flat = column.flatten().to_numpy()
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _gram(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            m = matrix(b.column("e"), width).astype(np.float64)
            total += m.T @ m
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()), "x": pa.array(total.ravel())})

    return run


class Search:
    """Running top k of a block of queries."""

    def __init__(self, ids: np.ndarray, e: np.ndarray, rotation: np.ndarray, k: int, floor: np.ndarray | None = None) -> None:
        self.ids, self.e, self.k, self.rotation = ids, e, k, rotation
        self.lead = max(1, rotation.shape[1] // 4)
        r = e @ rotation
        self.head, self.rest = r[:, : self.lead], np.sqrt((r[:, self.lead :] ** 2).sum(axis=1))
        self.norm = np.sqrt((r**2).sum(axis=1))
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.astype(np.float64)
        self.query, self.found, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def threshold(self) -> np.ndarray:
        out = self.floor.copy()
        n = np.bincount(self.query, minlength=len(self.ids))
        last = np.cumsum(n) - 1
        full = n >= self.k
        out[full] = np.maximum(out[full], self.score[last[full]])
        return out

    def look(self, ids: np.ndarray, e: np.ndarray) -> None:
        """Candidates by descending length."""
        r = e @ self.rotation
        norm = np.sqrt((r**2).sum(axis=1))
        exact = float(np.abs(self.e).max(initial=0)) * float(np.abs(e).max(initial=0)) * e.shape[1] < 2.0**52
        for lo in range(0, len(ids), STEP):
            hi = min(len(ids), lo + STEP)
            thr = self.threshold()
            slack = 1e-6 * (1 + self.norm * norm[lo])
            live = np.flatnonzero(self.norm * norm[lo] + slack >= thr)
            if not len(live):
                return
            rest = np.sqrt((r[lo:hi, self.lead :] ** 2).sum(axis=1))
            bound = self.head[live] @ r[lo:hi, : self.lead].T + np.outer(self.rest[live], rest)
            q, c = np.nonzero((bound + slack[live, None] >= thr[live, None]) & (self.ids[live, None] != ids[None, lo:hi]))
            if not len(q):
                continue
            if exact and len(q) * 8 > len(live) * (hi - lo):
                s = (self.e[live].astype(np.float64) @ e[lo:hi].T.astype(np.float64))[q, c].astype(np.int64)
            else:
                s = np.concatenate([np.einsum("ij,ij->i", self.e[live[q[i : i + 65_536]]], e[lo + c[i : i + 65_536]]) for i in range(0, len(q), 65_536)])
            keep = s >= thr[live[q]]
            self.merge(live[q[keep]], ids[lo + c[keep]], s[keep])

    def merge(self, query: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        query, found, score = np.concatenate([self.query, query]), np.concatenate([self.found, found]), np.concatenate([self.score, score])
        order = np.lexsort((found, -score, query))
        query, found, score = query[order], found[order], score[order]
        first = np.searchsorted(query, np.arange(len(self.ids)))
        keep = np.arange(len(query)) - first[query] < self.k
        self.query, self.found, self.score = query[keep], found[keep], score[keep]


def _sorted(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    t = t.sort_by([("norm2", "descending"), ("vec_id", "ascending")])
    return t["vec_id"].to_numpy(), matrix(t["e"], width)


def top_k(vectors: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """The k best candidates of each query (vec_id divisible by ``every``)."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    all_rows = common.stash(quantised(vectors), "op10_vectors")
    s = all_rows.agg(F.count("*").alias("n"), F.max(F.size("e")).alias("width"), F.count_if(F.col("vec_id") % every == 0).alias("q"), F.max(F.array_max(F.transform("e", lambda x: F.abs(x.cast("double"))))).alias("most")).first()
    if not s["q"]:
        return spark.createDataFrame([], schema)
    if s["most"] ** 2 * s["width"] >= 2.0**63:
        raise OverflowError(f"components up to {s['most']:.3g} in {s['width']} dimensions: scores may not fit a long")
    n, width = s["n"], s["width"]
    g = all_rows.select("e").mapInArrow(_gram(width), "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    gram = np.zeros((width, width))
    gram[g["i"].to_numpy(), g["j"].to_numpy()] = g["x"].to_numpy()
    rotation = np.linalg.eigh(gram)[1][:, ::-1].copy()
    seeds = _sorted(all_rows.orderBy(F.desc("norm2"), "vec_id").limit(SEED).toArrow(), width)

    def first_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            look = Search(b.column("vec_id").to_numpy(), matrix(b.column("e"), width), rotation, k)
            look.look(*seeds)
            yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "e": b.column("e"), "norm2": b.column("norm2"), "floor": pa.array(look.threshold())})

    queries = all_rows.where(F.col("vec_id") % every == 0).mapInArrow(first_look, "vec_id long, e array<long>, norm2 double, floor double")
    blocks = max(1, math.ceil(s["q"] / QUERY_BLOCK))
    queries = common.stash(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "op10_queries")
    dealt = all_rows.withColumn("class", F.floor(F.log(F.greatest("norm2", F.lit(1.0))) / STEP_LOG).cast("int"))
    # One row a class, and of those no more than doubles have: what comes to the driver is bounded.
    classes = [(r["class"], math.exp((r["class"] + 1) * STEP_LOG / 2), math.ceil(r["n"] / PART)) for r in dealt.groupBy("class").agg(F.count("*").alias("n")).orderBy(F.desc("class")).collect()]
    known = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(x).alias("longest"), F.lit(p).alias("parts")) for c, x, p in classes])
    need = queries.groupBy("block").agg(F.min(F.when(F.col("norm2") > 0, F.col("floor") / F.sqrt("norm2")).otherwise(F.lit(-float("inf")))).alias("least"))
    reach = F.filter(known, lambda c: c["longest"] * (1 + 1e-9) + 1e-6 >= F.col("least"))
    pairs = need.select("block", F.explode(reach).alias("c")).select("block", F.col("c")["class"].alias("class"), F.explode(F.sequence(F.lit(0), F.col("c")["parts"] - 1)).alias("part"))
    parts = F.element_at(F.map_from_entries(F.array(*[F.struct(F.lit(c), F.lit(p)) for c, _, p in classes])), F.col("class"))
    dealt = dealt.withColumn("part", F.pmod(F.monotonically_increasing_id(), parts).cast("int"))

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        look = Search(left["vec_id"].to_numpy(), matrix(left["e"], width), rotation, k, left["floor"].to_numpy())
        look.look(*_sorted(right, width))
        return pa.table({"query_id": look.ids[look.query], "vec_id": look.found, "score": look.score})

    keys = ["block", "class", "part"]
    left = queries.join(pairs, "block").groupBy(*keys)
    again = pairs.select(*[F.col(c).alias(c) for c in keys])
    right = dealt.join(again, ["class", "part"]).select(*keys, "vec_id", "e", "norm2").groupBy(*keys)
    found = left.cogroup(right).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"))
