"""Operator 1: document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded (word
buckets, first and last characters, lengths, repetition) and embedded; gated
attention, tanh(V h) * sigmoid(U h), gives each passage a weight; the weighted
mean of the embeddings is scored by a logistic unit. All weights are learned
together from document labels.

The fit uses at most ``labelled.PER_CLASS`` rows of each class and, in the order of
a hash, only as many of them as have ``PASSAGES`` passages together, so what reaches
the driver is bounded in bytes however long texts are; every row that is used is
used whole. Scoring reads every passage of every text. A document's last passage
may be shorter.

Cases. Null and empty texts are one passage without words. Rows with null or
other labels teach nothing; with one class or none every score is 0.5.
Repeated rows get equal scores. An empty table gives no rows. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, labelled, tokens

PASSAGE = 64
THRESHOLD = 0.3
BUCKETS = 64
#: Documented bound: passages of each class that the fit uses.
PASSAGES = 40_000
HIDDEN = 24
ATTENTION = 12


def _kinds() -> np.ndarray:
    """Byte -> one of 24 kinds: upper, lower, digit, beyond ASCII, and the signs that texts use most."""
    out = np.full(256, 23, np.int64)
    out[65:91], out[97:123], out[48:58], out[128:] = 0, 1, 2, 3
    for k, sign in enumerate(b".,!?;:|#$%&*-_=<>/\"", start=4):
        out[sign] = k
    return out


KINDS = _kinds()
WIDTH = BUCKETS + 24 + 24 + 24 + 10 + 3


def encode(t: tokens.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Passage features, and where each text's passages begin."""
    w = tokens.words(t)
    n = np.diff(w.first)
    passages = np.maximum(1, -(-n // PASSAGE))
    begin = np.concatenate([[0], np.cumsum(passages)])
    p = begin[w.doc] + (np.arange(len(w.doc)) - w.first[w.doc]) // PASSAGE
    total = int(begin[-1])
    length = w.end - w.start

    def shares(value: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(p * width + value, minlength=total * width).reshape(total, width).astype(np.float32)

    count = np.bincount(p, minlength=total)[:, None].astype(np.float32)
    size = np.maximum(count, 1)
    second = t.data[np.minimum(w.start + 1, w.end - 1)] if len(w.start) else np.zeros(0, np.uint8)
    parts = [
        shares((w.hash & np.uint64(BUCKETS - 1)).astype(np.int64), BUCKETS),
        shares(KINDS[t.data[w.start]] if len(w.start) else np.zeros(0, np.int64), 24),
        shares(KINDS[t.data[w.end - 1]] if len(w.start) else np.zeros(0, np.int64), 24),
        shares(KINDS[second], 24),
        shares(np.minimum(length // 2, 9), 10),
    ]
    out = np.concatenate(parts, axis=1) / size
    # Share of words that stood in the passage already, and of words that stood where they stand one place back.
    key = (w.hash >> np.uint64(24)) * np.uint64(1_000_003) + p.astype(np.uint64)
    distinct = np.bincount(p[np.unique(key, return_index=True)[1]], minlength=total)[:, None] if len(p) else np.zeros((total, 1))
    same = np.bincount(p[1:], (w.hash[1:] == w.hash[:-1]) & (p[1:] == p[:-1]), minlength=total)[:, None] if len(p) else np.zeros((total, 1))
    return np.concatenate([out, distinct / size, same / size, np.log1p(count) / 5], axis=1).astype(np.float32), begin


def _softmax_bags(a: np.ndarray, bag: np.ndarray, bags: int) -> np.ndarray:
    top = np.full(bags, -np.inf)
    np.maximum.at(top, bag, a)
    e = np.exp(a - top[bag])
    return e / np.bincount(bag, e, bags)[bag]


class Model:
    """Parameters by name; ``forward`` gives what ``gradient`` needs."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.p = {"W": rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "a": np.zeros(ATTENTION), "o": np.zeros(HIDDEN), "c": np.zeros(1)}
        self.shift = 0.0

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> tuple:
        p = self.p
        z = (x - self.mean) * self.scale
        h = np.tanh(z @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        att = _softmax_bags((t * s) @ p["a"], bag, bags)
        m = np.stack([np.bincount(bag, att * h[:, j], bags) for j in range(HIDDEN)], axis=1)
        return z, h, t, s, att, m, m @ p["o"] + p["c"][0]

    def gradient(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        p = self.p
        z, h, t, s, att, m, logit = self.forward(x, bag, len(y))
        d = (1 / (1 + np.exp(-logit)) - y) * weight / len(y)
        dm = d[:, None] * p["o"]
        da = att * ((h * dm[bag]).sum(axis=1) - (m * dm).sum(axis=1)[bag])
        dts = da[:, None] * p["a"]
        dt, ds = dts * s * (1 - t**2), dts * t * s * (1 - s)
        dh = (att[:, None] * dm[bag] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h**2)
        return {"W": z.T @ dh + 1e-4 * p["W"], "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "a": (t * s).T @ da, "o": m.T @ d + 1e-4 * p["o"], "c": d.sum(keepdims=True)}

    def score(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        bags = len(begin) - 1
        return 1 / (1 + np.exp(-np.clip(self.forward(x, np.repeat(np.arange(bags), np.diff(begin)), bags)[-1] + self.shift, -40, 40)))


def _encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        y = b.column("y").to_pylist()
        for t in tokens.chunks(b.column("text")):
            x, begin = encode(t)
            yield pa.RecordBatch.from_pydict({"x": pa.array([x[begin[i] : begin[i + 1]].tobytes() for i in range(len(t))], pa.binary()), "k": pa.array(np.diff(begin), pa.int64()), "y": pa.array(y[t.row : t.row + len(t)], pa.int32())})


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, steps: int = 400, batch: int = 256, per_class: int = labelled.PER_CLASS) -> Model | None:
    rows, sizes = labelled.sample(docs, labels, "quality", folds, per_class)
    if len(sizes) < 2:
        return None
    encoded = common.stash(rows.mapInArrow(_encode_rows, "x binary, k long, y int"), "op1_rows", "none")
    # At most 2 x per_class rows of one number each are put in order; a class's first row is always in.
    sums = F.sum("k").over(Window.partitionBy("y").orderBy("order").rowsBetween(Window.unboundedPreceding, -1))
    within = encoded.select("k", "y", F.xxhash64("x", "y").alias("order")).withColumn("before", F.coalesce(sums, F.lit(0)))
    last = within.where((F.col("before") + F.col("k") <= PASSAGES) | (F.col("before") == 0)).groupBy("y").agg(F.max("order").alias("last"))
    got = encoded.join(F.broadcast(last), "y").where(F.xxhash64("x", "y") <= F.col("last")).select("x", "y").toArrow()
    common.drop(encoded)
    bags = [np.frombuffer(x, np.float32).reshape(-1, WIDTH) for x in got["x"].to_pylist()]
    y = got["y"].to_numpy().astype(float)
    order = sorted(range(len(bags)), key=lambda i: (y[i], bags[i].tobytes()[:512], len(bags[i])))  # whatever order the rows came in
    bags, y = [bags[i] for i in order], y[order]
    if len(set(y.tolist())) < 2:
        return None
    every = np.concatenate(bags)
    model = Model(every.mean(axis=0), 1 / (every.std(axis=0) + 1e-3))
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    weight = (len(y) / 2 / n)[y.astype(int)]
    # Balanced weights while learning; the intercept is moved to the true shares afterwards.
    model.shift = float(np.log(sizes[1] / sizes[0]))
    rng, m1, m2 = np.random.default_rng(2), {k: 0.0 for k in model.p}, {k: 0.0 for k in model.p}
    for step in range(1, steps + 1):
        pick = rng.choice(len(y), min(batch, len(y)), replace=False)
        x, bag = np.concatenate([bags[i] for i in pick]), np.repeat(np.arange(len(pick)), [len(bags[i]) for i in pick])
        for k, g in model.gradient(x, bag, y[pick], weight[pick]).items():
            m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.999 * m2[k] + 0.001 * g**2
            model.p[k] = model.p[k] - 0.01 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def scorer(model: Model | None):
    """An Arrow UDF text -> score."""

    def score(text: pa.Array) -> pa.Array:
        common.trim()
        out = [np.zeros(0)]
        for t in tokens.chunks(text):
            out.append(np.full(len(t), 0.5) if model is None else model.score(*encode(t)))
        return pa.array(np.concatenate(out), pa.float64())

    score.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, "double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    model = fit(docs, labels, folds)
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"), (common.fold("doc_id", folds) == 0).alias("held_out"))
    out = base.select("doc_id", "held_out", scorer(model)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
