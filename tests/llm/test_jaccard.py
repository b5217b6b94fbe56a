"""The n-gram Jaccard join on families of texts, hot groups, null ids, and in small blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustlake.llm import op4_jaccard

SCHEMA = "doc_id long, text string"


def brute(texts):
    """Smallest place that links reach, for each text (equal and linked ones)."""
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    of, rows, cols = {}, [], []
    for i, s in enumerate(sets):
        for x in s:
            rows.append(i)
            cols.append(of.setdefault(x, len(of)))
    many = np.bincount(cols)
    shared = np.cumsum(many > 1) - 1
    m = np.zeros((len(texts), int((many > 1).sum())), np.float32)
    for r, c in zip(rows, cols):
        if many[c] > 1:
            m[r, shared[c]] = 1
    both = m @ m.T
    n = np.array([len(s) for s in sets])
    link = (100 * both >= 75 * (n[:, None] + n[None, :] - both)) & (both > 0)
    label = np.arange(len(texts))
    while True:
        new = np.array([label[np.flatnonzero(row)].min() if row.any() else label[i] for i, row in enumerate(link)])
        if (new == label).all():
            return label.tolist(), int((link.sum() - len(texts)) // 2)
        label = np.minimum(label, new)


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for k in rng.sample(range(words), edits):
            w[k] = f"e{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("edits", [2, 5])
def test_a_family_of_2000(spark, tmp_path, edits):
    """5 edits: most alike at 50 to 74 %, few links; 2 edits: one large component and what hangs off it."""
    rng = random.Random(edits)
    texts = family(rng, 2000, 200, edits) + family(rng, 50, 120, 1) + [" ".join(f"u{rng.random()}" for _ in range(60)) for _ in range(200)]
    spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(4).write.parquet(str(tmp_path / "t"))
    want, links = brute(texts)
    got = {r["doc_id"]: r["component_id"] for r in op4_jaccard.join(spark.read.parquet(str(tmp_path / "t"))).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert links < 200_000 if edits == 5 else len(set(want)) < 400


def test_small_blocks_and_shuffled_texts(spark, tmp_path, monkeypatch):
    """Every branch that large inputs take: many blocks, buckets and parts, texts shuffled to their row numbers."""
    for name, value in {"BLOCK": 8, "QUERIES": 4, "LEADERS": 1, "BUCKET": 3000, "GATHER": 500, "BROADCAST_ROWS": 0}.items():
        monkeypatch.setattr(op4_jaccard, name, value)
    rng = random.Random(9)
    texts = family(rng, 60, 60, 1) + family(rng, 40, 80, 2) + family(rng, 30, 40, 0)
    spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3).write.parquet(str(tmp_path / "t"))
    got = {r["doc_id"]: r["component_id"] for r in op4_jaccard.join(spark.read.parquet(str(tmp_path / "t"))).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)[0]


def test_null_and_repeated_ids(spark, tmp_path, monkeypatch):
    """Near copies without ids link; of a component the row with the smallest id comes first, of one without ids the earliest."""
    rng = random.Random(4)
    a, b, c = family(rng, 3, 100, 1), family(rng, 2, 90, 1), family(rng, 2, 80, 0)
    rows = [(7, a[0]), (None, a[1]), (9, a[2]), (None, b[0]), (None, b[1]), (7, c[0]), (7, c[1]), (7, " ".join(f"x{i}" for i in range(30))), (None, None), (3, "")]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    got = sorted(map(tuple, op4_jaccard.join(docs).collect()), key=str)
    assert got == sorted([(7, 96, 7), (None, 96, 7), (9, 96, 7), (None, 86, None), (None, 86, None), (7, 76, 7), (7, 76, 7), (7, 26, 7), (None, 0, None), (3, 0, 3)], key=str)
    for most in (400_000, 0):
        monkeypatch.setattr(op4_jaccard, "BROADCAST_ROWS", most)
        kept = op4_jaccard.representatives(docs)
        assert kept.columns == docs.columns
        assert sorted((str(r["doc_id"]), (r["text"] or "")[:2]) for r in kept.collect()) == sorted((str(i), (t or "")[:2]) for i, t in [rows[0], rows[3], rows[5], rows[7], rows[8], rows[9]])
