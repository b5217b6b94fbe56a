"""A bounded, reproducible sample of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Documented bound: at most this many labelled rows of each class are used to fit.
PER_CLASS = 4000


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int = 5, per_class: int = PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """(text, y) of at most ``per_class`` training rows of each class, and the classes' sizes.

    Training rows are those outside fold 0. Rows are chosen by a hash of the
    doc_id; a doc_id that is labelled twice counts with its smallest label.
    """
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (common.fold("doc_id", folds) != 0))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit(label), "doc_id")
    picked = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in sorted(sizes)]
    if not picked:
        return docs.select(F.col("text").cast("string").alias("text"), F.lit(0).alias("y")).where(F.lit(False)), sizes
    rows = picked[0]
    for more in picked[1:]:
        rows = rows.union(more)
    # At most 2 x per_class rows of two numbers: a broadcast of proven size.
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(rows), "doc_id").select("text", "y"), sizes
