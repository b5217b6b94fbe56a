"""Operator 9: document fingerprints by one-permutation MinHash, in built-in functions only.

A text's distinct five-word shingles (fewer words: the whole sequence as one)
are hashed once. A hash's low bits choose one of 128 bins, the rest compete for
the bin's minimum. Empty bins are filled by optimal densification: bin i looks
at the bins of a fixed random permutation of its own and copies the first that
has a value. The low four bits of each bin are kept, one hexadecimal digit a
bin. Digits agree by chance once in 16 times, so likeness is
(agreement - 1/16) / (1 - 1/16), held within 0 and 1.

Documents are edited in a global order (descending doc_id). No task sees all
rows: doc_ids are cut into ranges of a few hundred documents, ``lead`` works
within a range, and a range's last document gets the first of the next range
from a table with one row per range (65,536 ranges at most).

Cases. Null text is empty. A text without words has the fingerprint '' and is
like another such text (1.0) and unlike any other (0.0). Ties in doc_id are
ordered by text; a null doc_id comes last. With one row, it is its own next
document. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BINS = 128
BITS = 4
WORDS = 5
PER_RANGE = 256
MOST_RANGES = 65_536
PROBES = 6


def _permutations() -> list[list[int]]:
    rng = random.Random(9)
    return [rng.sample([j for j in range(BINS) if j != i], BINS - 1) for i in range(BINS)]


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add column ``out``: the fingerprint of column ``text`` (not null)."""
    t = common.TMP
    words = F.array_remove(F.split(F.lower(F.col(text)), r"\s+"), "")
    df = df.withColumn(f"{t}w", words)
    w = F.col(f"{t}w")
    packed = lambda h: F.shiftleft(h.bitwiseAND(F.lit(BINS - 1).cast("long")), 56).bitwiseOR(F.shiftrightunsigned(h, 8))
    df = df.withColumn(f"{t}v", F.transform(w, lambda x: F.xxhash64(x)))
    v = F.col(f"{t}v")
    shingle = F.transform(F.sequence(F.lit(0), F.size(v) - WORDS), lambda i: packed(F.xxhash64(*[F.get(v, i + k) for k in range(WORDS)])))
    hashes = F.when(F.size(v) >= WORDS, shingle).when(F.size(v) > 0, F.array(packed(F.xxhash64(v)))).otherwise(F.array().cast("array<long>"))
    df = df.withColumn(f"{t}h", F.sort_array(hashes))
    h = F.col(f"{t}h")
    bin_of = lambda x: F.shiftright(x, 56)
    df = df.withColumn(f"{t}m", F.filter(h, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(h, i - 1)))))
    m = F.col(f"{t}m")
    # The bins that have a value, in a column that is used twice: an expression used once would move into the lambda below.
    df = df.withColumn(f"{t}k", F.transform(m, lambda x: bin_of(x).cast("int")))
    k = F.col(f"{t}k")
    spread = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.get(m, F.array_position(k, i).cast("int") - 1))
    df = df.withColumn(f"{t}b", F.when(F.size(k).isin(0, BINS), m).otherwise(spread))
    b = F.col(f"{t}b")
    order = F.from_json(F.lit(json.dumps(_permutations())), "array<array<int>>")

    def fill(x: Column, i: Column) -> Column:
        own = F.get(order, i)
        rest = F.get(F.filter(F.transform(own, lambda j: F.get(b, j)), lambda y: y.isNotNull()), F.lit(0))
        return F.coalesce(x, *[F.get(b, F.get(own, F.lit(k))) for k in range(PROBES)], rest)

    filled = F.when(F.size(m).isin(0, BINS), b).otherwise(F.transform(b, fill))
    digit = lambda x: F.substring(F.lit("0123456789abcdef"), (x.bitwiseAND(F.lit(2**BITS - 1).cast("long")) + 1).cast("int"), 1)
    df = df.withColumn(f"{t}f", filled)
    return df.withColumn(out, F.array_join(F.transform(F.col(f"{t}f"), digit), "")).drop(*[f"{t}{x}" for x in "wvhmkbf"])


def likeness(a: Column, b: Column) -> Column:
    """Bias-corrected share of equal bins of two fingerprints."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y)
    agree = F.size(F.filter(same, lambda x: x)) / F.lit(float(BINS))
    chance = 2.0**-BITS
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (agree - chance) / (1 - chance))))


def _range_of(docs: DataFrame) -> Column:
    """A number that doesn't fall as doc_id grows, with some hundred documents each."""
    s = docs.agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.percentile_approx("doc_id", [k / 64 for k in range(1, 64)], 1000).alias("q")).first()
    if not s["n"]:
        return F.lit(-1)
    cuts = sorted({s["lo"], *s["q"]})
    parts = max(1, math.ceil(min(s["n"] / PER_RANGE, MOST_RANGES) / len(cuts)))
    edges = F.from_json(F.lit(json.dumps([*cuts, s["hi"] + 1])), "array<long>")
    k = F.size(F.filter(F.from_json(F.lit(json.dumps(cuts)), "array<long>"), lambda c: c <= F.col("doc_id")))
    low, high = F.get(edges, k - 1).cast("double"), F.get(edges, k).cast("double")
    sub = F.least(F.floor((F.col("doc_id").cast("double") - low) / (high - low) * parts), F.lit(parts - 1))
    return F.coalesce(k * parts + sub, F.lit(-1)).cast("int")


def fingerprint(docs: DataFrame) -> DataFrame:
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("part", _range_of(base.select("doc_id")))
    # For each range, the first document of the range below it (below the last: of the first). One row per range.
    tops = base.groupBy("part").agg(F.max("doc_id").alias("top"))
    order = Window.orderBy(F.desc("part"))
    after = tops.select("part", F.lead(F.struct("part", "top")).over(order).alias("n"), F.first(F.struct("part", "top")).over(order).alias("f"))
    after = after.select("part", F.coalesce("n", "f").alias("n")).select("part", F.col("n.part").alias("next_part"), F.col("n.top").alias("top"))
    head = base.withColumnRenamed("part", "own").join(F.broadcast(after), (F.col("doc_id").eqNullSafe(F.col("top"))) & (F.col("own") == F.col("next_part")))
    head = with_fingerprint(head.groupBy("part").agg(F.min("text").alias("head_text")), "head_text", "head_fp")
    rows = with_fingerprint(base, "text", "fingerprint")
    w = Window.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"), "text")
    rows = rows.select("*", F.lead("text").over(w).alias("next_text"), F.lead("fingerprint").over(w).alias("next_fp"))
    rows = rows.join(head.hint("merge"), "part", "left")
    n = F.char_length("text")
    last = F.floor(n / 3).cast("int")
    following = F.coalesce("next_text", "head_text")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", F.coalesce("next_fp", "head_fp").alias("next_fp"), F.concat(F.substr("text", F.lit(1), n - last), F.substr(following, F.lit(1), last)).alias("edited"))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(common.table(spark, sf_dir, "documents"))
