"""A corpus pipeline over ``documents``: each stage is written as Parquet and read again as the next one's documents.

Language ID and the quality classifier drop what they reject, the n-gram join
keeps one document of each group, the suffix stage removes repeated passages, and
packing cuts what is left into training sequences. Every stage but the last
returns the columns of ``documents``, further columns of the table's own among them,
whatever their names.

Cases, of every stage. An empty table gives no rows. Null and empty texts go with
the language stage; should they reach a later one, the classifier scores them like
any text, they link with nothing, lose nothing, and are packed as their end alone.
Rows count, not ids: rows that share a doc_id, or have none, are documents of their
own. Repeated rows are linked, so one of them stays. Ties go to the smallest doc_id,
then to the earliest row. A row without labels teaches the classifier nothing; with
labels of one class or none it scores 0.5, which keeps every document.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.llm import common, op1_quality, op2_packing, op4_jaccard, op5_language, op7_suffix

#: Below this posterior a document's language is not certain enough to keep it.
LANGUAGE_SCORE = 0.5
_TMP = "__tl_stage"


_HELPERS: list[str] = []


def _stage(function):
    """A stage. When it begins, the stage before has been written, so that one's helper tables go."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(docs, _HELPERS)
        common.bounded(spark)
        common.NOTED.append(_HELPERS)
        try:
            return function(spark, docs, sf_dir)
        finally:
            common.NOTED.remove(_HELPERS)

    return run_stage


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, in a language that the model is sure of. Without a row that teaches (text and lang) every text is rejected."""
    model = op5_language.fit(docs.where(common.fold("doc_id", 5) != 0), op5_language.default_path())
    found = docs.withColumn(_TMP, op5_language.predictor(model)(F.col("text").cast("string")))
    return found.where((F.col(f"{_TMP}.lang_pred") != "und") & (F.col(f"{_TMP}.score") >= LANGUAGE_SCORE)).drop(_TMP)


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of good quality."""
    model = op1_quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return docs.withColumn(_TMP, op1_quality.scorer(model)(F.col("text").cast("string"))).where(F.col(_TMP) >= op1_quality.THRESHOLD).drop(_TMP)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents, the one with the smallest doc_id (nulls last, then the earliest row).

    Rows count, not ids: different texts under one id are both kept, near copies without ids are not.
    """
    return op4_jaccard.representatives(docs)


@_stage
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that a smaller document has. Characters cut in two go with them; emptied texts stay as rows."""
    names = [f"{_TMP}{i}" for i in range(len(docs.columns))]
    aside = [F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)]
    got = op7_suffix.dedup(docs.select("doc_id", "text", *aside), tuple(names), characters=True)
    text = F.when(F.size("spans") == 0, F.col(names[docs.columns.index("text")])).otherwise(F.col("kept"))
    out = {c: F.col(n) for c, n in zip(docs.columns, names)} | {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.char_length(F.coalesce(text, F.lit(""))).cast(docs.schema["n_chars"].dataType)
    return got.select(*[e.alias(c) for c, e in out.items()])


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return op2_packing.pack(docs, ids=False)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", packing)]
#: Fitted models and a vocabulary decide what stays: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stash(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
