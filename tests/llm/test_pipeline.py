"""Stages of the corpus pipeline over a small corpus."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests_llm_corpus import COLUMNS, write


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("sf")))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "quality", "near_duplicates", "repeats", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{sf_dir}/out-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == COLUMNS
    ids = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert 900 not in ids["language"] and 901 not in ids["language"] and len(ids["language"]) >= 0.9 * 120
    assert ids["quality"] <= ids["language"]
    assert 1 in ids["quality"] and 500 not in ids["near_duplicates"]
    assert ids["packing"] == ids["repeats"] == ids["near_duplicates"]
    shared = seen["repeats"].where(F.col("text").contains("passage that stands in many documents")).count()
    assert shared == 1
    n = seen["packing"].groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).where("n <> doc_tokens").count()
    assert n == 0


def test_run_gives_the_same_rows(spark, sf_dir):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "length", "ids_crc32").collect())) for _ in range(2))
    assert a == b and a


CLASHING = ("row", "block", "part", "comp", "node", "score", "kept", "spans", "order", "n", "__tl_stage0")


def test_stages_over_odd_tables(spark, sf_dir, tmp_path):
    """Null and repeated ids, repeated rows, other texts under one id, null texts, and columns named like those used inside."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = {r["doc_id"]: r["text"] for r in docs.where("doc_id in (0, 1, 2, 3)").collect()}
    near = good[1].replace("river", "river", 1) + " end"
    odd = [(None, good[1], "en", "a", 1), (None, near, "en", "a", 1), (1007, good[2], "en", "a", 1), (1007, good[3], "en", "a", 1), (1008, good[2], "en", "a", 1), (1008, good[2], "en", "a", 1), (1009, None, None, None, None)]
    more = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    wide = docs.unionByName(more).withColumns({c: F.lit("own") for c in CLASHING})
    wide.repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == names and docs.where(" or ".join(f"`{c}` <> 'own'" for c in CLASHING)).count() == 0
    before, after = (collections.Counter(r["doc_id"] for r in seen[s].select("doc_id").collect()) for s in ("quality", "near_duplicates"))
    assert before[None] == 2 and before[1007] == 2 and before[1008] == 2 and before[1009] == 0
    # Copies and near copies of documents 1, 2 and 3 go, whatever their ids; those stay.
    assert after[None] == after[1007] == after[1008] == 0 and after[1] == after[2] == after[3] == 1
    assert set(r["doc_id"] for r in seen["packing"].select("doc_id").collect()) == set(after)


def test_stages_over_an_empty_table(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0
