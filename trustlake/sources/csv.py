"""CSV drops: every column text, the header exactly as declared."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SourceError(RuntimeError):
    pass


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_day(spark: SparkSession, drop_dir: str, day: date, columns: tuple[str, ...], prefix: str = "usage_") -> DataFrame:
    """The day's file, its name computed from the date."""
    path = f"{drop_dir.rstrip('/')}/{prefix}{day.isoformat()}.csv"
    if not _exists(spark, path):
        raise SourceError(f"no file {path}")
    header = spark.read.text(path).first()
    names = tuple(header[0].lstrip("﻿").split(",")) if header else ()
    if names != columns:
        raise SourceError(f"{path}: header is {names}, not {columns}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(partition, file, rows); patterns in file names are refused."""
    df = spark.read.schema("partition string, file string, rows long").option("header", True).option("enforceSchema", False).csv(path)
    if bad := df.where(F.col("file").rlike(r"[*?\[]")).first():
        raise SourceError(f"{path}: {bad['file']!r} is a pattern, not a file")
    return df


def manifest_groups(manifest: DataFrame) -> dict[str, tuple[list[str], int]]:
    """Partition -> (files in order, rows). A manifest lists files of one migration: small by nature."""
    out: dict[str, tuple[list[str], int]] = {}
    for r in manifest.toLocalIterator():
        files, n = out.get(r["partition"], ([], 0))
        out[r["partition"]] = ([*files, r["file"]], n + (r["rows"] or 0))
    return out


def safe_key(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.=-]", "_", name)
