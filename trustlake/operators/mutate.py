"""Mutations for live-fire tests: a check counts as proven when it catches one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import FIRED, REGISTRY, Check, Verdict, same_rows


@dataclass(frozen=True)
class Mutation:
    name: str
    apply: Callable[[DataFrame], DataFrame]


def _numbered(df: DataFrame, only: str | None = None) -> DataFrame:
    """Rows numbered from 0 in an order fixed by all columns (test frames); with ``only``, its non-null rows alone, others -1."""
    w = Window.orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in df.columns])
    if only is None:
        return df.withColumn("__i", F.row_number().over(w) - 1)
    seen = F.sum(F.col(only).isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__i", F.when(F.col(only).isNotNull(), seen - 1).otherwise(-1))


def _nth(name: str, column: str, index: int, change: Callable[[Column], Column], non_null: bool = True) -> Mutation:
    def apply(df: DataFrame) -> DataFrame:
        kind = df.schema[column].dataType
        return _numbered(df, column if non_null else None).withColumn(column, F.when(F.col("__i") == index, change(F.col(column)).cast(kind)).otherwise(F.col(column))).drop("__i")

    return Mutation(name, apply)


def null_to_zero(column: str) -> Mutation:
    return Mutation(f"null to zero in {column}", lambda df: df.fillna(0, [column]))


def nudge(column: str, eps: float = 1e-6, index: int = 0) -> Mutation:
    return _nth(f"nudge {column}", column, index, lambda c: c + F.lit(eps))


def drop_row(index: int = 0) -> Mutation:
    return Mutation("drop a row", lambda df: _numbered(df).where(F.col("__i") != index).drop("__i"))


def duplicate_row(index: int = 0) -> Mutation:
    return Mutation("duplicate a row", lambda df: df.unionByName(_numbered(df).where(F.col("__i") == index).drop("__i")))


def reorder_rows(seed: int = 7) -> Mutation:
    return Mutation("reorder rows", lambda df: df.orderBy(F.rand(seed)))


def prefix(column: str, with_: str, index: int = 0) -> Mutation:
    return _nth(f"prefix {column}", column, index, lambda c: F.concat(F.lit(with_), c))


def suffix(column: str, with_: str, index: int = 0) -> Mutation:
    return _nth(f"suffix {column}", column, index, lambda c: F.concat(c, F.lit(with_)))


def set_value(column: str, value: Any, index: int = 0) -> Mutation:
    return _nth(f"set {column}", column, index, lambda c: F.lit(value), non_null=False)


def set_where(column: str, value: Any, where: Column | str, label: str = "") -> Mutation:
    return Mutation(label or f"set {column} where", lambda df: df.withColumn(column, F.when(F.expr(where) if isinstance(where, str) else where, F.lit(value).cast(df.schema[column].dataType)).otherwise(F.col(column))))


def add_leading_plus(column: str) -> Mutation:
    return prefix(column, "+")


def float_artifact(column: str) -> Mutation:
    return suffix(column, ".0")


def assert_catches(check: Check, clean: DataFrame, mutation: Mutation) -> None:
    """The clean frame passes, the mutation changes it, and the check fails on what comes out."""
    before = check.evaluate(clean)
    assert before.verdict is Verdict.PASS, f"{check.name} does not pass on the clean frame: {before}"
    mutated = mutation.apply(clean)
    assert not same_rows(clean, mutated), f"{mutation.name} changes nothing"
    after = check.evaluate(mutated)
    assert after.verdict is Verdict.FAIL, f"{check.name} does not catch {mutation.name}: {after}"
    FIRED.add(check.name)


def unproven() -> list[str]:
    """Registered checks that no test has fired: the strict gate fails on any."""
    return sorted(set(REGISTRY) - FIRED)
