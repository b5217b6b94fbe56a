"""A semantic layer: named dimensions and measures over a frame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SemanticTable:
    frame: DataFrame
    dimensions: dict[str, Column] = field(default_factory=dict)
    measures: dict[str, Column] = field(default_factory=dict)

    def with_dimensions(self, **named: Column) -> SemanticTable:
        return SemanticTable(self.frame, {**self.dimensions, **named}, self.measures)

    def with_measures(self, **named: Column) -> SemanticTable:
        return SemanticTable(self.frame, self.dimensions, {**self.measures, **named})

    def where(self, e: Column) -> SemanticTable:
        return SemanticTable(self.frame.where(e), self.dimensions, self.measures)

    def query(self, by: list[str], measures: list[str]) -> DataFrame:
        """One aggregate for all measures asked for."""
        return self.frame.groupBy(*[self.dimensions[d].alias(d) for d in by]).agg(*[self.measures[m].alias(m) for m in measures])


def count_true(e: Column) -> Column:
    return F.count_if(F.coalesce(e, F.lit(False)))


def ratio_of_sums(num: Column, den: Column) -> Column:
    """A share over all rows: NULL where there is nothing to divide by."""
    return F.try_divide(num.cast("double"), den)
