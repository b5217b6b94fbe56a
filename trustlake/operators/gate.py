"""Gated questions: an answer with provenance, or a refusal with evidence.

A precondition on the run log is a handful of aggregates and a verdict over their
values. All such preconditions of a question are weighed in *one* aggregate over
one read of the run log, however many they are and whichever tables they ask for;
days are compared as arrays inside it, so a row comes back, not the log.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contracts import TableContract
from ..functions.text import days_between
from ..sources.lake import Reader
from .census import utc_today
from .checks import Evidence, Verdict, worst

#: How many days evidence names.
NAMED = 5


@dataclass(frozen=True)
class Precondition:
    """Anything that can be weighed against a reader."""

    name: str
    evaluate: Callable[[Reader], Evidence]


class LogCondition(Precondition):
    """Aggregates over the rolled-up run log, and the verdict over their values."""

    def __init__(self, name: str, measures: dict[str, Column], judge: Callable[[dict[str, Any]], Verdict]) -> None:
        super().__init__(name, lambda reader: weigh(reader, [self])[0])
        object.__setattr__(self, "measures", measures)
        object.__setattr__(self, "judge", judge)


@dataclass(frozen=True)
class Answer:
    question: str
    value: Any
    evidence: list[Evidence]
    datasets: tuple[str, ...]
    provenance: dict[str, Any]


@dataclass(frozen=True)
class Refusal:
    question: str
    evidence: list[Evidence]
    provenance: dict[str, Any]

    @property
    def reasons(self) -> list[str]:
        return [str(e) for e in self.evidence if e.verdict is not Verdict.PASS]


def weigh(reader: Reader, preconditions: Sequence[Precondition]) -> list[Evidence]:
    """The evidence of each precondition, in order."""
    ours = {i: p for i, p in enumerate(preconditions) if isinstance(p, LogCondition)}
    every = [e.alias(f"{i}/{k}") for i, p in ours.items() for k, e in p.measures.items()]
    row = reader.runlog().agg(*every).first().asDict() if every else {}
    out = []
    for i, p in enumerate(preconditions):
        if i in ours:
            measured = {k: row[f"{i}/{k}"] for k in p.measures}
            out.append(Evidence(p.name, p.judge(measured), measured))
        else:
            out.append(p.evaluate(reader))
    return out


def answer(question: str, *, reader: Reader, compute: Callable[[Reader], Any], preconditions: Sequence[Precondition], datasets: Sequence[TableContract] = ()) -> Answer | Refusal:
    """``compute`` runs only if nothing that was asked for fails or stays open."""
    evidence, origin = weigh(reader, preconditions), reader.provenance()
    if not evidence or worst(evidence) is Verdict.PASS:
        return Answer(question, compute(reader), evidence, tuple(c.table for c in datasets), origin)
    return Refusal(question, evidence, origin)


def _window(contract: TableContract, start: date, end: date) -> tuple[Column, Column]:
    """The days asked for, and whether a row of the run log is of one of them."""
    days = days_between(F.lit(start), F.lit(end))
    return days, (F.col("dataset") == contract.table) & F.array_contains(days, F.col("partition"))


def partitions_complete(contract: TableContract, start: date, end: date) -> Precondition:
    """Each day of the window is committed and has rows. A cadence other than daily can't be judged."""
    days, inside = _window(contract, start, end)
    missing = F.array_except(days, F.collect_set(F.when(inside, F.col("partition"))))
    hollow = F.array_sort(F.collect_set(F.when(inside & (F.col("rows") == 0), F.col("partition"))))
    measures = {"expected": F.first(F.size(days)), "missing": F.size(missing), "zero_row": F.size(hollow), "first_missing": F.slice(missing, 1, NAMED), "first_zero_row": F.slice(hollow, 1, NAMED)}
    if contract.cadence != "daily":
        measures = {"cadence": F.first(F.lit(contract.cadence))}

    def judge(seen: dict[str, Any]) -> Verdict:
        if "cadence" in seen:
            return Verdict.INCONCLUSIVE
        return Verdict.FAIL if seen["missing"] + seen["zero_row"] else Verdict.PASS

    return LogCondition(f"{contract.table} complete {start}..{end}", measures, judge)


def fresh_within(contract: TableContract, max_lag_days: int, *, today: date | None = None) -> Precondition:
    """The newest partition with rows is at most so old. A table without rows fails; partitions that aren't days can't be judged."""
    last = F.max(F.when((F.col("dataset") == contract.table) & (F.col("rows") > 0), F.coalesce("partition", F.lit(""))))
    lag = F.datediff(F.lit(today or utc_today()), F.try_to_date(last, "yyyy-MM-dd"))

    def judge(seen: dict[str, Any]) -> Verdict:
        if seen["last"] is None:
            return Verdict.FAIL
        return Verdict.INCONCLUSIVE if seen["lag_days"] is None else Verdict.PASS if seen["lag_days"] <= max_lag_days else Verdict.FAIL

    return LogCondition(f"{contract.table} fresh within {max_lag_days} days", {"last": last, "lag_days": lag}, judge)


def min_rows(contract: TableContract, start: date, end: date, floor: int) -> Precondition:
    """With fewer rows in the window than this nothing can be concluded."""
    _, inside = _window(contract, start, end)
    total = F.coalesce(F.sum(F.when(inside, F.col("rows"))), F.lit(0))
    return LogCondition(f"{contract.table} rows >= {floor}", {"rows": total, "floor": F.first(F.lit(floor))}, lambda seen: Verdict.PASS if seen["rows"] >= floor else Verdict.INCONCLUSIVE)
