"""Schedules as data: who runs when, what is due, and replay of a window, each fire once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.alerts import cron_fires
from ..sources.lake import Lake
from .config import workflow_id

ROLES = ("worker", "cli")


class RoleError(RuntimeError):
    pass


@dataclass(frozen=True)
class Schedule:
    """``run`` gets the lake, the time it stands for, and the run id that its commits must carry."""

    name: str
    dataset: str
    cron: str
    run: Callable[[Lake, datetime, str], Any]

    def run_id(self, at: datetime) -> str:
        return workflow_id(self.name, at.strftime("%Y-%m-%dT%H%M"))

    def fires(self, start: datetime, end: datetime) -> Iterator[datetime]:
        """Fire times after ``start`` up to ``end``."""
        at = start
        while nearest := cron_fires(self.cron, at, 1):
            at = nearest[0]
            if at > end:
                return
            yield at


def table(lake: Lake, schedules: Iterable[Schedule], start: datetime, end: datetime) -> DataFrame:
    """(schedule, fire, run_id, done): every fire of a window, and whether the run log has it."""
    rows = [(s.name, s.dataset, at, s.run_id(at)) for s in schedules for at in s.fires(start, end)]
    fires = lake.spark.createDataFrame(rows, "schedule string, dataset string, fire timestamp, run_id string")
    done = lake.reader().run_rows().select("dataset", "run_id").distinct().withColumn("done", F.lit(True))
    return fires.join(done, ["dataset", "run_id"], "left").select("schedule", "fire", "run_id", F.coalesce("done", F.lit(False)).alias("done")).orderBy("fire", "schedule")


class Launch:
    """A process over a set of schedules. A worker runs them; a command line may look, and must not."""

    def __init__(self, lake: Lake, *schedules: Schedule, role: str = "cli") -> None:
        if role not in ROLES:
            raise RoleError(f"a process is one of {ROLES}, not {role!r}")
        if len({s.name for s in schedules}) < len(schedules):
            raise ValueError("two schedules share a name")
        self.lake, self.schedules, self.role = lake, {s.name: s for s in schedules}, role

    def status(self, start: datetime, end: datetime) -> DataFrame:
        return table(self.lake, self.schedules.values(), start, end)

    def backfill(self, start: datetime, end: datetime) -> list[str]:
        """Runs what the window asks for and the run log lacks, in the order of time; returns the run ids. Run again, it does nothing."""
        if self.role != "worker":
            raise RoleError("only a worker runs schedules")
        todo = [(r["schedule"], r["fire"], r["run_id"]) for r in self.status(start, end).where("not done").collect()]
        for name, at, run_id in todo:
            self.schedules[name].run(self.lake, at.replace(tzinfo=at.tzinfo or timezone.utc), run_id)
        return [run_id for *_, run_id in todo]

    def tick(self, now: datetime | None = None, look_back: timedelta = timedelta(days=1)) -> list[str]:
        """What a worker does whenever it wakes: all that is due and was missed."""
        now = now or datetime.now(timezone.utc)
        return self.backfill(now - look_back, now)
