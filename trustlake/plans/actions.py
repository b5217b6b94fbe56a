"""Durable actions: preconditions, approval, one effect, an append-only record."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import Column, TableContract
from ..operators.checks import Evidence, Verdict, worst
from ..operators.gate import Precondition
from ..sources.lake import Lake

APPROVAL_TIMEOUT_S = 7 * 24 * 3600
LOG = TableContract("ActionLog", "_meta.actions", (Column("action_id", "string", True), Column("name", "string", True), Column("state", "string", True), Column("seq", "int64", True), Column("at", "datetime_utc", True), Column("actor", "string"), Column("payload", "string"), Column("evidence", "string")))
FINAL = ("refused", "refused_after_approval", "expired", "rejected", "done")


class ActionError(RuntimeError):
    pass


@dataclass(frozen=True)
class Action:
    name: str
    effect: Callable[[dict[str, Any]], Any]
    preconditions: tuple[Precondition, ...] = ()
    approval: bool = True
    timeout_s: float = APPROVAL_TIMEOUT_S


def action(name: str, *, preconditions: Sequence[Precondition] = (), approval: bool = True, approval_timeout_s: float = APPROVAL_TIMEOUT_S) -> Callable[[Callable[[dict[str, Any]], Any]], Action]:
    return lambda effect: Action(name, effect, tuple(preconditions), approval, approval_timeout_s)


class Actions:
    """The state machine over a log table; each step is appended once, under its own run id."""

    def __init__(self, lake: Lake, *actions: Action) -> None:
        self.lake, self.actions = lake, {a.name: a for a in actions}
        self.writer = lake.writer()
        self.writer.ensure_table(LOG)

    def _append(self, action_id: str, name: str, state: str, now: datetime, actor: str | None = None, payload: dict | None = None, evidence: list[Evidence] = ()) -> str:
        n = self.audit(action_id).count()
        row = [(action_id, name, state, n, now, actor, None if payload is None else json.dumps(payload, sort_keys=True), json.dumps([e.to_dict() for e in evidence], default=str))]
        frame = self.lake.spark.createDataFrame(row, LOG.struct())
        self.writer.append(LOG, frame, run_id=f"{action_id}:{state}")
        return state

    def _weigh(self, a: Action) -> tuple[bool, list[Evidence]]:
        reader = self.lake.reader()
        evidence = [p.evaluate(reader) for p in a.preconditions]
        return not evidence or worst(evidence) is Verdict.PASS, evidence

    def audit(self, action_id: str) -> DataFrame:
        return self.lake.reader().scan(LOG, F.col("action_id") == action_id).orderBy("seq")

    def status(self, action_id: str) -> str | None:
        row = self.lake.reader().scan(LOG, F.col("action_id") == action_id).agg(F.max_by("state", "seq").alias("s")).first()
        return row["s"]

    def propose(self, name: str, action_id: str, payload: dict[str, Any], now: datetime | None = None, actor: str | None = None) -> str:
        """Proposing again returns the state that the action is in."""
        if held := self.status(action_id):
            return held
        now, a = now or datetime.now(timezone.utc), self.actions[name]
        ok, evidence = self._weigh(a)
        if not ok:
            return self._append(action_id, name, "refused", now, actor, payload, evidence)
        if a.approval:
            return self._append(action_id, name, "pending_approval", now, actor, payload, evidence)
        return self._effect(a, action_id, payload, now, actor, evidence)

    def _effect(self, a: Action, action_id: str, payload: dict, now: datetime, actor: str | None, evidence: list[Evidence]) -> str:
        # The claim is committed first and once: of two workers, one goes on.
        before = self.lake.current_snapshot()
        self._append(action_id, a.name, "running", now, actor, payload, evidence)
        if self.lake.current_snapshot() == before:
            return self.status(action_id) or "running"
        a.effect(payload)
        return self._append(action_id, a.name, "done", now, actor)

    def decide(self, action_id: str, approve: bool, actor: str, now: datetime | None = None) -> str:
        now = now or datetime.now(timezone.utc)
        first = self.audit(action_id).first()
        if first is None:
            raise ActionError(f"no action {action_id}")
        if (state := self.status(action_id)) != "pending_approval":
            return state
        a = self.actions[first["name"]]
        if now - first["at"].replace(tzinfo=timezone.utc) > timedelta(seconds=a.timeout_s):
            return self._append(action_id, a.name, "expired", now, actor)
        if not approve:
            return self._append(action_id, a.name, "rejected", now, actor)
        ok, evidence = self._weigh(a)
        if not ok:
            return self._append(action_id, a.name, "refused_after_approval", now, actor, None, evidence)
        return self._effect(a, action_id, json.loads(first["payload"]), now, actor, evidence)
