"""Alert queries over a table of spans, and their definitions.

Look-back periods are part of each query: ``now`` (microseconds) is given, so an
alert can be tested and replayed.
"""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Periods in minutes.
FAILURE_MINUTES = 15
LOOKBACK_MINUTES = 7 * 24 * 60
MIN_GRACE_MINUTES = 60


def _since(ts: str, now: int, minutes: int) -> Column:
    return F.col(ts).between(now - minutes * 60_000_000, now)


def failed(spans: DataFrame, service: str) -> DataFrame:
    return spans.where((F.col("service_name") == service) & (F.col("dbos_operation_type") == "workflow") & (F.col("span_status") == "ERROR"))


def failures(spans: DataFrame, by: list[str], ts: str) -> DataFrame:
    return spans.groupBy(*by).agg(F.count("*").alias("failures"), F.max(ts).alias("last_seen"))


def first_seen_since(spans: DataFrame, by: list[str], ts: str, since: Any) -> DataFrame:
    """Groups whose first row is not before ``since``."""
    return spans.groupBy(*by).agg(F.count("*").alias("failures"), F.min(ts).alias("first_seen")).where(F.col("first_seen") >= F.lit(since))


def absence(spans: DataFrame) -> DataFrame:
    """One row iff nothing matched."""
    return spans.agg(F.count("*").alias("succeeded")).where("succeeded = 0")


BY = ["operation_name", "error_signature"]


def workflow_failures(spans: DataFrame, service: str, now: int, by: list[str] | None = None) -> DataFrame:
    return failures(failed(spans, service).where(_since("_timestamp", now, FAILURE_MINUTES)), by or BY, "_timestamp")


def new_errors(spans: DataFrame, service: str, now: int, by: list[str] | None = None) -> DataFrame:
    seen = failed(spans, service).where(_since("_timestamp", now, LOOKBACK_MINUTES + FAILURE_MINUTES))
    return first_seen_since(seen, by or BY, "_timestamp", now - FAILURE_MINUTES * 60_000_000)


def heartbeat(spans: DataFrame, service: str, workflow: str, cron: str, now: int) -> DataFrame:
    minutes = cron_interval_minutes(cron)
    ok = (F.col("service_name") == service) & (F.col("operation_name") == workflow) & (F.col("span_status") == "OK")
    return absence(spans.where(ok & _since("_timestamp", now, minutes + max(MIN_GRACE_MINUTES, minutes // 12))))


def _field(spec: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in spec.split(","):
        span, _, step = part.partition("/")
        a, b = (low, high) if span == "*" else (int(span.split("-")[0]), int(span.split("-")[-1]) if "-" in span or not step else high)
        out |= set(range(a, b + 1, int(step or 1)))
    return out


def cron_fires(cron: str, start: datetime, n: int) -> list[datetime]:
    """The next fires of a five-field cron, UTC."""
    minute, hour, dom, month, dow = cron.split()
    minutes, hours, months = _field(minute, 0, 59), _field(hour, 0, 23), _field(month, 1, 12)
    days, weekdays = _field(dom, 1, 31), {d % 7 for d in _field(dow, 0, 7)}
    out, day = [], start.replace(hour=0, minute=0, second=0, microsecond=0)
    for _ in range(366 * 30):
        hit = day.day in days, (day.weekday() + 1) % 7 in weekdays
        # Both restricted: either is enough, as cron has it.
        on = any(hit) if dom != "*" and dow != "*" else all(hit)
        if day.month in months and on:
            for h in sorted(hours):
                for m in sorted(minutes):
                    t = day.replace(hour=h, minute=m)
                    if t > start:
                        out.append(t)
                        if len(out) == n:
                            return out
        day += timedelta(days=1)
    return out


def cron_interval_minutes(cron: str, samples: int = 400) -> int:
    """The longest wait between fires, over so many of them from the epoch on."""
    times = [int(t.timestamp()) // 60 for t in cron_fires(cron, datetime.fromtimestamp(0, timezone.utc), samples)]
    return max(map(int.__sub__, times[1:], times))


@dataclass(frozen=True)
class Alert:
    name: str
    description: str
    kind: str
    arguments: dict[str, Any] = field(default_factory=dict)
    period_minutes: int = FAILURE_MINUTES
    frequency_minutes: int = FAILURE_MINUTES
    silence_minutes: int = 60

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[a-z][a-z0-9_]*", self.name):
            raise ValueError(f"{self.name!r} is not snake_case")
        for v in self.arguments.values():
            if isinstance(v, str) and not re.fullmatch(r"[\w .:*,/<>-]*", v):
                raise ValueError(f"{v!r} can't stand in a query")

    def run(self, spans: DataFrame, now: int) -> DataFrame:
        return {"failures": workflow_failures, "new": new_errors, "heartbeat": heartbeat}[self.kind](spans, now=now, **self.arguments)

    def payload(self) -> dict[str, Any]:
        return {"name": self.name, "description": self.description, "kind": self.kind, "arguments": self.arguments, "period": self.period_minutes, "frequency": self.frequency_minutes, "silence": self.silence_minutes}


def snake(name: str) -> str:
    return re.sub(r"\W+", "_", name).strip("_").lower()


def standard_alerts(project: str, schedules: list[dict[str, str]] = ()) -> list[Alert]:
    """Failures, new errors, and a heartbeat for each schedule (schedule_name, workflow, schedule)."""
    p = snake(project)
    out = [
        Alert(f"{p}_workflow_failures", f"Workflows of {project} that failed in the last {FAILURE_MINUTES} minutes.", "failures", {"service": project}),
        Alert(f"{p}_new_errors", f"Error signatures of {project} first seen in the last {FAILURE_MINUTES} minutes.", "new", {"service": project}, LOOKBACK_MINUTES + FAILURE_MINUTES, FAILURE_MINUTES, FAILURE_MINUTES),
    ]
    for s in schedules:
        every = cron_interval_minutes(s["schedule"])
        out.append(Alert(f"{p}_heartbeat_{snake(s['schedule_name'])}", f"No successful {s['workflow']} run in time.", "heartbeat", {"service": project, "workflow": s["workflow"], "cron": s["schedule"]}, every + max(MIN_GRACE_MINUTES, every // 12), min(60, max(FAILURE_MINUTES, every // 4)), max(60, every // 4)))
    return out


def plan_upsert(wanted: list[Alert], held: dict[str, dict[str, Any]]) -> dict[str, list[str]]:
    """What applying would do, by name. Nothing is ever deleted; alerts nobody manages are reported."""
    want = {a.name: a.payload() for a in wanted}
    return {"create": sorted(set(want) - set(held)), "update": sorted(n for n in set(want) & set(held) if want[n] != held[n]), "same": sorted(n for n in set(want) & set(held) if want[n] == held[n]), "unmanaged": sorted(set(held) - set(want))}


class AlertClient(Protocol):
    """Where alerts are kept. ``HttpAlerts`` is one over JSON; tests use another."""

    def held(self) -> dict[str, dict[str, Any]]: ...

    def put(self, name: str, payload: dict[str, Any], new: bool) -> None: ...


@dataclass(frozen=True)
class HttpAlerts:
    """Alerts behind a JSON interface: GET lists them, POST creates one, PUT <name> replaces it."""

    url: str
    headers: dict[str, str] = field(default_factory=dict)
    timeout_s: float = 30

    def _call(self, method: str, url: str, body: Any = None) -> Any:
        request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json", **self.headers}, method=method)
        with urllib.request.urlopen(request, timeout=self.timeout_s) as answer:
            raw = answer.read()
        return json.loads(raw) if raw else None

    def held(self) -> dict[str, dict[str, Any]]:
        return {a["name"]: a for a in self._call("GET", self.url) or []}

    def put(self, name: str, payload: dict[str, Any], new: bool) -> None:
        self._call("POST" if new else "PUT", self.url if new else f"{self.url}/{name}", payload)


def apply(client: AlertClient, alerts: list[Alert], *, dry_run: bool = True) -> dict[str, list[str]]:
    """Bring the kept alerts to what is wanted, by name, and say what was (or would be) done. Nothing is deleted."""
    plan = plan_upsert(alerts, client.held())
    wanted = {a.name: a.payload() for a in alerts}
    for kind in ("create", "update") if not dry_run else ():
        for name in plan[kind]:
            client.put(name, wanted[name], kind == "create")
    return plan


@dataclass(frozen=True)
class TelemetrySettings:
    """Where spans and logs go; off unless an endpoint is named."""

    endpoint: str | None = None
    service: str = "trustlake"
    headers: tuple[tuple[str, str], ...] = ()
    sample: float = 1.0

    @property
    def enabled(self) -> bool:
        return bool(self.endpoint)

    @staticmethod
    def from_env(env: Mapping[str, str]) -> TelemetrySettings:
        """TRUSTLAKE_TELEMETRY_ENDPOINT, _SERVICE, _HEADERS (a=b,c=d) and _SAMPLE (0 to 1)."""
        get = lambda name, default="": env.get(f"TRUSTLAKE_TELEMETRY_{name}", default).strip()
        pairs = [p.partition("=") for p in get("HEADERS").split(",") if p.strip()]
        if any(not sep for _, sep, _ in pairs):
            raise ValueError("headers are name=value, with commas between")
        sample = float(get("SAMPLE", "1"))
        if not 0 <= sample <= 1:
            raise ValueError(f"a share of spans is between 0 and 1, not {sample}")
        endpoint = get("ENDPOINT")
        if endpoint and not endpoint.startswith(("http://", "https://")):
            raise ValueError(f"{endpoint!r} is no http address")
        return TelemetrySettings(endpoint or None, get("SERVICE", "trustlake"), tuple((k.strip(), v.strip()) for k, _, v in pairs), sample)

    def sampled(self, spans: DataFrame, key: str = "trace_id") -> DataFrame:
        """The share of traces that is kept, whole traces at a time; nothing where telemetry is off."""
        share = self.sample if self.enabled else 0.0
        return spans.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000))


def scrub_spans(spans: DataFrame) -> DataFrame:
    """Identifiers out of messages and traces, and the error signature on each span."""
    from ..functions.scrub import error_signature, scrub, scrub_stacktrace

    out = spans
    if "message" in spans.columns:
        out = out.withColumn("error_signature", error_signature(F.col("message"))).withColumn("message", scrub(F.col("message")))
    return out.withColumn("stacktrace", scrub_stacktrace(F.col("stacktrace"))) if "stacktrace" in spans.columns else out
