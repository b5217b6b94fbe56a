"""The worked pipeline: CSV drop -> typed -> cleaned -> checked -> committed -> asked."""

from __future__ import annotations

from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import Column as C
from ..contracts import TableContract
from ..functions import text
from ..operators.checks import Rate, check, measure_dirt
from ..operators.gate import Answer, Refusal, answer, min_rows, partitions_complete
from ..operators.graph import Canary, GraphSpec, NodeSpec, RelSpec, publish
from ..operators.metrics import SemanticTable, count_true
from ..sources.csv import manifest_groups, read_day
from ..sources.lake import Lake, PartitionExistsError, Reader, Receipt, Writer
from .config import workflow_id

# The drop's columns, telco prefixes and the contract.
SOURCE_COLUMNS = ("created_at", "user_id", "user_phone", "song_id", "country_iso", "use_type", "download_or_stream_count", "supporting_details")
TELCO = ["BD_TELCO", "PS_TELCO"]
USAGE = TableContract(
    "UsageEvent", "usage.events_clean",
    (C("event_date", "date", True), C("created_at", "datetime_utc", True), C("user_id", "string"), C("phone_raw", "string"), C("phone_number", "string"), C("song_id", "int64"), C("country_iso", "string", True, "^[A-Z]{2,3}$"), C("use_type", "string", True), C("download_or_stream_count", "int64", True, minimum=1, maximum=1), C("supporting_details", "string")),
    partition_by="event_date", cadence="daily", expected_start="2023-01-01",
)


@check("use_type", "phone_number")
def v6_phone_only_on_telco() -> Column:
    """A phone number stands only on telco use types."""
    return F.col("phone_number").isNull() | text.holds(text.starts_with_any(F.col("use_type"), TELCO))


@check("phone_number")
def v21_phone_no_leading_plus() -> Column:
    """No phone number begins with +."""
    return ~text.holds(F.col("phone_number").startswith("+"))


@check("phone_number")
def v24_phone_no_dot() -> Column:
    """No phone number holds a dot."""
    return ~text.holds(F.col("phone_number").contains("."))


USAGE_CHECKED = USAGE.with_checks(v6_phone_only_on_telco, v21_phone_no_leading_plus, v24_phone_no_dot)


def events_typed(events_raw: DataFrame) -> DataFrame:
    b = lambda c: text.blank_to_null(F.col(c))
    return events_raw.select(
        text.strict_timestamp(F.col("created_at")).alias("created_at"), b("user_id").alias("user_id"), F.col("user_phone").alias("phone_raw"),
        text.strict_long(b("song_id")).alias("song_id"), F.coalesce(F.upper(b("country_iso")), F.lit("ZZ")).alias("country_iso"), F.upper(F.col("use_type")).alias("use_type"),
        text.strict_long(F.col("download_or_stream_count")).alias("download_or_stream_count"), b("supporting_details").alias("supporting_details"),
    )


def events_clean(events_typed: DataFrame) -> DataFrame:
    return events_typed.withColumns({"event_date": F.to_date("created_at"), "phone_number": text.normalize_phone(F.col("phone_raw"))}).select(*USAGE.names)


def phone_dirt(events_typed: DataFrame) -> Any:
    return measure_dirt(events_typed, "phone_raw", text.normalize_phone)


def run_day(lake: Lake, drop_dir: str, day: date, attempt: int | None = None) -> Receipt:
    """Ingest a day. Run twice under one id it is committed once."""
    run_id = workflow_id("usage-daily", day.isoformat(), attempt=attempt)
    done = lake.reader().run_rows(USAGE.table).where(F.col("run_id") == run_id).first()
    if done:
        return Receipt(done["dataset"], done["partition"], done["mode"], done["rows"], run_id, done["code_version"], done["contract_hash"], done["snapshot_id"])
    writer = lake.writer()
    writer.ensure_table(USAGE)
    typed = events_typed(read_day(lake.spark, drop_dir, day, SOURCE_COLUMNS))
    dirt = phone_dirt(typed)
    return writer.commit_partition(USAGE_CHECKED, day, events_clean(typed), run_id=run_id, stats=dirt.to_dict())


def backfill(lake: Lake, drop_dir: str, days: list[date]) -> list[Receipt]:
    return [run_day(lake, drop_dir, d) for d in days]


def register_frozen(writer: Writer, contract: TableContract, manifest: DataFrame, *, run_tag: str) -> dict[str, Receipt | None]:
    """Adopt a manifest's files, each partition in its own commit; what is there already is passed over."""
    writer.ensure_table(contract)
    out: dict[str, Receipt | None] = {}
    for part, (files, rows) in manifest_groups(manifest).items():
        try:
            out[part] = writer.register_files(contract, part, files, run_id=workflow_id(run_tag, part), expected_rows=rows)
        except PartitionExistsError:
            out[part] = None
    return out


def semantic(reader: Reader) -> SemanticTable:
    telco = text.holds(text.starts_with_any(F.col("use_type"), TELCO))
    return SemanticTable(reader.scan(USAGE)).with_dimensions(event_date=F.col("event_date"), country=F.col("country_iso"), use_type=F.col("use_type")).with_measures(events=F.count("*"), telco_events=count_true(telco), listeners=F.count_distinct("user_id"))


def daily_events(reader: Reader, start: date, end: date) -> Answer | Refusal:
    compute = lambda r: semantic(r).where(F.col("event_date").between(F.lit(start), F.lit(end))).query(["event_date"], ["events"]).orderBy("event_date")
    return answer("events per day", reader=reader, compute=compute, preconditions=[partitions_complete(USAGE, start, end)], datasets=[USAGE])


def telco_share(reader: Reader, start: date, end: date, floor: int = 30) -> Answer | Refusal:
    def compute(r: Reader) -> float | None:
        row = semantic(r).where(F.col("event_date").between(F.lit(start), F.lit(end))).query([], ["telco_events", "events"]).first()
        return Rate(row["telco_events"] or 0, row["events"] or 0).value

    return answer("share of telco events", reader=reader, compute=compute, preconditions=[partitions_complete(USAGE, start, end), min_rows(USAGE, start, end, floor)], datasets=[USAGE])


_KNOWN = "user_id IS NOT NULL AND song_id IS NOT NULL"
LISTENING = GraphSpec(
    "listening",
    (NodeSpec("listener", "user_id", f"SELECT DISTINCT user_id FROM usage.events_clean WHERE {_KNOWN}"), NodeSpec("song", "song_id", f"SELECT DISTINCT song_id FROM usage.events_clean WHERE {_KNOWN}")),
    (RelSpec("played", "listener", "song", f'SELECT user_id AS "from", song_id AS "to", count(*) AS plays FROM usage.events_clean WHERE {_KNOWN} GROUP BY 1, 2'),),
    (
        Canary("songs_per_listener", f"SELECT user_id, count(DISTINCT song_id) FROM usage.events_clean WHERE {_KNOWN} GROUP BY 1", lambda g: g.degree("played")),
        Canary("listeners_per_song", f"SELECT song_id, count(DISTINCT user_id) FROM usage.events_clean WHERE {_KNOWN} GROUP BY 1", lambda g: g.degree("played", backward=True)),
        Canary("plays", f"SELECT count(*) FROM usage.events_clean WHERE {_KNOWN}", lambda g: g.total("played", "plays")),
    ),
)


def build_and_publish(lake: Lake, graph_dir: str, require_day: date) -> dict[str, Any]:
    """The graph waits for its day: without it nothing is built."""
    reader = lake.reader()
    evidence = partitions_complete(USAGE, require_day, require_day).evaluate(reader)
    if evidence.verdict.value != "PASS":
        return {"status": "skipped", "evidence": evidence.to_dict()}
    return {"status": "published", **publish(LISTENING, reader, graph_dir)}


