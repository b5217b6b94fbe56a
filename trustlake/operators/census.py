"""Trust queries: what the run log says, what is missing, and whether tables agree with it."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import TableContract
from ..sources.lake import Reader


def utc_today() -> date:
    return datetime.now(timezone.utc).date()


def expected_days(contract: TableContract, today: date | None = None) -> list[str]:
    """From the contract's start through yesterday (UTC); none unless the cadence is daily."""
    if contract.cadence != "daily" or not contract.expected_start:
        return []
    start, end = date.fromisoformat(str(contract.expected_start)), (today or utc_today()) - timedelta(days=1)
    return [(start + timedelta(days=i)).isoformat() for i in range((end - start).days + 1)]


def census_frame(runlog: DataFrame) -> DataFrame:
    """Per dataset, from run-log rollup rows (dataset, partition, rows, code_version, committed_at)."""
    return runlog.groupBy("dataset").agg(
        F.count("*").alias("partitions"), F.sum("rows").alias("rows"), F.count_if(F.col("rows") == 0).alias("zero_row_partitions"),
        F.min("partition").alias("first_partition"), F.max("partition").alias("last_partition"), F.count_distinct("code_version").alias("code_versions"), F.max("committed_at").alias("last_commit"),
    )


CENSUS = "dataset string, partitions long, rows long, zero_row_partitions long, missing_partitions long, first_partition string, last_partition string, lag_days long, code_versions long, last_commit timestamp"


def census(reader: Reader, contracts: tuple[TableContract, ...] = (), *, today: date | None = None) -> DataFrame:
    """Logged and contracted datasets. A zero-row partition counts as present here; missing is null where nothing is expected."""
    now = today or utc_today()
    log = reader.runlog()
    found = {r["dataset"]: r.asDict() for r in census_frame(log).collect()}
    by_table = {c.table: c for c in contracts}
    rows = []
    for dataset in sorted(set(found) | set(by_table)):
        r, c = found.get(dataset, {}), by_table.get(dataset)
        expected = set(expected_days(c, now)) if c else set()
        missing = missing_partitions(reader, c, today=now) if c and expected else []
        last = r.get("last_partition")
        lag = (now - date.fromisoformat(last)).days if c and c.cadence == "daily" and last else None
        rows.append((dataset, r.get("partitions", 0), r.get("rows", 0), r.get("zero_row_partitions", 0), len(missing) if expected else None, r.get("first_partition"), last, lag, r.get("code_versions", 0), r.get("last_commit")))
    return reader.spark.createDataFrame(rows, CENSUS)


def missing_days(present: DataFrame, day: str, start: Column, end: Column) -> DataFrame:
    """Days from start through end without a row: an anti-join, so only the gaps are materialised."""
    days = present.sparkSession.range(1).select(F.explode(F.sequence(start, end)).alias(day))
    return days.join(present.select(day).distinct(), day, "left_anti")


def missing_partitions(reader: Reader, contract: TableContract, *, today: date | None = None) -> list[str]:
    """Expected days that were never committed (a zero-row commit is not missing)."""
    have = {r["partition"] for r in reader.runlog(contract.table).select("partition").collect()}
    return [d for d in expected_days(contract, today) if d not in have]


def reconcile(logged: DataFrame, actual: DataFrame) -> DataFrame:
    """(partition, runlog_rows, table_rows) where they differ; a side that lacks the partition counts 0."""
    both = logged.join(actual, "partition", "full").select("partition", F.coalesce("runlog_rows", F.lit(0)).alias("runlog_rows"), F.coalesce("table_rows", F.lit(0)).alias("table_rows"))
    return both.where("runlog_rows <> table_rows").orderBy(F.col("partition").asc_nulls_last())


def deep_census(reader: Reader, contract: TableContract) -> DataFrame:
    """Run log against the table itself."""
    logged = reader.runlog(contract.table).select("partition", F.col("rows").alias("runlog_rows"))
    key = F.col(contract.partition_by).cast("string") if contract.partition_by else F.lit(None).cast("string")
    actual = reader.scan(contract).groupBy(key.alias("partition")).agg(F.count("*").alias("table_rows"))
    if not contract.partition_by:  # one group with a null key on both sides: nulls don't join
        logged, actual = (x.withColumn("partition", F.lit("")) for x in (logged, actual))
    return reconcile(logged, actual)
