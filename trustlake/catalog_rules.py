"""Queries for contracts, checks, mutations, gates, drops and the lake's bookkeeping, with their DuckDB counterparts.

What an operator returns as evidence or a message becomes a one-row frame, so
that it can be held against SQL over the same tables.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog as Q
from .catalog import EVENTS, PARTS, query, t
from .contracts import SPARK_NAMES, ContractError, TableContract, resolve_dtype
from .contracts import Column as C
from .functions import scrub, text
from .operators import alerts, mutate
from .operators import checks as K
from .operators.census import expected_days
from .operators.gate import Refusal, answer, fresh_within, min_rows, partitions_complete
from .operators.graph import open_current
from .plans import usage
from .shared import shared_dir
from .sources import csv
from .sources.lake import LakeError, Lake


def one(s: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return s.createDataFrame(list(rows), schema)


def evidence(s: SparkSession, e: K.Evidence, **measured: str) -> DataFrame:
    """Verdict and the named measures of a piece of evidence."""
    schema = ", ".join(["verdict string", *[f"{k.replace(' ', '_')} {kind}" for k, kind in measured.items()]])
    return one(s, schema, (e.verdict.value, *[e.measured[k.replace("__", " ")] for k in measured]))


def scratch(s: SparkSession) -> str:
    return f"{shared_dir(s)}/scratch-{uuid.uuid4().hex}"


# -- contracts
ORDERS = TableContract(
    "Orders", "sales.orders",
    (C("o_orderkey", "int64", True, minimum=0), C("o_custkey", "int64", True, maximum=100), C("o_orderstatus", "string", allowed=("F", "O")), C("o_totalprice", "float64", minimum=1000.0), C("o_orderdate", "datetime"), C("o_orderpriority", "string", pattern="^[1-3]-")),
    grain=("o_custkey",),
)
_BROKEN = """SELECT * FROM (
  SELECT 'o_custkey maximum' AS rule, count(*) FILTER (WHERE o_custkey > 100) AS n FROM orders
  UNION ALL SELECT 'o_orderstatus allowed', count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) FROM orders
  UNION ALL SELECT 'o_totalprice minimum', count(*) FILTER (WHERE o_totalprice < 1000) FROM orders
  UNION ALL SELECT 'o_orderpriority pattern', count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-')) FROM orders
  UNION ALL SELECT 'grain', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1)
) WHERE n > 0"""


@query(_BROKEN)
def contract_failures(s: SparkSession, d: str) -> DataFrame:
    """Rules that fail, with rows; the grain's name is cut to its first word."""
    return one(s, "rule string, n long", *[("grain" if k.startswith("grain") else k, n) for k, n in ORDERS.failures(t(s, d, "orders")).items()])


@query(f"SELECT count(*) AS rules, CAST(sum(n) AS BIGINT) AS n FROM ({_BROKEN})")
def contract_message(s: SparkSession, d: str) -> DataFrame:
    """The error of a validation names every rule and its rows; here they are read from its text."""
    try:
        ORDERS.validate(t(s, d, "orders"))
    except ContractError as e:
        said = one(s, "message string", (str(e),))
        counts = said.select(F.explode(F.regexp_extract_all("message", F.lit(r": (\d+) rows"), F.lit(1))).alias("n"))
        return counts.agg(F.count("*").alias("rules"), F.sum(F.col("n").cast("long")).alias("n"))
    return one(s, "rules long, n long", (0, 0))


@query("SELECT * FROM (VALUES ('string','string'),('int64','bigint'),('int32','int'),('int16','smallint'),('float64','double'),('bool','boolean'),('date','date'),('datetime_utc','timestamp'),('datetime','timestamp_ntz'),('decimal(12,3)','decimal(12,3)')) v(name, spark)")
def contract_dtypes(s: SparkSession, d: str) -> DataFrame:
    return one(s, "name string, spark string", *[(n, resolve_dtype(n).simpleString()) for n in [*SPARK_NAMES, "decimal(12,3)"]])


@query("SELECT * FROM (VALUES ('missing column event_date'),('unexpected column props'),('unexpected column ts'),('value: string instead of double')) v(said)")
def contract_schema_diff(s: SparkSession, d: str) -> DataFrame:
    frame = t(s, d, "events").withColumn("value", F.col("value").cast("string"))
    return one(s, "said string", *[(x,) for x in EVENTS.schema_diff(frame.schema)])


@query("SELECT true AS same_after_checks, false AS same_after_change, 16 AS length")
def contract_fingerprint(s: SparkSession, d: str) -> DataFrame:
    mark = EVENTS.fingerprint()
    return one(s, "same_after_checks boolean, same_after_change boolean, length int", (EVENTS.with_checks(usage.v24_phone_no_dot).fingerprint() == mark, replace(EVENTS, cadence=None).fingerprint() == mark, len(mark)))


@query("SELECT event_id, CAST(ts AS DATE) AS event_date, user_id, event_type, value FROM events WHERE false")
def contract_empty(s: SparkSession, d: str) -> DataFrame:
    return EVENTS.empty(s)


@query("SELECT 'p_partkey BIGINT NOT NULL,p_brand STRING,p_size INT' AS ddl")
def contract_ddl(s: SparkSession, d: str) -> DataFrame:
    bare = replace(PARTS, columns=tuple(replace(c, minimum=None) for c in PARTS.columns))
    return one(s, "ddl string", (bare.ddl_columns(),))


@query("SELECT p_partkey, p_brand, p_size FROM part")
def contract_node(s: SparkSession, d: str) -> DataFrame:
    """A validated frame is passed on as it is."""
    return PARTS.validate(t(s, d, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand", "p_size"))


# -- checks
def _calls(s: SparkSession, d: str) -> DataFrame:
    """Orders as usage rows: phones of several kinds, on telco and other use types."""
    k = F.col("o_orderkey")
    phone = F.when(k % 5 == 0, None).when(k % 5 == 1, F.concat(F.lit("+255"), k)).when(k % 5 == 2, F.concat(F.lit("255"), k, F.lit(".0"))).otherwise(F.concat(F.lit("255"), k))
    return t(s, d, "orders").select(k.alias("k"), F.when(k % 3 == 0, "BD_TELCO_X").when(k % 3 == 1, "PS_TELCO").otherwise("APP").alias("use_type"), phone.alias("phone_number"))


_CALLS = "(SELECT o_orderkey AS k, CASE o_orderkey%3 WHEN 0 THEN 'BD_TELCO_X' WHEN 1 THEN 'PS_TELCO' ELSE 'APP' END AS use_type, CASE o_orderkey%5 WHEN 0 THEN NULL WHEN 1 THEN '+255'||o_orderkey WHEN 2 THEN '255'||o_orderkey||'.0' ELSE '255'||o_orderkey END AS phone_number FROM orders)"


@query(f"SELECT * FROM {_CALLS} WHERE NOT (phone_number IS NULL OR starts_with(use_type,'BD_TELCO') OR starts_with(use_type,'PS_TELCO'))")
def rule_v6(s: SparkSession, d: str) -> DataFrame:
    return usage.v6_phone_only_on_telco.failing(_calls(s, d))


@query(f"SELECT * FROM {_CALLS} WHERE coalesce(starts_with(phone_number,'+'), false)")
def rule_v21(s: SparkSession, d: str) -> DataFrame:
    return usage.v21_phone_no_leading_plus.failing(_calls(s, d))


@query(f"SELECT * FROM {_CALLS} WHERE coalesce(contains(phone_number,'.'), false)")
def rule_v24(s: SparkSession, d: str) -> DataFrame:
    return usage.v24_phone_no_dot.failing(_calls(s, d))


@query(f"SELECT CASE WHEN count(*)=0 THEN 'INCONCLUSIVE' WHEN count(*) FILTER (WHERE coalesce(contains(phone_number,'.'),false))>0 THEN 'FAIL' ELSE 'PASS' END AS verdict, count(*) AS \"rows\", count(*) FILTER (WHERE coalesce(contains(phone_number,'.'),false)) AS failing FROM {_CALLS}")
def check_evidence(s: SparkSession, d: str) -> DataFrame:
    return evidence(s, usage.v24_phone_no_dot.evaluate(_calls(s, d)), rows="long", failing="long")


@query(f"WITH c AS (SELECT phone_number, regexp_replace(regexp_replace(phone_number,'^\\+',''),'\\.0$','') AS clean FROM {_CALLS}) SELECT 'PASS' AS verdict, count(*) AS \"rows\", count(*) FILTER (WHERE clean IS DISTINCT FROM phone_number) AS dirty, round(count(*) FILTER (WHERE clean IS DISTINCT FROM phone_number) / count(*), 6) AS rate FROM c")
def dirt_evidence(s: SparkSession, d: str) -> DataFrame:
    return evidence(s, K.measure_dirt(_calls(s, d), "phone_number", text.normalize_phone), rows="long", dirty="long", rate="double")


@query("SELECT 'FAIL' AS verdict, count(*) AS \"rows\", count(*) FILTER (WHERE p_brand IS DISTINCT FROM regexp_replace(p_brand,'^Brand','')) AS mismatches FROM part")
def derivation_evidence(s: SparkSession, d: str) -> DataFrame:
    """A column that was never derived: all rows but those that the derivation leaves alone are mismatches."""
    p = t(s, d, "part").withColumn("clean", F.col("p_brand"))
    return evidence(s, K.verify_derivation(p, derived="clean", witness="p_brand", derive=lambda c: F.regexp_replace(c, "^Brand", "")), rows="long", mismatches="long")


@query("SELECT 'PASS' AS verdict, count(*) AS \"rows\", count(*) FILTER (WHERE regexp_replace(p_brand,'^Brand','') <> p_brand) AS changed FROM part")
def repair_evidence(s: SparkSession, d: str) -> DataFrame:
    strip = lambda c: F.regexp_replace(c, "^Brand", "")
    pre = t(s, d, "part").withColumn("clean", F.col("p_brand"))
    return evidence(s, K.verify_repair(pre, pre.withColumn("clean", strip(F.col("p_brand"))), repaired="clean", witness="p_brand", derive=strip), rows="long", changed="long")


@query("SELECT CASE WHEN count(*) >= 1000 THEN 'PASS' ELSE 'FAIL' END AS verdict, count(*) AS \"rows\" FROM orders")
def gate_rows(s: SparkSession, d: str) -> DataFrame:
    return evidence(s, K.rows_at_least(1000)(t(s, d, "orders")), rows="long")


@query("SELECT CASE WHEN avg(CASE WHEN quality = 0 OR quality IS NULL THEN 1.0 ELSE 0 END) <= 0.5 THEN 'PASS' ELSE 'FAIL' END AS verdict, count(*) AS \"rows\", round(avg(CASE WHEN quality = 0 OR quality IS NULL THEN 1.0 ELSE 0 END), 6) AS null_rate FROM labels")
def gate_null_rate(s: SparkSession, d: str) -> DataFrame:
    frame = t(s, d, "labels").withColumn("q", F.nullif(F.col("quality"), F.lit(0)))
    return evidence(s, K.null_rate_at_most("q", 0.5)(frame), rows="long", null_rate="double")


@query("SELECT CASE WHEN avg(CASE WHEN value > 10 THEN 1.0 ELSE 0 END) >= 0.2 THEN 'PASS' ELSE 'FAIL' END AS verdict, count(*) AS \"rows\", round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0 END), 6) AS share FROM events")
def gate_share(s: SparkSession, d: str) -> DataFrame:
    return evidence(s, K.share_at_least("large values", F.col("value") > 10, 0.2)(t(s, d, "events")), rows="long", share="double")


@query("SELECT 'FAIL' AS worst, 'INCONCLUSIVE' AS of_nothing, 'PASS' AS of_good")
def verdicts(s: SparkSession, d: str) -> DataFrame:
    """The worst of what two gates say, of no evidence, and of a gate that passes."""
    good, bad = K.rows_at_least(1)(t(s, d, "region")), K.rows_at_least(100)(t(s, d, "region"))
    return one(s, "worst string, of_nothing string, of_good string", (K.worst([good, bad]).value, K.worst([]).value, K.worst([good]).value))


@query("SELECT sum(l_discount) / sum(l_quantity) AS rate, sum(l_discount) * 2 / (sum(l_quantity) * 2) AS twice, CAST(NULL AS DOUBLE) AS of_none FROM lineitem")
def rate_of_sums(s: SparkSession, d: str) -> DataFrame:
    r = K.Rate.of(t(s, d, "lineitem"), F.col("l_discount").cast("decimal(18,4)"), F.col("l_quantity").cast("decimal(18,4)"))
    r = K.Rate(float(r.num), float(r.den))
    return one(s, "rate double, twice double, of_none double", (r.value, (r + r).value, K.Rate(0, 0).value))


@query("SELECT true AS same_shuffled, false AS same_without_one")
def frames_equal(s: SparkSession, d: str) -> DataFrame:
    o = t(s, d, "supplier")
    return one(s, "same_shuffled boolean, same_without_one boolean", (K.same_rows(o, mutate.reorder_rows().apply(o)), K.same_rows(o, mutate.drop_row(3).apply(o))))


# -- mutations (of small test frames: rows are numbered by one sort)
_NUMBERED = "(SELECT *, row_number() OVER (ORDER BY s_suppkey, s_name, s_nationkey, s_acctbal) - 1 AS i FROM supplier)"


def _mutated(change: Column | mutate.Mutation):
    def run(s: SparkSession, d: str) -> DataFrame:
        return change.apply(t(s, d, "supplier"))

    return run


@query("SELECT doc_id, coalesce(nullif(quality, 0), 0) AS quality FROM labels")
def mutate_null_to_zero(s: SparkSession, d: str) -> DataFrame:
    return mutate.null_to_zero("quality").apply(t(s, d, "labels").select("doc_id", F.nullif(F.col("quality"), F.lit(0)).alias("quality")))


@query(f"SELECT s_suppkey, s_name, s_nationkey, CASE WHEN i = 2 THEN s_acctbal + 0.5 ELSE s_acctbal END AS s_acctbal FROM {_NUMBERED}")
def mutate_nudge(s: SparkSession, d: str) -> DataFrame:
    return _mutated(mutate.nudge("s_acctbal", 0.5, 2))(s, d)


@query(f"SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM {_NUMBERED} WHERE i <> 1")
def mutate_drop_row(s: SparkSession, d: str) -> DataFrame:
    return _mutated(mutate.drop_row(1))(s, d)


@query(f"SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM {_NUMBERED} UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM {_NUMBERED} WHERE i = 1")
def mutate_duplicate_row(s: SparkSession, d: str) -> DataFrame:
    return _mutated(mutate.duplicate_row(1))(s, d)


@query("SELECT * FROM supplier")
def mutate_reorder(s: SparkSession, d: str) -> DataFrame:
    return _mutated(mutate.reorder_rows())(s, d)


@query(f"SELECT s_suppkey, CASE WHEN i = 0 THEN 'x' || s_name WHEN i = 1 THEN s_name || 'y' ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM {_NUMBERED}")
def mutate_affix(s: SparkSession, d: str) -> DataFrame:
    return mutate.suffix("s_name", "y", 1).apply(_mutated(mutate.prefix("s_name", "x", 0))(s, d))


@query(f"SELECT s_suppkey, s_name, CASE WHEN i = 4 THEN 99 ELSE s_nationkey END AS s_nationkey, s_acctbal FROM {_NUMBERED}")
def mutate_set_value(s: SparkSession, d: str) -> DataFrame:
    return _mutated(mutate.set_value("s_nationkey", 99, 4))(s, d)


@query("SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN 7 ELSE s_nationkey END AS s_nationkey, s_acctbal FROM supplier")
def mutate_set_where(s: SparkSession, d: str) -> DataFrame:
    return _mutated(mutate.set_where("s_nationkey", 7, "s_acctbal < 0"))(s, d)


@query(f"SELECT s_suppkey, CASE WHEN i = 0 THEN '+' || s_name || '.0' ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM {_NUMBERED}")
def mutate_phone_artifacts(s: SparkSession, d: str) -> DataFrame:
    return mutate.float_artifact("s_name").apply(_mutated(mutate.add_leading_plus("s_name"))(s, d))


@query("SELECT 'PASS' AS before, 'FAIL' AS after")
def mutation_is_caught(s: SparkSession, d: str) -> DataFrame:
    """What live fire asks for: the clean frame passes, the mutated one doesn't."""
    clean = t(s, d, "supplier").select(F.lit("APP").alias("use_type"), F.col("s_suppkey").cast("string").alias("phone_number"))
    check = usage.v24_phone_no_dot
    return one(s, "before string, after string", (check.evaluate(clean).verdict.value, check.evaluate(mutate.float_artifact("phone_number").apply(clean)).verdict.value))


# -- gates
_DAYS = "SELECT DISTINCT CAST(ts AS DATE) AS day FROM events"


@query(f"WITH e AS (SELECT CAST(x AS DATE) AS day FROM generate_series(DATE '2023-12-28', DATE '2024-01-20', INTERVAL 1 DAY) g(x)) SELECT 'FAIL' AS verdict, CAST(count(*) AS INTEGER) AS expected, CAST(count(*) FILTER (WHERE day NOT IN ({_DAYS})) AS INTEGER) AS missing, 1 AS zero_row, (SELECT list(CAST(day AS VARCHAR) ORDER BY day)[1:5] FROM e WHERE day NOT IN ({_DAYS})) AS first_missing, ['2024-01-03'] AS first_zero_row FROM e")
def gate_partitions(s: SparkSession, d: str) -> DataFrame:
    """A window that begins before the table, with a day that was emptied."""
    lake = Q.ingest(s, d)
    lake.writer().commit_partition(EVENTS, Q.DAYS[2], EVENTS.empty(s), run_id="empty", allow_empty=True, note="withdrawn")
    got = partitions_complete(EVENTS, date(2023, 12, 28), date(2024, 1, 20)).evaluate(lake.reader())
    return evidence(s, got, expected="int", missing="int", zero_row="int", first_missing="array<string>", first_zero_row="array<string>")


@query("SELECT 'FAIL' AS verdict, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS last, CAST(DATE '2024-03-01' - max(CAST(ts AS DATE)) AS INTEGER) AS lag_days FROM events")
def gate_fresh(s: SparkSession, d: str) -> DataFrame:
    return evidence(s, fresh_within(EVENTS, 3, today=date(2024, 3, 1)).evaluate(Q.ingest(s, d).reader()), last="string", lag_days="int")


@query("SELECT 'INCONCLUSIVE' AS verdict, count(*) AS \"rows\", 1000000000 AS floor FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-05'")
def gate_min_rows(s: SparkSession, d: str) -> DataFrame:
    return evidence(s, min_rows(EVENTS, date(2024, 1, 2), date(2024, 1, 5), 10**9).evaluate(Q.ingest(s, d).reader()), rows="long", floor="int")


@query("SELECT 'refused' AS outcome, 1 AS reasons, false AS computed")
def gate_refusal(s: SparkSession, d: str) -> DataFrame:
    """One of two conditions fails: nothing is computed."""
    reader, ran = Q.ingest(s, d).reader(), []
    gates = [min_rows(EVENTS, date(2024, 1, 1), date(2024, 1, 31), 1), fresh_within(EVENTS, 3, today=date(2024, 6, 1))]
    got = answer("events", reader=reader, compute=ran.append, preconditions=gates, datasets=[EVENTS])
    return one(s, "outcome string, reasons int, computed boolean", ("refused" if isinstance(got, Refusal) else "answered", len(got.reasons) if isinstance(got, Refusal) else 0, bool(ran)))


def _usage_lake(s: SparkSession, d: str) -> Lake:
    """Events as cleaned usage rows, one commit for each day of the first week."""
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "BD_TELCO").otherwise("APP")
    rows = t(s, d, "events").select(F.to_date("ts").alias("event_date"), F.col("ts").cast("timestamp").alias("created_at"), F.col("user_id").cast("string").alias("user_id"), F.lit(None).cast("string").alias("phone_raw"), F.lit(None).cast("string").alias("phone_number"), (F.col("event_id") % 50).alias("song_id"), F.lit("TZ").alias("country_iso"), kind.alias("use_type"), F.lit(1).cast("long").alias("download_or_stream_count"), F.lit(None).cast("string").alias("supporting_details"))
    lake = Q.scratch_lake(s)
    w = lake.writer()
    w.ensure_table(usage.USAGE)
    for x in Q.days_of(s, d):
        w.commit_partition(usage.USAGE_CHECKED, x, rows.where(F.col("event_date") == F.lit(x)), run_id=f"usage:{x}")
    return lake


@query("SELECT count(*) FILTER (WHERE event_type IN ('purchase','signup')) / count(*) AS share FROM events")
def gated_telco_share(s: SparkSession, d: str) -> DataFrame:
    days = Q.days_of(s, d)
    got = usage.telco_share(_usage_lake(s, d).reader(), days[0], days[-1])
    return one(s, "share double", (got.value if not isinstance(got, Refusal) else None,))


@query("SELECT CAST(user_id AS VARCHAR) AS node, count(DISTINCT event_id % 50) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def graph_published(s: SparkSession, d: str) -> DataFrame:
    """Built from the lake, held against it by three canaries, published, opened again by its pointer."""
    lake, root = _usage_lake(s, d), scratch(s)
    usage.build_and_publish(lake, root, Q.days_of(s, d)[0])
    return open_current(s, root, "listening")[0].degree("played")


# -- drops
@query("SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, CAST(user_id AS VARCHAR) AS user_id, event_type AS use_type FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-02'")
def csv_day(s: SparkSession, d: str) -> DataFrame:
    """A day's drop, every column text: the file of one day is the feature."""
    root = scratch(s)
    rows = t(s, d, "events").where(F.to_date("ts") == F.lit(date(2024, 1, 2))).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("use_type"))
    rows.coalesce(1).write.option("header", True).csv(f"{root}/usage_2024-01-02.csv")
    return csv.read_day(s, root, date(2024, 1, 2), ("created_at", "user_id", "use_type"))


@query("SELECT n_name AS \"partition\", n_name || '/a.parquet' AS file, CAST(n_regionkey AS BIGINT) AS \"rows\" FROM nation")
def csv_manifest(s: SparkSession, d: str) -> DataFrame:
    root = scratch(s)
    t(s, d, "nation").select(F.col("n_name").alias("partition"), F.concat("n_name", F.lit("/a.parquet")).alias("file"), F.col("n_regionkey").alias("rows")).coalesce(1).write.option("header", True).csv(root)
    return csv.read_manifest(s, root)


@query("SELECT CAST(n_regionkey AS VARCHAR) AS \"partition\", CAST(count(*) AS INTEGER) AS files, CAST(sum(n_nationkey) AS BIGINT) AS \"rows\" FROM nation GROUP BY 1")
def csv_manifest_groups(s: SparkSession, d: str) -> DataFrame:
    m = t(s, d, "nation").select(F.col("n_regionkey").cast("string").alias("partition"), F.col("n_name").alias("file"), F.col("n_nationkey").cast("long").alias("rows"))
    return one(s, "partition string, files int, rows long", *[(k, len(files), n) for k, (files, n) in csv.manifest_groups(m).items()])


# -- the lake's bookkeeping
def _hive(s: SparkSession, d: str) -> tuple[str, DataFrame]:
    """Events as hive-partitioned files that some other job wrote, and their manifest."""
    root = scratch(s)
    Q._events(s, d).repartition("event_date").write.partitionBy("event_date").parquet(root)
    files = s.read.parquet(root).groupBy(F.col("event_date").cast("string").alias("partition"), F.input_file_name().alias("file")).agg(F.count("*").alias("rows"))
    return root, files


@query("SELECT event_id, CAST(ts AS DATE) AS event_date, user_id, event_type, value FROM events")
def lake_adopt(s: SparkSession, d: str) -> DataFrame:
    """Files adopted where they lie, each partition in its own commit; a second run passes them over."""
    _, manifest = _hive(s, d)
    lake = Q.scratch_lake(s)
    for _ in range(2):
        usage.register_frozen(lake.writer(), EVENTS, manifest, run_tag="frozen")
    return lake.reader().scan(EVENTS)


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS \"partition\", 'register' AS mode, count(*) AS \"rows\" FROM events GROUP BY 1")
def lake_adopt_receipts(s: SparkSession, d: str) -> DataFrame:
    _, manifest = _hive(s, d)
    got = usage.register_frozen(Q.scratch_lake(s).writer(), EVENTS, manifest, run_tag="frozen")
    return one(s, "partition string, mode string, rows long", *[(r.partition, r.mode, r.rows) for r in got.values() if r])


@query("SELECT event_id, CAST(ts AS DATE) AS event_date, user_id, event_type, value FROM events WHERE value > 5 AND event_type = 'view'")
def lake_scan_where(s: SparkSession, d: str) -> DataFrame:
    return Q.ingest(s, d).reader().scan(EVENTS, where="value > :v AND event_type = :e", params={"v": 5, "e": "view"})


@query("SELECT count(DISTINCT CAST(ts AS DATE)) + 1 AS snapshots, count(DISTINCT CAST(ts AS DATE)) AS partitions, true AS there, false AS other FROM events")
def lake_snapshots(s: SparkSession, d: str) -> DataFrame:
    """One entry for the table and one for each day; the newest lists files of every day."""
    lake = Q.ingest(s, d)
    r = lake.reader()
    parts = len({f["partition"] for f in r.entry["tables"][EVENTS.table]["files"]})
    return one(s, "snapshots long, partitions long, there boolean, other boolean", (lake.snapshots().count(), parts, r.has_table(EVENTS), r.has_table(PARTS)))


@query("SELECT 'append' AS mode, (SELECT count(*) FROM part) AS \"rows\", true AS replayed_same, (SELECT count(*) FROM part) AS in_table")
def lake_replay(s: SparkSession, d: str) -> DataFrame:
    """An append under the same run id is answered with the first receipt."""
    lake = Q.scratch_lake(s)
    w, p = lake.writer(), t(s, d, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand", "p_size")
    w.ensure_table(PARTS)
    a, b = (w.append(PARTS, p, run_id="a") for _ in range(2))
    return one(s, "mode string, rows long, replayed_same boolean, in_table long", (a.mode, a.rows, a == b, lake.reader().scan(PARTS).count()))


@query("SELECT 'refused' AS writer, 'refused' AS drifted, 'refused' AS empty, 'refused' AS foreign_rows")
def lake_refusals(s: SparkSession, d: str) -> DataFrame:
    """Read-only lakes, other schemas, empty commits without a note, and rows of another partition."""
    lake = Q.scratch_lake(s)
    w = lake.writer()
    w.ensure_table(EVENTS)

    def outcome(act) -> str:
        try:
            act()
        except (LakeError, ContractError):
            return "refused"
        return "done"

    frame = Q._events(s, d).where(F.col("event_date") == F.lit(Q.DAYS[0]))
    tries = (
        lambda: Lake(s, lake.root, read_only=True).writer(), lambda: w.ensure_table(replace(EVENTS, columns=EVENTS.columns[:-1])),
        lambda: w.commit_partition(EVENTS, Q.DAYS[0], EVENTS.empty(s), run_id="e"), lambda: w.commit_partition(EVENTS, Q.DAYS[1], frame, run_id="f"),
    )
    return one(s, "writer string, drifted string, empty string, foreign_rows string", tuple(map(outcome, tries)))


@query("SELECT CAST(CAST(x AS DATE) AS VARCHAR) AS day FROM generate_series(DATE '2024-01-01', DATE '2024-02-14', INTERVAL 1 DAY) g(x)")
def expected_partitions(s: SparkSession, d: str) -> DataFrame:
    return one(s, "day string", *[(x,) for x in expected_days(EVENTS, date(2024, 2, 15))])


# -- alerts
@query("SELECT * FROM (VALUES ('*/15 * * * *', 15), ('0 6 * * *', 1440), ('30 2 * * 1', 10080), ('0 0 1 * *', 44640), ('0 8,20 * * 1-5', 3600)) v(cron, minutes)")
def alert_cron_gaps(s: SparkSession, d: str) -> DataFrame:
    return one(s, "cron string, minutes int", *[(c, alerts.cron_interval_minutes(c)) for c in ("*/15 * * * *", "0 6 * * *", "30 2 * * 1", "0 0 1 * *", "0 8,20 * * 1-5")])


@query("SELECT * FROM (VALUES ('shop_heartbeat_daily_load', 'heartbeat'), ('shop_new_errors', 'new'), ('shop_workflow_failures', 'failures')) v(name, kind)")
def alert_standard_set(s: SparkSession, d: str) -> DataFrame:
    got = alerts.standard_alerts("Shop", [{"schedule_name": "Daily load", "workflow": "load", "schedule": "0 6 * * *"}])
    return one(s, "name string, kind string", *[(a.name, a.kind) for a in got])


# -- scrubbing over whole texts, with SQL
def _shape(x: str) -> str:
    """DuckDB: the shape class of a text that is neither empty nor null."""
    classes = x
    for pattern, to in ((r"\p{Nd}", "9"), ("[a-z]", "a"), ("[A-Z]", "A"), (r"[^\x00-\x7F\s9]", "U"), (" ", "_")):
        classes = f"regexp_replace({classes}, '{pattern}', '{to}', 'g')"
    return f"array_to_string(list_transform(regexp_extract_all({classes}, '9+|a+|A+|U+|_+|(?s:.)'), lambda r: CASE WHEN length(r) = 1 THEN r ELSE r[1] || '{{' || length(r) || '}}' END), '')"


def _rewrite(x: str, pattern: str, becomes: str) -> str:
    """DuckDB: matches m of a pattern become an expression of m."""
    parts, found = f"regexp_split_to_array({x}, '{pattern}')", f"regexp_extract_all({x}, '{pattern}')"
    return f"array_to_string(list_transform(list_zip({parts}, list_transform({found}, lambda m: {becomes})), lambda z: z[1] || coalesce(z[2], '')), '')"


def _spaced(m: str) -> str:
    """DuckDB: a number in groups, with the character before and after it that RE2 can't look at without taking."""
    core = rf"regexp_extract({m}, '\+?\d{{2,4}}(?: \d{{2,4}}){{2,4}}')"
    return f"CASE WHEN length(regexp_replace({core}, '\\D', '', 'g')) >= {scrub.GROUPED_DIGITS} THEN replace({m}, {core}, {_shape(core)}) ELSE {m} END"


_LITERALS = "|".join(rf"{q}[^''\"`\n]{{0,120}}?\d[^''\"`\n]{{0,120}}?{q}" for q in ("''", '"', "`"))
_STEPS = [
    (r"\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b", "''<uuid>''".replace("''", "'")),
    (scrub.EMAIL, "'<email>'"),
    (_LITERALS, f"CASE WHEN regexp_matches(m, '[{{/\\\\]') THEN m ELSE m[1] || {_shape('m[2:-2]')} || m[-1] END"),
    (r"(?:^|[^\p{L}\p{N}_+])\+?\d{2,4}(?: \d{2,4}){2,4}(?:[^\p{L}\p{N}_]|$)", _spaced("m")),
    (r"\b[0-9A-Fa-f]{24,}\b", "'x{' || length(m) || '}'"),
    (r"\+?\d{7,}(?:\.\d+)?", _shape("m")),
]


def _scrubbed(column: str, table: str) -> str:
    """DuckDB: a chain of CTEs, one for each step; the last has (key, out)."""
    sql = f"WITH s0 AS ({table})"
    for i, (pattern, becomes) in enumerate(_STEPS):
        sql += f", s{i + 1} AS (SELECT * REPLACE ({_rewrite(column, pattern, becomes)} AS {column}) FROM s{i})"
    return sql


@query(_scrubbed("clean", "SELECT doc_id, text AS clean FROM documents") + f" SELECT doc_id, clean[1:{scrub.TEXT_CAP}] AS clean FROM s{len(_STEPS)}")
def scrub_documents(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").select("doc_id", scrub.scrub(F.col("text")).alias("clean"))


@query("SELECT * FROM (VALUES (1, 'Traceback\n  File \"/srv/x7.py\", line 3\n    load(\"id 9{7}\")\nValueError: bad value \"a{2}9\" of <email>')) v(k, clean)")
def scrub_trace(s: SparkSession, d: str) -> DataFrame:
    trace = 'Traceback\n  File "/srv/x7.py", line 3\n    load("id 1234567")\r\nValueError: bad value "ab1" of a.b@example.org\n'
    return one(s, "k int, trace string", (1, trace)).select("k", scrub.scrub_stacktrace(F.col("trace")).alias("clean"))
