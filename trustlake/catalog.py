"""The library's queries, by name, with their DuckDB counterparts.

Each query runs over its whole table; a filter stands only where it is the query's
feature. Lake queries commit every day of events to a lake in a scratch folder.
More of them are in ``catalog_rules``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .contracts import Column as C
from .contracts import TableContract
from .functions import scrub, shapes, text
from .operators import alerts
from .operators import checks as K
from .operators.census import census_frame, missing_days, reconcile
from .operators.gate import Refusal, answer, fresh_within, min_rows, partitions_complete
from .operators.graph import Graph
from .operators.metrics import SemanticTable, count_true, ratio_of_sums
from .shared import shared_dir
from .sources.lake import Lake, Reader, runlog_rollup
from .streaming.sinks import windowed_failures

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    from . import catalog_rules  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalog_rules  # noqa: F401

    return dict(_ORACLES)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(c: str = "ts") -> Column:
    return F.to_date(c)


# -- scans and expressions
@query("SELECT event_id, CAST(ts AS DATE) AS event_date, user_id, event_type FROM events")
def scan_projected(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "events").select("event_id", day().alias("event_date"), "user_id", "event_type")


@query("SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05'")
def scan_partition_filter(s: SparkSession, d: str) -> DataFrame:
    # A half-open range on ts itself reaches the Parquet filters; a cast of ts would not.
    start = F.lit("2024-01-05").cast("timestamp_ntz")
    return t(s, d, "events").where((F.col("ts") >= start) & (F.col("ts") < F.lit("2024-01-06").cast("timestamp_ntz"))).select("event_id", "user_id")


@query(r"SELECT conv_id, turn, CASE WHEN regexp_replace(role,'^\s+|\s+$','','g')='' THEN NULL ELSE role END AS role FROM conversations")
def blank_to_null(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "conversations").select("conv_id", "turn", text.blank_to_null(F.col("role")).alias("role"))


@query("SELECT event_id, CAST(strftime(ts,'%Y-%m-%d') AS DATE) AS event_date, CAST(CAST(user_id AS VARCHAR) AS BIGINT) AS user_id, upper(event_type) AS event_type FROM events")
def typed_strict(s: SparkSession, d: str) -> DataFrame:
    raw = t(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("user_id").cast("string").alias("user_id"), "event_type")
    return raw.select("event_id", F.to_date(text.strict_timestamp(F.col("at"))).alias("event_date"), text.strict_long(F.col("user_id")).alias("user_id"), F.upper("event_type").alias("event_type"))


@query(r"WITH p AS (SELECT o_orderkey AS k, CASE o_orderkey%6 WHEN 0 THEN '+2557'||o_orderkey WHEN 1 THEN '2557'||o_orderkey||'.0' WHEN 2 THEN '002557'||o_orderkey WHEN 3 THEN ' 2557'||o_orderkey||' ' WHEN 4 THEN 'nan' ELSE '' END AS raw FROM orders) SELECT k, CASE WHEN trim(raw)='' OR lower(trim(raw))='nan' THEN NULL ELSE regexp_replace(regexp_replace(regexp_replace(trim(raw),'^\+',''),'^(\d+)\.0+$','\1'),'^00+(\d*)$','\1') END AS phone FROM p")
def normalize_phone(s: SparkSession, d: str) -> DataFrame:
    k, n = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    raw = F.when(k % 6 == 0, F.concat(F.lit("+2557"), n)).when(k % 6 == 1, F.concat(F.lit("2557"), n, F.lit(".0"))).when(k % 6 == 2, F.concat(F.lit("002557"), n)).when(k % 6 == 3, F.concat(F.lit(" 2557"), n, F.lit(" "))).when(k % 6 == 4, "nan").otherwise("")
    return t(s, d, "orders").select(k.alias("k"), text.normalize_phone(raw).alias("phone"))


_SHAPE = "array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(p_brand,'[0-9]','9','g'),'[a-z]','a','g'),'[A-Z]','A','g'),'9+|A+|a+|.'), lambda x: CASE WHEN length(x)=1 THEN x ELSE x[1]||'{'||length(x)||'}' END),'')"


@query(f"SELECT DISTINCT p_brand, {_SHAPE} AS shape FROM part")
def shape_class(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "part").select("p_brand").distinct().select("p_brand", shapes.shape_class(F.col("p_brand")).alias("shape"))


@query(f"WITH s AS (SELECT {_SHAPE} AS shape FROM part) SELECT shape, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, shape LIMIT 5")
def shape_counts(s: SparkSession, d: str) -> DataFrame:
    return shapes.shape_counts(t(s, d, "part"), "p_brand")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN coalesce(l_discount,0)<>0 THEN l_tax/l_discount END AS rate FROM lineitem")
def rate_expr(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", text.safe_ratio(F.col("l_tax"), F.col("l_discount")).alias("rate"))


@query("SELECT event_id, json_extract_string(props,'$.k') AS k, coalesce(CAST(event_type AS VARCHAR),'<null>') AS type_text, epoch_us(ts) AS micros, sha256(event_type) AS digest FROM events")
def scalar_misc(s: SparkSession, d: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return t(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), text.as_text(F.col("event_type")).alias("type_text"), micros.alias("micros"), F.sha2("event_type", 256).alias("digest"))


# -- trust queries
@query("WITH log AS (SELECT event_type AS dataset, CAST(CAST(ts AS DATE) AS VARCHAR) AS \"partition\", CASE WHEN event_type='view' THEN 'append' ELSE 'overwrite_partition' END AS mode, event_id AS \"rows\", event_id AS seq FROM events) SELECT dataset, \"partition\", CASE WHEN bool_and(mode='append') THEN CAST(sum(\"rows\") AS BIGINT) ELSE arg_max(\"rows\",seq) END AS \"rows\", arg_max(mode,seq) AS mode FROM log GROUP BY ALL")
def runlog(s: SparkSession, d: str) -> DataFrame:
    log = t(s, d, "events").select(F.col("event_type").alias("dataset"), day().cast("string").alias("partition"), F.when(F.col("event_type") == "view", "append").otherwise("overwrite_partition").alias("mode"), F.col("event_id").alias("rows"), F.col("event_id").alias("seq"))
    return runlog_rollup(log, ("seq",)).drop("seq")


@query("WITH d AS (SELECT event_type AS dataset, CAST(CAST(ts AS DATE) AS VARCHAR) AS p, count(*) AS n FROM events GROUP BY ALL) SELECT dataset, count(*) AS partitions, CAST(sum(n) AS BIGINT) AS \"rows\", min(p) AS first_partition, max(p) AS last_partition FROM d GROUP BY 1")
def census(s: SparkSession, d: str) -> DataFrame:
    log = t(s, d, "events").groupBy(F.col("event_type").alias("dataset"), day().cast("string").alias("partition")).agg(F.count("*").alias("rows"), F.max("ts").alias("committed_at"), F.lit("v").alias("code_version"))
    return census_frame(log).select("dataset", "partitions", "rows", "first_partition", "last_partition")


@query("SELECT CAST(CAST(x AS DATE) AS VARCHAR) AS \"partition\" FROM generate_series(DATE '2023-12-20', DATE '2024-02-10', INTERVAL 1 DAY) g(x) WHERE CAST(x AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events)")
def missing_partitions(s: SparkSession, d: str) -> DataFrame:
    """Days of a window that is wider than the table."""
    present = t(s, d, "events").select(day().alias("d"))
    return missing_days(present, "d", F.lit("2023-12-20").cast("date"), F.lit("2024-02-10").cast("date")).select(F.col("d").cast("string").alias("partition"))


@query("WITH log AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS \"partition\", count(*) AS r FROM events GROUP BY 1), act AS (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS \"partition\", count(*) AS t FROM orders GROUP BY 1) SELECT \"partition\", coalesce(r,0) AS runlog_rows, coalesce(t,0) AS table_rows FROM log FULL JOIN act USING (\"partition\") WHERE coalesce(r,0)<>coalesce(t,0)")
def deep_census(s: SparkSession, d: str) -> DataFrame:
    """Two tables that agree on no day: rows of either side, and of both."""
    log = t(s, d, "events").groupBy(day().cast("string").alias("partition")).agg(F.count("*").alias("runlog_rows"))
    actual = t(s, d, "orders").groupBy(day("o_orderdate").cast("string").alias("partition")).agg(F.count("*").alias("table_rows"))
    return reconcile(log, actual)


# -- metrics
def _usage(s: SparkSession, d: str) -> SemanticTable:
    telco = F.col("event_type").isin("purchase", "signup")
    return SemanticTable(t(s, d, "events")).with_dimensions(event_date=day(), event_type=F.col("event_type")).with_measures(events=F.count("*"), share=ratio_of_sums(count_true(telco), F.count("*")), listeners=F.count_distinct("user_id"))


@query("SELECT CAST(ts AS DATE) AS event_date, count(*) AS events FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-09' GROUP BY 1")
def daily_events(s: SparkSession, d: str) -> DataFrame:
    """Events per day of a window: the inclusive range is the feature."""
    return _usage(s, d).where(day().between("2024-01-03", "2024-01-09")).query(["event_date"], ["events"]).orderBy("event_date")


@query("SELECT CASE WHEN count(*)=0 THEN NULL ELSE CAST(count(*) FILTER (WHERE event_type IN ('purchase','signup')) AS DOUBLE)/count(*) END AS share FROM events")
def telco_share(s: SparkSession, d: str) -> DataFrame:
    return _usage(s, d).query([], ["share"])


@query("SELECT event_type, count(DISTINCT user_id) AS listeners FROM events GROUP BY 1")
def listeners(s: SparkSession, d: str) -> DataFrame:
    return _usage(s, d).query(["event_type"], ["listeners"])


# -- checks
@query("SELECT count(*) AS \"rows\", count(*) FILTER (WHERE NOT coalesce(value >= 5, false)) AS failing FROM events")
def check_evaluate(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "events").agg(F.count("*").alias("rows"), F.count_if(text.fails(F.col("value") >= 5)).alias("failing"))


@query("SELECT CAST(count(*) FILTER (WHERE nullif(quality,0) IS NULL) AS DOUBLE)/count(*) AS null_rate FROM labels")
def null_rate(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "labels").agg(ratio_of_sums(F.count_if(F.nullif(F.col("quality"), F.lit(0)).isNull()), F.count("*")).alias("null_rate"))


@query("SELECT CAST(count(*) FILTER (WHERE coalesce(value > 10, false)) AS DOUBLE)/count(*) AS share FROM events")
def share_at_least(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "events").agg(ratio_of_sums(count_true(F.col("value") > 10), F.count("*")).alias("share"))


@query("SELECT count(*) AS \"rows\", count(*) FILTER (WHERE upper(event_type) IS DISTINCT FROM event_type) AS dirty FROM events")
def measure_dirt(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "events").agg(F.count("*").alias("rows"), F.count_if(K.dirty_expr("event_type", F.upper)).alias("dirty"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1,2 HAVING count(*)>1")
def grain_dups(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT p_partkey, p_brand AS raw, regexp_replace(p_brand,'^Brand','') AS clean, p_brand IS DISTINCT FROM regexp_replace(p_brand,'^Brand','') AS changed FROM part")
def repair_derive(s: SparkSession, d: str) -> DataFrame:
    clean = F.regexp_replace("p_brand", "^Brand", "")
    return t(s, d, "part").select("p_partkey", F.col("p_brand").alias("raw"), clean.alias("clean"), text.differs(F.col("p_brand"), clean).alias("changed"))


@query("SELECT o_custkey, CAST(max(o_totalprice) AS DOUBLE) AS top FROM orders WHERE o_totalprice > 0 GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus NOT IN ('F','O','P')) = 0")
def rules_by_group(s: SparkSession, d: str) -> DataFrame:
    g = t(s, d, "orders").where("o_totalprice > 0").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"), F.count_if(~F.col("o_orderstatus").isin("F", "O", "P")).alias("bad"))
    return g.where("bad = 0").drop("bad")


# -- graph
def _graph(s: SparkSession, d: str) -> Graph:
    e = t(s, d, "lineitem").select(F.col("l_suppkey").alias("from"), F.col("l_partkey").alias("to"))
    return Graph({}, {"supplies": e})


@query("SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL")
def graph_nodes(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "events").select("user_id").where("user_id is not null").distinct()


@query("SELECT user_id AS \"from\", event_type AS \"to\", count(*) AS plays FROM events GROUP BY 1,2")
def graph_edges(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "events").groupBy(F.col("user_id").alias("from"), F.col("event_type").alias("to")).agg(F.count("*").alias("plays"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def graph_forward(s: SparkSession, d: str) -> DataFrame:
    return _graph(s, d).degree("supplies", name="parts").withColumnRenamed("node", "l_suppkey")


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY 1")
def graph_backward(s: SparkSession, d: str) -> DataFrame:
    return _graph(s, d).degree("supplies", backward=True, name="supps").withColumnRenamed("node", "l_partkey")


@query("WITH e AS (SELECT DISTINCT s_nationkey AS n, s_suppkey AS k FROM supplier) SELECT a.k AS s1, b.k AS s2 FROM e a JOIN e b ON a.n=b.n AND a.k<b.k")
def graph_two_hop(s: SparkSession, d: str) -> DataFrame:
    e = t(s, d, "supplier").select(F.col("s_suppkey").alias("from"), F.col("s_nationkey").alias("to"))
    return Graph({}, {"in": e}).meet("in", lambda a, b: a < b).select(F.col("a").alias("s1"), F.col("b").alias("s2"))


@query("SELECT CAST(sum(plays) AS BIGINT) AS plays FROM (SELECT count(*) AS plays FROM events GROUP BY user_id, event_type)")
def graph_total(s: SparkSession, d: str) -> DataFrame:
    return Graph({}, {"did": graph_edges(s, d)}).total("did", "plays")


@query("WITH RECURSIVE e AS (SELECT DISTINCT n_regionkey AS a, n_nationkey + 100 AS b FROM nation UNION SELECT DISTINCT s_nationkey + 100, s_suppkey + 1000 FROM supplier), r AS (SELECT CAST(r_regionkey AS BIGINT) AS node, 0 AS hops FROM region UNION SELECT e.b, r.hops + 1 FROM r JOIN e ON r.node = e.a WHERE r.hops < 3) SELECT node, min(hops) AS hops FROM r GROUP BY 1")
def graph_reach(s: SparkSession, d: str) -> DataFrame:
    n = t(s, d, "nation").select(F.col("n_regionkey").cast("long").alias("from"), (F.col("n_nationkey") + 100).cast("long").alias("to"))
    e = n.unionByName(t(s, d, "supplier").select((F.col("s_nationkey") + 100).cast("long").alias("from"), (F.col("s_suppkey") + 1000).alias("to")))
    return Graph({}, {"in": e}).reach("in", t(s, d, "region").select(F.col("r_regionkey").cast("long").alias("node")), 3)


@query("SELECT user_id, event_type FROM (SELECT user_id, event_type FROM events WHERE value>5 EXCEPT ALL SELECT user_id, event_type FROM events WHERE value>50)")
def parity_multiset(s: SparkSession, d: str) -> DataFrame:
    e = t(s, d, "events")
    a, b = (e.where(F.col("value") > x).select("user_id", "event_type") for x in (5, 50))
    return a.exceptAll(b)


# -- alerts
@query("SELECT event_type AS operation_name, json_extract_string(props,'$.k') AS sig, count(*) AS failures, max(epoch_us(ts)) AS last_seen FROM events WHERE event_type='error' AND ts >= TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1,2")
def alert_failures(s: SparkSession, d: str) -> DataFrame:
    return alerts.failures(_errors(s, d, "2024-01-30"), ["operation_name", "sig"], "micros")


def _errors(s: SparkSession, d: str, since: str) -> DataFrame:
    e = t(s, d, "events").where((F.col("event_type") == "error") & (F.col("ts") >= F.lit(since).cast("timestamp_ntz")))
    return e.select(F.col("event_type").alias("operation_name"), F.get_json_object("props", "$.k").alias("sig"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))


@query("SELECT json_extract_string(props,'$.k') AS sig, count(*) AS failures, min(epoch_us(ts)) AS first_seen FROM events WHERE event_type='error' AND ts >= TIMESTAMP '2024-01-23 00:00:00' GROUP BY 1 HAVING min(ts) >= TIMESTAMP '2024-01-29 00:00:00'")
def alert_new_errors(s: SparkSession, d: str) -> DataFrame:
    return alerts.first_seen_since(_errors(s, d, "2024-01-23"), ["sig"], "micros", 1706486400000000)


@query("SELECT count(*) AS succeeded FROM events WHERE event_type='nope' HAVING count(*)=0")
def alert_heartbeat(s: SparkSession, d: str) -> DataFrame:
    return alerts.absence(t(s, d, "events").where(F.col("event_type") == "nope"))


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, event_type, count(*) AS failures, max(ts) AS last_seen FROM events WHERE event_type='error' GROUP BY 1,2")
def alert_windows(s: SparkSession, d: str) -> DataFrame:
    out = windowed_failures(t(s, d, "events").where("event_type = 'error'").withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "failures", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"))


@query("SELECT user_id, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1")
def latest_receipt(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "events").groupBy("user_id").agg(F.max_by("event_id", "ts").alias("event_id"))


@query()
def error_signatures(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").groupBy(scrub.error_signature(F.col("text")).alias("signature")).agg(F.count("*").alias("n"))


# -- the lake
EVENTS = TableContract("Events", "usage.events", (C("event_id", "int64", True), C("event_date", "date", True), C("user_id", "int64"), C("event_type", "string", True, allowed=("view", "signup", "purchase", "click", "error")), C("value", "float64")), partition_by="event_date", cadence="daily", expected_start="2024-01-01")
PARTS = TableContract("Parts", "catalog.parts", (C("p_partkey", "int64", True), C("p_brand", "string"), C("p_size", "int32", minimum=0)), grain=("p_partkey",))
DAYS = [date(2024, 1, k) for k in range(1, 8)]  # days that queries commit again, empty or restore
_SCAN = "SELECT event_id, CAST(ts AS DATE) AS event_date, user_id, event_type, value FROM events"


def scratch_lake(s: SparkSession) -> Lake:
    return Lake(s, f"{shared_dir(s)}/lake-{uuid.uuid4().hex}", code_version="test")


def _events(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "events").select("event_id", day().alias("event_date"), "user_id", "event_type", "value")


def days_of(s: SparkSession, d: str) -> list[date]:
    """Every day that events has."""
    return [r["event_date"] for r in _events(s, d).select("event_date").where("event_date is not null").distinct().orderBy("event_date").collect()]


def ingest(s: SparkSession, d: str) -> Lake:
    """All of events, committed day by day."""
    lake, source = scratch_lake(s), _events(s, d)
    w = lake.writer()
    w.ensure_table(EVENTS)
    for x in days_of(s, d):
        w.commit_partition(EVENTS, x, source.where(F.col("event_date") == F.lit(x)), run_id=f"ingest:{x}")
    return lake


@query(_SCAN)
def lake_commit_scan(s: SparkSession, d: str) -> DataFrame:
    """All days committed one by one, one day twice (the second replaces the first)."""
    lake = ingest(s, d)
    lake.writer().commit_partition(EVENTS, DAYS[2], _events(s, d).where(F.col("event_date") == F.lit(DAYS[2])), run_id="again")
    return lake.reader().scan(EVENTS)


@query("SELECT CAST(ts AS DATE) AS event_date, count(*) AS n FROM events WHERE value > 5 GROUP BY 1")
def lake_sql(s: SparkSession, d: str) -> DataFrame:
    return ingest(s, d).reader().sql("SELECT event_date, count(*) AS n FROM usage.events WHERE value > ? GROUP BY event_date", [5])


@query(_SCAN + " WHERE CAST(ts AS DATE) = DATE '2024-01-03'")
def lake_time_travel(s: SparkSession, d: str) -> DataFrame:
    """A day is emptied; the older snapshot still has it."""
    lake = ingest(s, d)
    old = lake.current_snapshot()
    lake.writer().commit_partition(EVENTS, DAYS[2], EVENTS.empty(s), run_id="empty", allow_empty=True, note="withdrawn")
    return lake.reader(old).scan(EVENTS, partition=DAYS[2])


@query(_SCAN)
def lake_restore(s: SparkSession, d: str) -> DataFrame:
    lake = ingest(s, d)
    old, w = lake.current_snapshot(), lake.writer()
    w.commit_partition(EVENTS, DAYS[4], EVENTS.empty(s), run_id="empty", allow_empty=True, note="withdrawn")
    w.restore_partition(EVENTS, DAYS[4], snapshot=old, run_id="back", reason="withdrawn by mistake")
    return lake.reader().scan(EVENTS)


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_brand, CAST(p_size AS INTEGER) AS p_size FROM part")
def lake_append_replace(s: SparkSession, d: str) -> DataFrame:
    """Replace by one half, append the other; the append is replayed and counts once."""
    lake = scratch_lake(s)
    w, p = lake.writer(), t(s, d, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand", F.col("p_size").cast("int").alias("p_size"))
    w.ensure_table(PARTS)
    w.replace(PARTS, p.where("p_partkey % 2 = 0"), run_id="r1")
    for _ in range(2):
        w.append(PARTS, p.where("p_partkey % 2 = 1"), run_id="a1")
    return lake.reader().scan(PARTS)


FIXABLE = TableContract("Brands", "catalog.brands", (C("p_size", "int32", True), C("p_partkey", "int64", True), C("raw", "string"), C("clean", "string")), partition_by="p_size")


@query("SELECT CAST(p_size AS INTEGER) AS p_size, CAST(p_partkey AS BIGINT) AS p_partkey, p_brand AS raw, CASE WHEN p_size = 7 THEN regexp_replace(p_brand,'^Brand','') ELSE p_brand END AS clean FROM part")
def lake_repair(s: SparkSession, d: str) -> DataFrame:
    """All sizes committed, one repaired."""
    lake = scratch_lake(s)
    w, p = lake.writer(), t(s, d, "part").select(F.col("p_size").cast("int").alias("p_size"), F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_brand").alias("raw"), F.col("p_brand").alias("clean"))
    w.ensure_table(FIXABLE)
    for k in [r["p_size"] for r in p.select("p_size").where("p_size is not null").distinct().orderBy("p_size").collect()]:
        w.commit_partition(FIXABLE, k, p.where(F.col("p_size") == k), run_id=f"load:{k}")
    w.repair_partition(FIXABLE, 7, column="clean", witness="raw", derive=lambda c: F.regexp_replace(c, "^Brand", ""), reason="prefix", run_id="fix:7")
    return lake.reader().scan(FIXABLE)


@query("SELECT 'usage.events' AS dataset, CAST(CAST(ts AS DATE) AS VARCHAR) AS \"partition\", count(*) AS \"rows\", 'overwrite_partition' AS mode FROM events GROUP BY ALL")
def lake_runlog(s: SparkSession, d: str) -> DataFrame:
    return ingest(s, d).reader().runlog(EVENTS.table).select("dataset", "partition", "rows", "mode")


@query("SELECT CAST(0 AS BIGINT) AS mismatches")
def lake_deep_census(s: SparkSession, d: str) -> DataFrame:
    from .operators.census import deep_census as deep

    return deep(ingest(s, d).reader(), EVENTS).agg(F.count("*").alias("mismatches"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Events per day, of every day of the table."""
    lake = ingest(s, d)
    days = days_of(s, d)

    def compute(r: Reader) -> DataFrame:
        table = SemanticTable(r.scan(EVENTS)).with_dimensions(event_date=F.col("event_date")).with_measures(events=F.count("*"))
        return table.query(["event_date"], ["events"]).orderBy("event_date")

    gates = [partitions_complete(EVENTS, days[0], days[-1]), min_rows(EVENTS, days[0], days[-1], 10), fresh_within(EVENTS, 3, today=days[-1] + timedelta(days=2))]
    got = answer("events per day", reader=lake.reader(), compute=compute, preconditions=gates, datasets=[EVENTS])
    if isinstance(got, Refusal):
        raise RuntimeError("; ".join(got.reasons))
    return got.value


@query("SELECT CAST(ts AS DATE) AS event_date, count(*) AS events FROM events GROUP BY 1")
def gated_daily_events(s: SparkSession, d: str) -> DataFrame:
    return flagship(s, d)
