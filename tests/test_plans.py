import json
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from trustlake import cli
from trustlake.contracts import Column, ContractError, TableContract
from trustlake.operators import alerts as A
from trustlake.operators import graph as G
from trustlake.operators.census import census
from trustlake.operators.checks import Evidence, Verdict
from trustlake.operators.gate import Precondition, Refusal
from trustlake.plans import codegen, config, dag, lint, usage
from trustlake.plans.actions import Actions, action
from trustlake.sources import publish as P
from trustlake.sources.csv import SourceError, read_day, read_manifest
from trustlake.sources.lake import Lake
from trustlake.streaming import sinks

D1, D2, D3 = date(2026, 9, 1), date(2026, 9, 2), date(2026, 9, 3)


def drop(folder, day, n):
    phones = ["25570000{:04d}", "+25570000{:04d}", "25570000{:04d}.0", "0025570000{:04d}"]
    lines = [",".join(usage.SOURCE_COLUMNS)]
    for i in range(n):
        telco = i % 2 == 0
        lines.append(",".join([f"{day} 10:00:0{i % 10}", f"u{i % 40}", phones[i % 4].format(i) if telco else "", str(1 + i % 39), ["TZ", "ug", ""][i % 3], "BD_TELCO_SUB" if telco else "WEB_STREAM", "1", ""]))
    (folder / f"usage_{day}.csv").write_text("\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("drop")
    drop(folder, D1, 120)
    drop(folder, D2, 80)
    lake = Lake(spark, str(tmp_path_factory.mktemp("lake")), code_version="v1")
    usage.backfill(lake, str(folder), [D1, D2])
    return lake, folder


def test_pipeline_commits_once(done):
    lake, folder = done
    before = lake.current_snapshot()
    again = usage.run_day(lake, str(folder), D1)
    assert lake.current_snapshot() == before and again.rows == 120
    c = census(lake.reader(), (usage.USAGE,), today=D3).first()
    assert (c["partitions"], c["rows"], c["zero_row_partitions"]) == (2, 200, 0)


def test_answers(done):
    lake, _ = done
    r = lake.reader()
    assert [x["events"] for x in usage.daily_events(r, D1, D2).value.collect()] == [120, 80]
    assert usage.telco_share(r, D1, D2).value == 0.5
    assert isinstance(usage.daily_events(r, D1, D3), Refusal)


def test_graph_publishes_on_parity(spark, done, tmp_path):
    lake, _ = done
    assert usage.build_and_publish(lake, str(tmp_path), D3)["status"] == "skipped"
    assert usage.build_and_publish(lake, str(tmp_path), D1)["status"] == "published"
    g, meta = G.open_current(spark, str(tmp_path), "listening")
    assert g.total("played", "plays").first()[0] == 200 and meta["snapshot"] == lake.current_snapshot()
    assert g.hop("played").columns[0] == "a_user_id" and g.hop("played", backward=True).columns[0] == "b_song_id"
    import dataclasses

    lying = dataclasses.replace(usage.LISTENING, canaries=(G.Canary("lie", "SELECT 1", lambda g: g.total("played", "plays")),))
    old = (tmp_path / "listening.current.json").read_text()
    with pytest.raises(G.ParityError):
        G.publish(lying, lake.reader(), str(tmp_path))
    assert (tmp_path / "listening.current.json").read_text() == old and not list(tmp_path.glob(".tmp-*"))


def test_graph_spec_errors():
    with pytest.raises(G.GraphError, match="canary"):
        G.GraphSpec("g", (), (), ())
    with pytest.raises(G.GraphError, match="declared"):
        G.GraphSpec("g", (), (G.RelSpec("r", "a", "b", ""),), (G.Canary("c", "", lambda g: None),))


def test_csv_source(spark, tmp_path):
    (tmp_path / "usage_2026-09-01.csv").write_text("a,b\n1,2\n")
    assert read_day(spark, str(tmp_path), D1, ("a", "b")).collect() == [("1", "2")]
    with pytest.raises(SourceError, match="header"):
        read_day(spark, str(tmp_path), D1, ("b", "a"))
    with pytest.raises(SourceError, match="no file"):
        read_day(spark, str(tmp_path), D2, ("a", "b"))
    (tmp_path / "m.csv").write_text("partition,file,rows\n2026-09-01,a*.parquet,3\n")
    with pytest.raises(SourceError, match="pattern"):
        read_manifest(spark, str(tmp_path / "m.csv"))


def test_register_frozen(spark, tmp_path):
    c = TableContract("Legacy", "legacy.daily", (Column("day", "date", True), Column("n", "int64")), partition_by="day")
    lines = ["partition,file,rows"]
    for d, n in ((D1, 3), (D2, 5)):
        path = f"{tmp_path}/old/day={d}"
        spark.range(n).select(F.col("id").alias("n")).coalesce(1).write.parquet(path)
        lines += [f"{d},{f},{n}" for f in spark.read.parquet(path).inputFiles()]
    (tmp_path / "m.csv").write_text("\n".join(lines) + "\n")
    lake = Lake(spark, str(tmp_path / "lake"))
    m = read_manifest(spark, str(tmp_path / "m.csv"))
    assert sum(r.rows for r in usage.register_frozen(lake.writer(), c, m, run_tag="mig").values()) == 8
    assert set(usage.register_frozen(lake.writer(), c, m, run_tag="mig").values()) == {None}
    assert lake.reader().scan(c).count() == 8


def test_actions(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    state, hits = {"ok": True}, []
    gate = Precondition("p", lambda r: Evidence("p", Verdict.PASS if state["ok"] else Verdict.FAIL))
    a = Actions(lake, action("go", preconditions=[gate])(hits.append))
    now = datetime(2026, 9, 1, tzinfo=timezone.utc)
    assert a.propose("go", "x1", {"k": 1}, now) == "pending_approval" == a.propose("go", "x1", {"k": 1}, now)
    assert a.decide("x1", True, "me", now) == "done" and hits == [{"k": 1}]
    assert a.decide("x1", True, "me", now) == "done" and len(hits) == 1
    a.propose("go", "x2", {}, now)
    assert a.decide("x2", False, "me", now) == "rejected"
    a.propose("go", "x3", {}, now)
    assert a.decide("x3", True, "me", now + timedelta(days=8)) == "expired"
    a.propose("go", "x4", {}, now)
    state["ok"] = False
    assert a.decide("x4", True, "me", now) == "refused_after_approval"
    assert a.propose("go", "x5", {}, now) == "refused" and len(hits) == 1
    assert [r["state"] for r in a.audit("x1").collect()] == ["pending_approval", "running", "done"]


def test_publish(tmp_path):
    t = P.PublishTarget(str(tmp_path))
    got = P.publish_documents(t, {"b.json": b"2", "a.json": b"1"}, extra={"period": "p"})
    assert [r.key for r in got] == ["a.json", "b.json", "manifest.json"]
    m = json.loads((tmp_path / "manifest.json").read_text())
    assert m["count"] == 2 and m["period"] == "p"
    with pytest.raises(P.PublishError):
        P.publish_bytes(t, "/a.json/", b"1")
    assert not P.publish_bytes(t, "a.json", b"1", idempotent=True).written
    with pytest.raises(P.PublishError):
        P.publish_bytes(t, "a.json", b"x", idempotent=True)
    assert P.publish_bytes(t, "a.json", b"x", overwrite=True).written
    with pytest.raises(P.PublishError):
        P.publish_documents(t, {}, extra={"count": 1})


def test_alerts(spark):
    now = 1_800_000_000_000_000
    minute = 60_000_000
    rows = [("ex", "w", "ERROR", "workflow", "old", now - 2 * minute), ("ex", "w", "ERROR", "workflow", "old", now - 2000 * minute), ("ex", "w", "ERROR", "workflow", "new", now - minute), ("ex", "w", "OK", "workflow", None, now - 30 * minute), ("ex", "s", "ERROR", "step", "x", now - minute), ("zz", "w", "ERROR", "workflow", "new", now - minute), ("ex", "w", "ERROR", "workflow", "late", now - 40 * minute)]
    spans = spark.createDataFrame(rows, "service_name string, operation_name string, span_status string, dbos_operation_type string, error_signature string, _timestamp long")
    assert A.workflow_failures(spans, "ex", now).count() == 2
    assert [r["error_signature"] for r in A.new_errors(spans, "ex", now).collect()] == ["new"]
    assert A.heartbeat(spans, "ex", "w", "0 * * * *", now).count() == 0
    assert A.heartbeat(spans, "ex", "w2", "0 * * * *", now).count() == 1
    assert A.cron_interval_minutes("0 6 * * *") == 1440 and A.cron_interval_minutes("*/15 * * * *") == 15 and A.cron_interval_minutes("0 6 * * 1") == 10080
    made = A.standard_alerts("My App", [{"schedule_name": "daily", "workflow": "w", "schedule": "0 6 * * *"}])
    assert [a.name for a in made] == ["my_app_workflow_failures", "my_app_new_errors", "my_app_heartbeat_daily"]
    held = {made[0].name: made[0].payload(), "other": {}}
    plan = A.plan_upsert(made, held)
    assert plan["same"] == [made[0].name] and plan["unmanaged"] == ["other"] and len(plan["create"]) == 2
    with pytest.raises(ValueError):
        A.Alert("bad", "", "failures", {"service": "x'; drop"})


def test_config(tmp_path, monkeypatch):
    assert config.workflow_id("p", D1, attempt=2) == "p:2026-09-01:2"
    with pytest.raises(ValueError):
        config.workflow_id("p", "a b")
    assert config.redact("pg://u:secret@h/db") == "pg://u:***@h/db" and config.has_password("x?password=1")
    (tmp_path / ".git").write_text("gitdir: elsewhere")
    with pytest.raises(ValueError):
        config.namespace({"TRUSTLAKE_NAMESPACE": "main"}, str(tmp_path))
    assert config.namespace({}, str(tmp_path)) == config.sanitize_namespace(tmp_path.name)
    assert config.LakeConfig.from_env({"TRUSTLAKE_ROOT": "/x", "TRUSTLAKE_CODE_VERSION": "v"}, "/").code_version == "v"


def test_dag():
    assert set(dag.run_dag(usage, final=[usage.events_typed], inputs={"events_raw": None, "events_typed": 1})) == {"events_typed"}
    with pytest.raises(TypeError, match="function object"):
        dag.run_dag(usage, final=["events_typed"], inputs={})
    with pytest.raises(dag.DagError, match="neither a node nor an input"):
        dag.run_dag(usage, final=[usage.events_clean], inputs={})


YAML = """
default_range: string
enums: {Channel: {permissible_values: {sms: {}, web: {}}}}
slots:
  event_date: {range: date, required: true}
  channel: {range: Channel}
  amount: {range: decimal, annotations: {lake.dtype: "decimal(18,4)"}}
  plays: {range: integer, minimum_value: 0}
classes:
  EventsClean: {slots: [event_date, channel, amount, plays], annotations: {lake.table: usage.events_clean, lake.partition_by: event_date, lake.cadence: daily}}
  Other: {slots: [plays]}
"""


def test_codegen(tmp_path):
    pytest.importorskip("yaml")
    f = tmp_path / "s.yaml"
    f.write_text(YAML)
    (c,) = codegen.load_tables(str(f))
    assert [x.dtype for x in c.columns] == ["date", "string", "decimal(18,4)", "int64"] and c.columns[1].allowed == ("sms", "web")
    text = codegen.render_tables([c], "s.yaml")
    space = {}
    exec(text, space)
    assert space["EVENTS_CLEAN"] == c and codegen.render_tables([c], "s.yaml") == text
    with pytest.raises(ContractError, match="forbidden"):
        codegen.load_tables(str(f), forbidden_columns=("PLAYS",))
    f.write_text(YAML.replace(', annotations: {lake.dtype: "decimal(18,4)"}', ""))
    with pytest.raises(ContractError, match="decimal"):
        codegen.load_tables(str(f))
    f.write_text(YAML)
    out = str(tmp_path / "o.py")
    assert cli.main(["contracts", "check", str(f), out]) == 1 and cli.main(["contracts", "generate", str(f), out]) == 0 and cli.main(["contracts", "check", str(f), out]) == 0
    assert json.loads(codegen.render_jsonschema([c]))["$defs"]["EventsClean"]["required"] == ["event_date"]


def test_lint(tmp_path):
    bad = 'df.write.parquet("x")\ndatetime.now()\nfor r in df.collect():\n    pass\nspark.sql("DROP TABLE x")\ndf.rdd.map(f)\n'
    assert [f.code for f in lint.scan_source(bad, "app.py")] == ["TL001", "TL003", "TL004", "TL002", "TL008"]
    assert lint.scan_source("def (", "x.py")[0].code == "TL000" and not lint.scan_source("x = 1", "x.py")
    (tmp_path / "ok.py").write_text("x = 1\n")
    assert cli.main(["lint", str(tmp_path)]) == 0


def test_streams(spark, tmp_path):
    c = TableContract("Obs", "pulse.obs", (Column("artist", "string", True), Column("n", "int64")))
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("b", 2)], c.struct()).coalesce(1).write.parquet(src)
    lake = Lake(spark, str(tmp_path / "lake"))
    run = lambda ck: sinks.append_stream(spark.readStream.schema(c.struct()).parquet(src), lake.writer(), c, "obs", str(tmp_path / ck)).awaitTermination()
    run("ck")
    run("ck2")  # a lost checkpoint replays batch 0 under the same run id
    assert lake.reader().scan(c).count() == 2
    spark.createDataFrame([("c", 3)], c.struct()).coalesce(1).write.mode("append").parquet(src)
    run("ck")
    assert lake.reader().scan(c).count() == 3
    p = TableContract("Days", "pulse.days", (Column("day", "date", True), Column("n", "int64")), partition_by="day")
    src2 = str(tmp_path / "in2")
    spark.createDataFrame([(D1, 1), (D2, 2)], p.struct()).coalesce(1).write.parquet(src2)
    go = lambda: sinks.partition_stream(spark.readStream.schema(p.struct()).parquet(src2), lake.writer(), p, "days", str(tmp_path / "ck3")).awaitTermination()
    go()
    spark.createDataFrame([(D1, 5)], p.struct()).coalesce(1).write.mode("append").parquet(src2)
    go()
    assert sorted(r["n"] for r in lake.reader().scan(p, partition=D1).collect()) == [1, 5]


def test_windowed_failures_stream(spark, tmp_path):
    src = str(tmp_path / "s")
    rows = [(datetime(2026, 9, 1, 10, m), "w") for m in (1, 5, 20)]
    spark.createDataFrame(rows, "ts timestamp, op string").coalesce(1).write.parquet(src)
    stream = sinks.windowed_failures(spark.readStream.schema("ts timestamp, op string").parquet(src), ["op"])
    q = stream.writeStream.format("memory").queryName("wf").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = sinks.windowed_failures(spark.read.parquet(src), ["op"])
    assert sorted(spark.table("wf").collect()) == sorted(batch.collect()) and sorted(r["failures"] for r in batch.collect()) == [1, 2]
