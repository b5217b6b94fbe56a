"""Schedules, replay, the review action, applying alerts, telemetry settings."""

import http.server
import json
import threading
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from trustlake.contracts import Column, TableContract
from trustlake.operators import alerts
from trustlake.plans import schedules as S
from trustlake.plans.actions import Actions
from trustlake.plans.review import flag_song_for_review
from trustlake.plans.usage import USAGE
from trustlake.sources.lake import Lake
from trustlake.sources.publish import PublishTarget

TICKS = TableContract("Ticks", "ops.ticks", (Column("at", "datetime_utc", True),))
UTC = timezone.utc


def tick(lake, at, run_id):
    w = lake.writer()
    w.ensure_table(TICKS)
    w.append(TICKS, lake.spark.createDataFrame([(at,)], TICKS.struct()), run_id=run_id)


def test_replay_runs_each_fire_once(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    s = S.Schedule("six-hourly", TICKS.table, "0 */6 * * *", tick)
    start, end = datetime(2026, 3, 1, tzinfo=UTC), datetime(2026, 3, 2, tzinfo=UTC)
    assert [t.hour for t in s.fires(start, end)] == [6, 12, 18, 0]
    worker = S.Launch(lake, s, role="worker")
    tick(lake, datetime(2026, 3, 1, 12, tzinfo=UTC), s.run_id(datetime(2026, 3, 1, 12, tzinfo=UTC)))
    assert [r["done"] for r in worker.status(start, end).collect()] == [False, True, False, False]
    assert worker.backfill(start, end) == [f"six-hourly:2026-03-{d}" for d in ("01T0600", "01T1800", "02T0000")]
    assert worker.backfill(start, end) == [] and worker.tick(end) == []
    assert sorted(r["at"].hour for r in lake.reader().scan(TICKS).collect()) == [0, 6, 12, 18]
    with pytest.raises(S.RoleError):
        S.Launch(lake, s).backfill(start, end)
    with pytest.raises(S.RoleError):
        S.Launch(lake, s, role="boss")
    with pytest.raises(ValueError):
        S.Launch(lake, s, s)


def test_a_song_goes_to_review_once(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    w = lake.writer()
    w.ensure_table(USAGE)
    row = spark.range(1).select(*[(F.lit(v) if v is not None else F.lit(None)).cast(f.dataType).alias(f.name) for f, v in zip(USAGE.struct(), ("2026-03-01", "2026-03-01 10:00:00", "u", None, None, 7, "TZ", "APP", 1, None))])
    w.commit_partition(USAGE, date(2026, 3, 1), row, run_id="d")
    outbox = PublishTarget(str(tmp_path / "out"))
    played, silent = Actions(lake, flag_song_for_review(7, outbox)), Actions(lake, flag_song_for_review(8, outbox))
    assert silent.propose("flag_song_for_review", "s8", {"reason": "x"}) == "refused"
    assert played.propose("flag_song_for_review", "s7", {"reason": "x"}) == "pending_approval"
    assert not (tmp_path / "out").exists()
    assert played.decide("s7", True, "me") == "done" == played.decide("s7", True, "me")
    assert json.loads((tmp_path / "out/reviews/song-7.json").read_text()) == {"song_id": 7, "reason": "x"}


def test_alerts_are_applied_by_name():
    kept = {"shop_new_errors": {"name": "shop_new_errors", "old": True}, "by_hand": {"name": "by_hand"}}

    class Handler(http.server.BaseHTTPRequestHandler):
        def _answer(self, body=None):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode() if body is not None else b"")

        def do_GET(self):
            self._answer(list(kept.values()))

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            kept[body["name"]] = body
            self._answer()

        do_PUT = do_POST

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        client, wanted = alerts.HttpAlerts(f"http://127.0.0.1:{server.server_port}/alerts"), alerts.standard_alerts("Shop")
        plan = {"create": ["shop_workflow_failures"], "update": ["shop_new_errors"], "same": [], "unmanaged": ["by_hand"]}
        assert alerts.apply(client, wanted) == plan and len(kept) == 2
        assert alerts.apply(client, wanted, dry_run=False) == plan
        assert alerts.apply(client, wanted) == {"create": [], "update": [], "same": ["shop_new_errors", "shop_workflow_failures"], "unmanaged": ["by_hand"]}
    finally:
        server.shutdown()


def test_telemetry_is_off_by_default(spark):
    off = alerts.TelemetrySettings.from_env({})
    on = alerts.TelemetrySettings.from_env({"TRUSTLAKE_TELEMETRY_ENDPOINT": "https://x", "TRUSTLAKE_TELEMETRY_HEADERS": "a=b, c=d=e", "TRUSTLAKE_TELEMETRY_SAMPLE": "0.25"})
    assert not off.enabled and on.enabled and on.headers == (("a", "b"), ("c", "d=e"))
    spans = spark.range(4000).selectExpr("cast(id % 1000 AS string) AS trace_id")
    assert off.sampled(spans).count() == 0
    kept = on.sampled(spans).groupBy("trace_id").count().collect()
    assert 180 < len(kept) < 320 and all(r["count"] == 4 for r in kept)
    for env in ({"TRUSTLAKE_TELEMETRY_SAMPLE": "2"}, {"TRUSTLAKE_TELEMETRY_HEADERS": "x"}, {"TRUSTLAKE_TELEMETRY_ENDPOINT": "ftp://x"}):
        with pytest.raises(ValueError):
            alerts.TelemetrySettings.from_env(env)
