"""The overview reads its window once; the privacy payload with odd rows; rolling windows against single ones."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from focusloom import config as C
from focusloom.operators import profile, summary
from focusloom.plans import catalogue
from focusloom.schema import EVENT
from tests.test_operators import SF


def test_overview_reads_its_events_once(spark):
    events = catalogue.events(spark, SF)
    figures, parts = summary.overview_parts(events, 14)
    window = events.where("ts_start >= timestamp_ntz '2024-01-17 00:00:00'")
    assert figures["events_all_time"] == events.count() and figures["events_in_window"] == window.count() and figures["oldest_event"] == events.agg(F.min("ts_start")).first()[0]
    for name, part in parts.items():
        files = part.inputFiles()
        assert files and all("/window-" in f for f in files), name  # nothing but what was written on the one read
    assert parts["totals"].agg(F.sum("events")).first()[0] == figures["events_in_window"]
    assert {"graph_nodes", "graph_edges", "spheres", "profile", "hourly_heatmap"} <= set(parts) and parts["recent_events"].count() <= 50
    none, parts = summary.overview_parts(events.where("false"))
    assert none["events_all_time"] == 0 and none["dwell"] is None and parts["domains"].count() == 0


def test_privacy_payload(spark):
    now, day = datetime(2024, 1, 31), timedelta(days=1)
    rows = [(1, "u", now - 40 * day, {"email": 9}), (2, "u", now - day, {"email": 2, "ssn": 0}), (3, "u", now - day, {"ssn": 1}), (4, "u", None, None), (5, None, now, {})]
    events = spark.createDataFrame([(i, s, None, None, None, "coding", "focus", t, t, None, f) for i, s, t, f in rows], EVENT)
    got = {r.subject_id: r for r in summary.privacy(events, cfg=C.Config(capture_depth=2)).collect()}
    u = got["u"]
    assert (u.events_all_time, u.events_in_window, u.expired_events, u.redaction_summary, u.connector_activity) == (4, 3, 1, {"email": 2, "ssn": 1}, {})
    assert "browser tab title and sanitized URL domain" in u.captured and len(u.captured) == 8 and "keystrokes" in u.not_captured and u.settings["mask_pii"]
    assert got[None].events_all_time == 1 and summary.privacy(events.where("false")).collect() == []


def test_the_last_day_of_a_rolling_profile_is_the_window_that_ends_there(spark):
    events = catalogue.events(spark, SF)
    rolled = {(r.subject_id, r.day): r for r in profile.rolling(events).collect()}
    assert len(rolled) == events.select("subject_id", F.to_date("ts_start")).distinct().count()
    for subject, day in sorted(rolled)[:: max(1, len(rolled) // 6)]:
        own = events.where((F.col("subject_id") == subject) & (F.to_date("ts_start") <= F.lit(day)) & (F.datediff(F.lit(day), F.to_date("ts_start")) < 14))
        r = rolled[subject, day]
        assert r.events == own.count() and abs(r.mean_dwell - own.agg(F.avg(F.col("dwell").cast("double"))).first()[0]) < 0.006
    assert profile.rolling(events.where("false")).collect() == []
