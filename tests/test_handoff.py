"""Manifest validation; golden rows of packs and coverage."""

from datetime import datetime, timedelta

import pytest

from focusloom.operators import connectors, packs


@pytest.mark.parametrize(
    "change",
    [
        {"sources": ["camera"]}, {"fields": []}, {"fields": [{"name": "a", "store": "raw", "from": "title"}]}, {"fields": [{"name": "a", "store": "token", "from": "title"}]},
        {"fields": [{"name": "a", "store": "redacted"}]}, {"fields": [{"name": "a", "store": "redacted", "pattern": "(x)"}]}, {"fields": [{"name": "a", "store": "redacted", "pattern": "(?P<value>"}]},
        {"fields": [{"name": "a", "store": "count", "from": "title"}] * 2}, {"graph": {"label_field": "b"}},
    ],
)
def test_manifest_mistakes_fail_the_load(change):
    good = {"id": "m", "apps": ["A"], "min_depth": 1, "sources": ["window_title"], "fields": [{"name": "a", "store": "redacted", "from": "title"}]}
    assert connectors.load([good])[0].fields[0].max_length == 120
    with pytest.raises(connectors.ManifestError):
        connectors.load([good, good | {"id": "n"} | change])
    with pytest.raises(connectors.ManifestError):
        connectors.load([good, good])


SPHERE = "subject_id string, rank int, sphere_id string, label string, domain string, task string, events long, sessions long, dwell double, state string, confidence double, gate_mode string"


@pytest.mark.parametrize(
    "label, gate, target, restricted, status, counts",
    [
        ("parser work", "allowed", "codex", False, "ready", (6, 7, 0, 0, 9)),
        ("parser work", "masked", "codex", False, "ready", (4, 6, 0, 3, 9)),
        ("to ana@x.org", "allowed", "json", False, "ready", (4, 6, 0, 3, 9)),
        ("parser work", "allowed", "codex", True, "blocked", (6, 7, 0, 0, 10)),
        ("parser work", "allowed", "nowhere", False, "blocked", (1, 1, 0, 0, 11)),
        (None, None, "codex", False, "empty", (2, 1, 0, 0, 10)),
    ],
)
def test_pack(spark, label, gate, target, restricted, status, counts):
    rows = [] if label is None else [("s", 2, "a", label, "coding", "build", 3, 1, 60.0, "active", 0.5, gate), ("s", 1, "b", "old", "coding", "build", 3, 1, 60.0, "dormant", 0.5, "allowed")]
    blocked = spark.createDataFrame([("a",)] if restricted else [], "sphere_id string")
    pack = packs.build(spark.createDataFrame(rows, SPHERE), spark.createDataFrame([("s",), ("s",)], "subject_id string"), "coding", target, blocked).collect()
    assert len(pack) == 1 and pack[0]["status"] == status
    assert tuple(pack[0]["counts"][d] for d in packs.DECISIONS) == counts
    text = packs.markdown(pack[0])
    assert "ana@x.org" not in text and (status == "ready") == ("## Summary" in text)


def test_high_sensitivity_blocks_and_placeholders_in_artifacts_mask(spark):
    schema = SPHERE + ", sensitivity string, artifacts array<struct<name:string,events:long>>"
    one = lambda how, name: packs.build(spark.createDataFrame([("s", 1, "a", "parser work", "coding", "build", 3, 1, 60.0, "active", 0.5, "allowed", how, [(name, 3)])], schema), spark.createDataFrame([("s",)], "subject_id string"), "coding", "codex").first()
    assert one("high", "x")["status"] == "blocked" and one("high", "x")["summary"] is None and one("high", "x")["decisions"][-1]["decision"] == "deny"
    assert one("low", "x")["summary"]["gate_mode"] == "allowed" and one("low", "to [EMAIL] at x")["summary"]["gate_mode"] == "masked"


def test_coverage(spark):
    end = datetime(2024, 1, 31)
    rows = [("new", end - timedelta(seconds=180)), ("old", end - timedelta(seconds=181)), ("none", None), ("ahead", end + timedelta(hours=1))]
    got = {r["subject_id"]: (r["age_seconds"], r["coverage"], r["health"]) for r in packs.coverage(spark.createDataFrame(rows, "subject_id string, ts_end timestamp_ntz")).collect()}
    assert got["new"] == (180, "recent", "ready") and got["old"] == (181, "stale", "stale") and got["ahead"][0] == 0
    assert got["none"][1:] == ("unavailable", "waiting")
