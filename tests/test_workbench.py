"""Golden rows of timelines, health, surfaces, workflow, scenarios, maintenance and masks."""

import hashlib
import hmac
import uuid

import pytest
from pyspark.sql import functions as F

from focusloom import config
from focusloom.operators import collective, connectors, harness, health, packs, resume, retrieve, spheres, surfaces, workflow
from focusloom.plans import catalogue
from focusloom.sources import maintenance, shared, tables
from tests.test_operators import BASE, SF, trace

def test_spheres_are_labelled_and_explained(spark):
    rows = [(0, "gateway retry ledger", 60), (2, "gateway retry budget", 60), (4, "gateway retry parser", 60)]
    events = trace(spark, rows)
    own = spheres.assigned_once(events)
    found = spheres.report(events, own)
    (row,) = found.collect()
    assert row["label"] == "build software: gateway retry ledger"  # no artifact twice: task and top tokens, of equal ones those seen first
    (why,) = spheres.explanations(found).collect()
    assert why["explanations"][:2] == ["Dominant work signal: coding / build software", "Shared terms: gateway, retry, ledger, budget"] and "Single continuous session so far" in why["explanations"]
    assert why["next_action"].startswith("Open the latest artifact")
    (pack,) = spheres.resume_packs(found, spheres.recent_events(events, own)).collect()
    assert (pack["last_artifact"], pack["return_count"], len(pack["recent"])) == ("gateway retry parser", 0, 3)
    twice = trace(spark, [(0, "gateway retry ledger", 60), (1, "gateway retry ledger", 60)])
    assert spheres.report(twice, spheres.assign(twice)).first()["label"] == "gateway retry ledger"


def test_resume_report_says_why_there_are_no_returns(spark):
    def why(rows):
        events = trace(spark, rows)
        found = resume.runs(events)
        (row,) = resume.report(events, found, resume.resume_events(found)).collect()
        return row["no_resumes_because"], row["resume_events"]

    assert why([(0, "A", 300), (60, "B", 300), (70, "A", 300)]) == (None, 1)
    assert why([(0, "A", 5)]) == ("no substantive run", 0)
    assert why([(0, "A", 300)]) == ("no interruption", 0)
    assert why([(0, "A", 5), (60, "B", 300)]) == ("no task to return to", 0)
    assert why([(0, "A", 300), (60, "B", 300), (120, "C", 300)]) == ("never returned", 0)


def test_distribution_finds_its_places(spark):
    values = [3.5, 1.0, 2.25, 2.25, 900.0, 7.0, 7.5, 7.5]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", 5.0), ("a", None)], "k string, v double")
    got = {r["k"]: r.asDict() for r in resume.distribution(rows, "v", "k").collect()}
    v = sorted(values)
    assert got["a"] == {"k": "a", "n": 8, "median": (v[3] + v[4]) / 2, "p25": v[round(0.25 * 7)], "p75": v[round(0.75 * 7)], "p90": v[round(0.9 * 7)], "least": 1.0, "most": 900.0}
    assert got["b"]["median"] == 5.0 and resume.distribution(rows.where("false"), "v").first()["n"] == 0


def test_masks_of_all_pairs(spark):
    assert catalogue.QUERIES["secure_theme_totals"](spark, SF).count() == 12
    row = spark.createDataFrame([("message",)], "m string").select(collective._hmac(b"key", F.col("m")).alias("h")).first()
    assert row["h"] == hmac.new(b"key", b"message", hashlib.sha256).hexdigest()
    work = spark.createDataFrame([(f"s{i}", "coding:review", 1, 1.0) for i in range(90)], "subject_id string, theme string, events long, dwell double")
    for cohort in (8, 200):
        masked = collective.masked(collective.contributions(work), b"k", "r", cohort)
        assert {r["theme"]: r["total"] for r in collective.secure_sum(masked).collect()}["coding:review"] == 90
        assert masked.where("masked < 1000").count() < 5
    for bad in (dict(cohort=["a"]), dict(cohort=["a", "a"]), dict(round_id=" "), dict(contributed=["a"]), dict(width=3)):
        with pytest.raises(ValueError):
            collective.check_round(**{"cohort": ["a", "b"], "round_id": "r", "contributed": ["b", "a"], "width": 12} | bad)
    version, rows, digest = collective.load_vocabulary('{"version": "1", "themes": [{"id": "a", "description": "x"}]}')
    assert rows == [("a", "x")] and digest == collective.vocabulary_digest("1", ["a"])
    with pytest.raises(ValueError):
        collective.load_vocabulary('{"version": "1", "themes": [{"id": "a"}]}')
    totals = spark.createDataFrame([("a", 2), ("b", 9)], "theme string, total long")
    noisy = collective.synthesize(totals, F.lit(10), 2, epsilon=50.0)
    assert 1 <= noisy.count() <= 2 and collective.synthesize(totals, F.lit(10), 3).first()["withheld"] == "1-2"


def test_health_and_fleet(spark):
    assert dict(health.checks(config.Config(mask_pii=False, raw_event_upload=True), {}, False))["PII masking"] == "blocked"
    events = trace(spark, [(0, "A", 60)])
    at = str(BASE.replace(minute=2))
    assert health.last_sample(events, at).first()["status"] == "ready" and health.report(events, as_of=at).first()["posture"] == "ready"
    assert health.report(events, config.Config(mask_pii=False), as_of=at).first()["posture"] == "blocked"
    assert health.fleet(events, collector=False, as_of=at).first()["health"] == "offline" and health.fleet(events, as_of=at).first()["health"] == "online"
    assert health.policy(config.Config())["allowed_export_targets"] and health.permitted_sources(config.Config(capture_depth=3)) == ["window_title", "browser_tab", "accessibility"]


def test_settings_are_loaded_and_clamped():
    cfg = config.Config(capture_depth=2, names=("Ana",))
    assert config.load(config.dump(cfg)) == cfg
    got = config.load('{"capture_depth": 9, "retention_days": "x", "max_nodes": "12", "unknown": 1, "mask_pii": "no"}')
    assert (got.capture_depth, got.retention_days, got.max_nodes, got.mask_pii) == (4, 30, 12, True)
    assert config.clamp("7", 1, 1, 5) == 5 and config.clamp(None, 3) == 3


def test_surfaces(spark):
    df = spark.createDataFrame([([("  a@b.co  x ", 0.5), ("A@B.CO x", None), ("", 0.1), ("two", 0.9)],), ([],)], "lines array<struct<text:string,confidence:double>>")
    from focusloom.functions.text import redact_emails

    full, none = [r[0] for r in df.select(surfaces.sanitized_lines(F.col("lines"), redact_emails)).collect()]
    assert (full["status"], full["hints"], full["summary"], full["confidence"]) == ("captured", ["[email] x", "two"], "[email] x; two", 0.7)
    assert (none["status"], none["hints"], none["confidence"]) == ("empty", [], 0.0)
    kinds = spark.createDataFrame([("empty", "captured")], "a string, b string").select(surfaces.chosen_surface({"browser_tab": F.struct(F.col("a").alias("status")), "ocr_summary": F.struct(F.col("b").alias("status"))}).alias("k"))
    assert kinds.first()["k"] == "ocr_summary"
    maps = spark.createDataFrame([({"email": "2", "url": "x", "ssn": "0"}, {"email": 1}, {"url": 3})], "s map<string,string>, a map<string,int>, b map<string,int>")
    assert maps.select(surfaces.whole_findings(F.col("s")).alias("m")).first()["m"] == {"email": 2}
    assert maps.select(surfaces.merged_findings(F.col("a"), F.col("b")).alias("m")).first()["m"] == {"email": 1, "url": 3}


def test_feedback_and_resume_logs(spark, tmp_path):
    path = str(tmp_path / "feedback")
    first = workflow.add_feedback(spark, path, {"subject_id": "s", "sphere_id": "x", "label": "Too Private", "created_at": "2024-01-01"})
    workflow.add_feedback(spark, path, {"subject_id": "s", "sphere_id": "x", "label": "useful", "created_at": "2024-01-02"})
    with pytest.raises(ValueError):
        workflow.add_feedback(spark, path, {"label": "nonsense"})
    workflow.resolve_feedback(spark, path, first, "2024-01-03")
    rows = workflow.feedback(spark.read.parquet(path)).collect()
    assert [(r["label"], r["resolved_at"]) for r in rows] == [("useful", None), ("too_private", "2024-01-03")]
    log = workflow.ResumeLog(spark, str(tmp_path / "log"), "s")
    a = log.checkpoint("x", None, "half done", "2024-01-01")
    with pytest.raises(workflow.Conflict):
        log.checkpoint("x", None, "again", "2024-01-02")
    request = str(uuid.uuid4())
    session = log.start(request, "x", "p", "2024-01-02")
    assert log.start(request, "x", "p", "2024-01-02") == session
    with pytest.raises(workflow.Conflict):
        log.outcome(session, "progress", "2024-01-02")
    log.shown(session, "2024-01-02")
    log.outcome(session, "progress", "2024-01-02")
    log.outcome(session, "progress", "2024-01-03")
    with pytest.raises(workflow.Conflict):
        log.outcome(session, "no_progress", "2024-01-03")
    log.checkpoint("x", a, "more done", "2024-01-04")
    with pytest.raises(workflow.Conflict):
        log.start(request, "x", "p", "2024-01-05")
    cards = spark.createDataFrame([("s", "a"), ("t", "b")], "subject_id string, card string")
    workflow.write_cards(cards, str(tmp_path / "cards"))
    workflow.write_cards(cards.where("card = 'a'").withColumn("card", F.lit("c")), str(tmp_path / "cards"))
    assert {(r["subject_id"], r["card"]) for r in spark.read.parquet(str(tmp_path / "cards")).collect()} == {("s", "c"), ("t", "b")}


def test_scenarios(spark):
    scenarios = [{"name": "good", "events": [{"artifact": "gateway retry ledger", "domain": "coding", "minutes_ago": m, "dwell": 120} for m in (30, 20, 10)]}, {"name": "leak", "events": [{"artifact": "canary retry", "domain": "coding", "minutes_ago": 5}]}]
    events = harness.scenario_events(spark, scenarios).drop("scenario")
    built = packs.build(spheres.report(events, spheres.assign(events)).drop("top_artifact", "last_seen"), events, "coding", "codex")
    told = built.select(F.col("subject_id").alias("scenario"), F.to_json(F.struct("summary", "decisions")).alias("blob"), F.array("summary.title").alias("artifacts"))
    expected = spark.createDataFrame([("good", ["gateway"], ["canary"], ["gateway retry ledger"], 1.0), ("leak", [], ["canary"], [], 0.0)], "scenario string, must array<string>, must_not array<string>, wanted array<string>, least double")
    results = harness.score(told, expected)
    got = {r["scenario"]: r for r in results.collect()}
    assert (got["good"]["recall"], got["good"]["leaks"], got["good"]["noise_ratio"], got["good"]["passed"]) == (1.0, 0, 0.0, True)
    assert got["leak"]["leaks"] == 1 and not got["leak"]["passed"]
    end = harness.verdict(results).first()
    assert (end["scenarios"], end["passed"], end["leak_count"], end["ok"]) == (2, 1, 1, False)


def test_maintenance(spark, tmp_path):
    events = trace(spark, [(0, "mail a@b.co", 1), (1, "b", 1)]).unionByName(trace(spark, [(2, "c", 1)]).withColumn("subject_id", F.lit("t")).withColumn("id", F.lit(7).cast("long")))
    assert {r["category"]: r["n"] for r in maintenance.dry_run(events).collect()} == {"": 1, "email": 1}
    assert [r["artifact"] for r in maintenance.redacted_again(events).orderBy("id").collect()] == ["mail [email]", "b", "c"]
    changes = spark.createDataFrame([(1, "new", 2), (1, "old", 1), (1, None, 3), (9, "x", 1)], "id long, artifact string, at int")
    assert [r["artifact"] for r in maintenance.updated(events, changes).orderBy("id").collect()] == ["mail a@b.co", "new", "c"]
    path, derived = str(tmp_path / "events"), str(tmp_path / "feedback")
    tables.write_events(events, path)
    events.select("id", "subject_id").write.parquet(derived)
    maintenance.delete_all(spark, path, "s", (derived, str(tmp_path / "none")))
    assert [r["id"] for r in spark.read.parquet(path).collect()] == [7] == [r["id"] for r in spark.read.parquet(derived).collect()]
    maintenance.delete_all(spark, path)
    assert spark.read.schema(events.schema).parquet(path).count() == 0
    assert maintenance.unless_paused(events, config.Config(collection_paused=True)).count() == 0 and maintenance.without_repeats(events.union(events)).count() == 3
    times = spark.createDataFrame([("2024-01-10T09:00:00Z",), ("2024-01-10T10:00:00+01:00",), ("no",)], "t string").select(maintenance.parse_time(F.col("t")).alias("t")).collect()
    assert times[0]["t"] == times[1]["t"] and times[2]["t"] is None
    one, two = "00" * 32, "11" * 32
    coded = maintenance.rekeyed(maintenance.rekeyed(events.select("id", "artifact"), ("artifact",), None, one), ("artifact",), one, two)
    assert maintenance.assert_encrypted(coded, ("artifact",), two).count() == 3
    with pytest.raises(Exception, match="not encrypted"):
        maintenance.assert_encrypted(coded, ("artifact",), one).collect()


def test_connectors_leave_other_apps_alone(spark):
    events = trace(spark, [(0, "cedar plan", 1)])
    out = connectors.apply_each(events, {"window_title": connectors.payload(title=F.col("artifact"))}, 1, connectors.load([{"id": "m", "apps": ["other"], "min_depth": 1, "sources": ["window_title"], "fields": [{"name": "a", "store": "redacted", "from": "title"}]}]))
    assert out.first()["structured"] is None and out.columns == [*events.columns, "structured"]
    built_in = connectors.apply_each(events.withColumn("app", F.lit("Safari")), {"browser_tab": connectors.payload(title=F.lit("Docs of a@b.co"), url_domain=F.lit("X.org:1"))}, 2)
    s = built_in.first()["structured"]
    assert s["fields"]["page_title"] == "Docs of [email]" and s["fields"]["domain"] == "x.org" and s["fields"]["page_kind"] == "docs" and s["missing_fields"] == ["heading"]


def test_retrieval_tells_why(spark):
    events = trace(spark, [(0, "alpha", 60), (2, "beta", 60), (4, "alpha", 60)])
    rows = retrieve.retrieve(events, "alpha", filters=["proportional", "recurrent"], why=True).collect()
    assert rows[0]["artifact"] == "alpha" and rows[0]["why"] == ["proportional: high dwell time", "recurrent: repeated revisits"]


def test_tables_are_written_once(spark):
    assert shared.written(spark.range(3), "x").count() == 3
