"""Evidence keys against json and hashlib; what a pack holds and what restricts it."""

import hashlib
import json

from pyspark.sql import functions as F

from focusloom.functions import text as T
from focusloom.operators import overview, packs, spheres
from focusloom.plans import catalogue
from focusloom.schema import EVENT
from tests.test_operators import SF, trace

FEEDBACK = "label string, subject_id string, sphere_id string, pack_id string, evidence_key string, resolved_at string"


def key(prefix, *parts):
    return f"{prefix}_{hashlib.sha256(json.dumps(parts, sort_keys=True, default=str, separators=(',', ':')).encode()).hexdigest()[:16]}"


def test_canonical_json(spark):
    odd = ["", "plain", 'a "b" \\ c', "tab\t line\n\r\b\f \x01\x1f\x7f", "café — 漢字 🙂", None, "é", "null", "/"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(odd)], "i int, s string")
    assert {r.i: r.j for r in rows.select("i", T.json_string(F.col("s")).alias("j")).collect()} == {i: json.dumps(s) for i, s in enumerate(odd)}
    values = [0.0, 1.5, 257.1, 257.11, 1000000.0, 20.25, 0.07, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    assert {r.i: r.j for r in rows.select("i", T.json_cents(F.col("v")).alias("j")).collect()} == {i: json.dumps(v) for i, v in enumerate(values)}


def test_evidence_keys_of_all_artifacts(spark):
    stats = overview.artifact_stats(catalogue.events(spark, SF))
    mine = T.stable_key("ev", T.json_string(F.col("subject_id")), T.json_string(F.col("artifact")), F.col("visits").cast("string"), T.json_cents(F.col("dwell")))
    rows = stats.select("subject_id", "artifact", "visits", "dwell", mine.alias("key")).collect()
    assert rows and all(r.key == key("ev", r.subject_id, r.artifact, r.visits, round(r.dwell, 2)) for r in rows)


def made(spark, rows, feedback=None, target="codex"):
    events = trace(spark, rows)
    own = spheres.assigned_once(events)
    restrictions = None if feedback is None else spark.createDataFrame(feedback, FEEDBACK)
    return packs.handoff(spheres.report(events, own, "2024-01-10 18:00:00"), own, events, "coding", target, restrictions).first()


ROWS = [(0, "gateway retry ledger", 60), (2, "gateway retry ledger", 30), (4, "gateway retry of ana@x.org", 60)]


def test_a_pack_holds_what_was_worked_on(spark):
    pack = made(spark, ROWS)
    c = pack.context
    assert pack.status == "ready" and c.title == "gateway retry ledger" and c.return_count == 0
    assert [(a.name, a.events, a.dwell) for a in c.top_artifacts] == [("gateway retry ledger", 2, 90.0), ("gateway retry of [email]", 1, 60.0)]
    assert c.top_artifacts[1].evidence_key == key("ev", pack.sphere_id, "gateway retry of ana@x.org", 1, 60.0)  # named by what is stored, shown redacted
    assert [p.artifact for p in c.recent_path] == ["gateway retry of [email]", "gateway retry ledger", "gateway retry ledger"] and c.resume.last_artifact == "gateway retry of [email]"
    assert c.keywords[:2] == ["gateway", "retry"] and c.redaction_summary["email"] >= 2 and c.objective.startswith("Open the latest artifact")
    assert "ana@" not in str(pack)
    parts = (pack.sphere_id, "coding", "codex", 14, c.title, c.domain, c.task, c.last_seen.strftime("%Y-%m-%dT%H:%M:%S.%f"), [a.evidence_key for a in c.top_artifacts], [p.evidence_key for p in c.recent_path[:3]])
    assert pack.pack_id == key("pack", *parts)


def test_feedback_on_sphere_pack_or_evidence_blocks(spark):
    pack = made(spark, ROWS)
    evidence = pack.context.top_artifacts[0].evidence_key
    for label, sphere, pack_id, ev in (("wrong", pack.sphere_id, None, None), ("stale", None, pack.pack_id, None), ("too_private", pack.sphere_id, None, None), ("wrong", None, None, evidence), ("too_private", "gone", "old", None)):
        blocked = made(spark, ROWS, [(label, "s", sphere, pack_id, ev, None)])
        assert blocked.status == "blocked" and blocked.context is None and blocked.summary is None and blocked.decisions[-1].decision == "deny"
    for free in ([("useful", "s", pack.sphere_id, None, None, None)], [("wrong", "s", pack.sphere_id, None, None, "2024")], [("wrong", "t", pack.sphere_id, None, None, None)], [("wrong", "s", "gone", None, None, None)], []):
        assert made(spark, ROWS, free).status == "ready"
    assert made(spark, ROWS, target="elsewhere").context is None
    assert packs.handoff(spheres.report(trace(spark, ROWS).where("false"), spheres.assigned_once(trace(spark, ROWS).where("false"))), spheres.assigned_once(trace(spark, ROWS).where("false")), spark.createDataFrame([("s",)], "subject_id string"), "coding", "codex").first().status == "empty"
