"""Context packs: what of a subject's working sphere may be handed on, and the ledger of that decision."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from focusloom import config as C
from focusloom.functions.text import json_cents, json_list, json_string, redact, shorten, stable_key
from focusloom.operators.learning import blocked_packs
from focusloom.operators.spheres import next_action
from focusloom.schema import AS_OF, as_of_column
from focusloom.sources.shared import written

# Purposes, targets and those that never leave the machine.
PURPOSES = {
    "coding": "Continue software implementation", "gitlab": "Prepare a GitLab issue or progress update", "research": "Summarize research and product context",
    "self_review": "Review personal work patterns", "agent_prompt": "Ground an assistant with current work context",
}
TARGETS = ("kiro", "codex", "gitlab", "local_file", "markdown", "json")
LOCAL_TARGETS = ("local_file", "markdown", "json")
DECISIONS = ("allow", "summarize", "generalize", "mask", "deny")
# Decisions taken for every pack, and those for the fields of one that is ready.
ALWAYS = {
    "purpose": "allow", "events.source_count": "summarize", "system_events": "deny", "raw_event_payloads": "deny", "subject_id": "deny", "event_ids": "deny",
    "full_urls": "deny", "screenshots": "deny", "keystrokes": "deny", "clipboard": "deny", "credentials": "deny",
}
FIELDS = {
    "summary.title": "allow", "summary.objective": "summarize", "summary.time_window": "summarize", "context.working_sphere": "allow", "context.top_artifacts": "summarize",
    "context.apps": "allow", "context.keywords": "summarize", "context.resume": "summarize", "context.recent_path": "summarize", "context.redaction_summary": "allow",
}
MASKED_FIELDS = ("summary.title", "context.top_artifacts", "context.redaction_summary")
WITHHELD = ("subject_id", "event_ids", "raw_event_payloads", "metadata_json", "full_urls", "document_bodies", "screenshots", "keystrokes", "clipboard", "credentials")


def target_allowed(target: str, cfg: C.Config = C.Config()) -> bool:
    return target in LOCAL_TARGETS or target in TARGETS and target in cfg.export_targets


def _ledger(status: Column, sensitive: Column, allowed: bool, restricted: Column) -> Column:
    one = lambda name, what: F.struct(F.lit(name).alias("field"), (what if isinstance(what, Column) else F.lit(what)).alias("decision"))
    base = [one("target", "allow" if allowed else "deny"), *(one(n, d) for n, d in ALWAYS.items())]
    fields = [one(n, F.when(sensitive, "mask").otherwise(d) if n in MASKED_FIELDS else d) for n, d in FIELDS.items()]
    none = F.array().cast("array<struct<field:string,decision:string>>")
    described = F.when((status == "ready") | restricted, F.array(*fields)).otherwise(F.array(one("working_sphere", "deny")))
    return F.concat(F.array(*base), described, F.when(restricted, F.array(one("context", "deny"))).otherwise(none))


def build(spheres: DataFrame, subjects: DataFrame, purpose: str, target: str, blocked: DataFrame | None = None, sphere_id: str | None = None, cfg: C.Config = C.Config()) -> DataFrame:
    """One pack for each row of subjects(subject_id).

    spheres: the sphere report. The sphere asked for is taken, else the active
    one, else the first. blocked(sphere_id): spheres under an open restriction.
    Labels are redacted once more on their way out, and a masked sphere, or one in whose label or artifacts that or a
    placeholder is found, makes the pack sensitive. Without a sphere a pack is empty;
    for a target that isn't allowed, under a restriction or of high sensitivity it
    is blocked and has no content.
    """
    if purpose not in PURPOSES:
        raise ValueError(f"unknown purpose {purpose!r}")
    allowed = target_allowed(target, cfg)
    known = spheres
    if sphere_id is not None:
        spheres = spheres.where(F.col("sphere_id") == sphere_id)
    best = spheres.groupBy("subject_id").agg(F.min_by(F.struct(*(c for c in spheres.columns if c != "subject_id")), F.struct(F.col("state") != "active", "rank")).alias("s"))
    df = subjects.select("subject_id").distinct().join(best, "subject_id", "left").withColumn("title", F.col("s.label"))
    df = redact(df, "title", replace(cfg, mask_pii=True, redact_urls=True), "found")  # whatever the settings, what leaves is masked
    df = df.withColumn("title", shorten(F.col("title"), 96))
    names = F.transform("s.artifacts", lambda a: a["name"]) if "artifacts" in spheres.columns else F.lit("")
    placeholder = F.lower(F.concat_ws(" ", "s.label", "s.task", "s.domain", names))
    marked = F.coalesce(*(F.when(placeholder.contains(m), True) for m in C.PLACEHOLDERS), F.lit(False))
    sensitive = F.coalesce(F.col("s.gate_mode") != "allowed", F.lit(False)) | marked | (F.size("found") > 0)
    if blocked is None:
        df = df.withColumn("_b", F.lit(False))
    else:
        named = blocked.select("sphere_id").distinct().select(F.col("sphere_id").alias("_id"), F.lit(True).alias("_b"))
        df = df.join(named, F.col("s.sphere_id") == F.col("_id"), "left").withColumn("_b", F.coalesce("_b", F.lit(False)))
    high = F.coalesce(F.col("s.sensitivity") == "high", F.lit(False)) if "sensitivity" in spheres.columns else F.lit(False)
    restricted = (F.col("_b") | high) & F.col("s").isNotNull() & F.lit(allowed)
    status = F.when(F.col("s").isNull(), "empty").when(F.lit(not allowed) | restricted, "blocked").otherwise("ready")
    df = df.withColumn("status", status).withColumn("decisions", _ledger(F.col("status"), sensitive, allowed, restricted))
    shown = lambda c: F.when(F.col("status") == "ready", c)
    summary = F.struct(
        F.col("title"), F.col("s.state"), F.col("s.domain"), F.col("s.task"), F.col("s.confidence"), F.col("s.events"), F.round(F.col("s.dwell") / 3600, 2).alias("hours"), F.col("s.sessions"),
        F.when(sensitive, "masked").otherwise("allowed").alias("gate_mode"),
    )
    made = F.transform("decisions", lambda x: x["decision"])
    counts = F.create_map(*(x for d in DECISIONS for x in (F.lit(d), F.size(made) - F.size(F.array_remove(made, d)))))
    key = F.concat(F.lit("pack_"), F.substring(F.sha2(F.to_json(F.struct(F.col("s.sphere_id"), F.lit(purpose).alias("purpose"), F.lit(target).alias("target"), shown(summary).alias("summary"))), 256), 1, 16))
    return df.select("subject_id", key.alias("pack_id"), "status", F.lit(purpose).alias("purpose"), F.lit(target).alias("target"), F.col("s.sphere_id").alias("sphere_id"), shown(summary).alias("summary"), "decisions", counts.alias("counts"), F.array(*map(F.lit, WITHHELD)).alias("withheld"))


#: How much of a sphere's path a pack shows.
PATH = 5
_BREAK = "\n|\n"


def contents(found: DataFrame, rows: DataFrame, purpose: str, target: str, days: int = 14, cfg: C.Config = C.Config()) -> DataFrame:
    """(subject_id, sphere_id, pack_id, evidence_keys, context) of each sphere of a report.

    found: the sphere report; rows: the assignment with its events' columns. All
    texts of a sphere are redacted in one go, whatever the settings. Evidence is
    named by hashes of what is stored, so that an objection to it finds it again.
    """
    latest = F.row_number().over(Window.partitionBy("subject_id", "sphere_id").orderBy(F.desc("ts_start"), F.desc("id")))
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    steps = rows.withColumn("k", latest).where(F.col("k") <= PATH).select("subject_id", "sphere_id", "k", F.struct("k", time(F.col("ts_start")).alias("time"), "app", "artifact", "domain", F.col("dwell").cast("double").alias("dwell"), F.col("gate.mode").alias("gate_mode")).alias("step"))
    path = steps.groupBy("subject_id", "sphere_id").agg(F.array_sort(F.collect_list("step")).alias("path"))
    df = found.join(path, ["subject_id", "sphere_id"])
    name = lambda x: x["name"]
    objective = next_action(F.col("task"))
    groups = [F.array("label", objective), F.transform("artifacts", name), F.transform("apps", name), F.col("keywords"), F.transform("path", lambda x: x["app"]), F.transform("path", lambda x: x["artifact"])]
    texts = F.transform(F.concat(*groups), lambda t: F.translate(F.coalesce(t, F.lit("")), "\n", " "))
    df = df.withColumn("_sizes", F.array(*map(F.size, groups))).withColumn("_text", F.array_join(texts, _BREAK))
    df = redact(df, "_text", replace(cfg, mask_pii=True, redact_urls=True), "_found").withColumn("_safe", F.split("_text", r"\n\|\n", -1))
    before = lambda i: F.aggregate(F.slice("_sizes", 1, i), F.lit(0), lambda a, x: a + x) if i else F.lit(0)
    safe = lambda i, k, limit: shorten(F.get("_safe", before(i) + k), limit)
    key = lambda x: stable_key("ev", json_string(F.col("sphere_id")), json_string(x["name"]), x["events"].cast("string"), json_cents(x["dwell"]))
    step_key = lambda x: stable_key("path", json_string(F.col("sphere_id")), json_string(x["time"]), json_string(x["app"]), json_string(x["artifact"]))
    df = df.withColumn("evidence_keys", F.transform("artifacts", key)).withColumn("_steps", F.transform("path", step_key))
    noted = F.map_zip_with("redaction_summary", "_found", lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)).cast("int"))
    # What a privacy gate is called.
    gate = F.when(F.size("redaction_summary") > 0, "masked before inference").otherwise("Depth 1 metadata only")
    context = F.struct(
        safe(0, F.lit(0), 96).alias("title"), safe(0, F.lit(1), 180).alias("objective"), F.col("state"), F.col("domain"), F.col("task"), "first_seen", "last_seen", F.greatest(F.col("sessions") - 1, F.lit(0)).alias("return_count"),
        F.transform("artifacts", lambda x, i: F.struct(F.get("evidence_keys", i).alias("evidence_key"), safe(1, i, 120).alias("name"), x["events"].alias("events"), x["dwell"].alias("dwell"), x["hours"].alias("hours"))).alias("top_artifacts"),
        F.transform("apps", lambda x, i: F.struct(safe(2, i, 72).alias("name"), x["events"].alias("events"))).alias("apps"), F.transform("keywords", lambda _, i: safe(3, i, 36)).alias("keywords"),
        F.struct(safe(4, F.lit(0), 72).alias("last_app"), safe(5, F.lit(0), 120).alias("last_artifact"), gate.alias("privacy_gate")).alias("resume"),
        F.transform("path", lambda x, i: F.struct(F.get("_steps", i).alias("evidence_key"), x["time"].alias("time"), safe(4, i, 72).alias("app"), safe(5, i, 120).alias("artifact"), x["domain"].alias("domain"), F.round(x["dwell"], 2).alias("dwell"), x["gate_mode"].alias("gate_mode"))).alias("recent_path"),
        noted.alias("redaction_summary"),
    )
    df = df.withColumn("context", context)
    quoted = lambda keys: json_list(F.transform(keys, json_string))
    pack = stable_key(
        "pack", json_string(F.col("sphere_id")), json_string(F.lit(purpose)), json_string(F.lit(target)), F.lit(str(days)), json_string(F.col("context.title")), json_string(F.col("domain")), json_string(F.col("task")),
        json_string(time(F.col("last_seen"))), quoted(F.col("evidence_keys")), quoted(F.slice("_steps", 1, 3)),
    )
    return df.select("subject_id", "sphere_id", pack.alias("pack_id"), "evidence_keys", "context")


def handoff(found: DataFrame, rows: DataFrame, subjects: DataFrame, purpose: str, target: str, feedback: DataFrame | None = None, days: int = 14, cfg: C.Config = C.Config()) -> DataFrame:
    """:func:`build` with the pack's context, its evidence, and the restrictions of feedback on sphere, pack and evidence.

    A blocked or empty pack has no context; its last decision says so.
    """
    made = build(found, subjects, purpose, target, cfg=cfg).drop("pack_id")
    told = contents(found, rows, purpose, target, days, cfg)
    out = made.join(told, ["subject_id", "sphere_id"], "left")
    if feedback is not None:
        out = written(out, "packs")  # it is asked which of them are restricted, and answered
        evidence = out.where("pack_id is not null").select("subject_id", "sphere_id", "pack_id", F.explode_outer("evidence_keys").alias("evidence_key"))
        restricted = blocked_packs(evidence, feedback, found.select("subject_id", "sphere_id")).select("pack_id", F.lit(True).alias("_hit"))
        hit = F.coalesce("_hit", F.lit(False)) & (F.col("status") == "ready")
        denied = F.array(F.struct(F.lit("context").alias("field"), F.lit("deny").alias("decision")))
        out = out.join(restricted, "pack_id", "left").withColumns({"status": F.when(hit, "blocked").otherwise(F.col("status")), "decisions": F.when(hit, F.concat("decisions", denied)).otherwise(F.col("decisions"))})
    shown = lambda c: F.when(F.col("status") == "ready", F.col(c)).alias(c)
    return out.select("subject_id", "pack_id", "status", "purpose", "target", "sphere_id", shown("summary"), shown("context"), "decisions", "withheld")


def markdown(pack: Row) -> str:
    """One pack as Markdown; a pack is a row, so this runs where it is shown."""
    counts = "- Counts: " + ", ".join(f"{d} {pack['counts'][d]}" for d in DECISIONS)
    head = [f"- Purpose: {PURPOSES[pack['purpose']]}", f"- Target: {pack['target']}", f"- Pack: {pack['pack_id']}"]
    gate = ["", "## Admission", counts, "", "## Withheld", *(f"- {w}" for w in pack["withheld"])]
    s = pack["summary"]
    if s is None:
        return "\n".join([f"# Context pack: {pack['status']}", "", *head, *gate]) + "\n"
    body = [
        "", "## Summary", f"- State: {s['state']}", f"- Domain: {s['domain']}", f"- Task: {s['task']}", f"- Confidence: {round(s['confidence'] * 100)}%",
        f"- Observed: {s['events']} events, {s['hours']}h, {s['sessions']} sessions",
    ]
    return "\n".join([f"# Context pack: {s['title']}", "", *head, *body, *gate]) + "\n"


def coverage(events: DataFrame, as_of: str = AS_OF, interval_seconds: int = 15, paused: bool = False) -> DataFrame:
    """How recent each subject's last sample is: paused, unavailable, stale or recent; ready for health up to 180 s."""
    last = events.groupBy("subject_id").agg(F.max("ts_end").alias("last_event"), F.count(F.lit(1)).alias("events"))
    since = F.timestamp_diff("SECOND", F.col("last_event"), as_of_column(as_of))
    age = F.when(since < 0, 0).otherwise(since)
    state = F.lit("paused") if paused else F.when(age.isNull(), "unavailable").when(age > max(180, 3 * interval_seconds), "stale").otherwise("recent")
    return last.select("subject_id", "events", "last_event", age.alias("age_seconds"), state.alias("coverage"), F.when(age.isNull(), "waiting").when(age <= 180, "ready").otherwise("stale").alias("health"))
