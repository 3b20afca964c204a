"""Registered queries over packs and coverage, beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from focusloom.functions import text as T
from focusloom.operators import overview, packs, spheres
from focusloom.plans.catalogue import _CUT, _E, _mostly_resolved, _observed, _of, named


def _made_spheres(e: DataFrame) -> DataFrame:
    """Spheres made from a subject's domains, so that their packs can be told in SQL too."""
    by = e.where("domain <> 'system'").groupBy("subject_id", "domain").agg(F.count(F.lit(1)).alias("events"), F.sum("dwell").cast("double").alias("dwell"))
    k = F.element_at(F.create_map(*(x for d, n in (("coding", 1), ("browser-research", 2), ("planning", 3), ("communication", 4)) for x in (F.lit(d), F.lit(n)))), F.col("domain"))
    return by.select(
        "subject_id", F.concat_ws("|", "subject_id", "domain").alias("sphere_id"), F.when(F.col("domain") == "planning", "mail ana@x.org").otherwise(F.concat(F.lit("work on "), "domain")).alias("label"), "domain",
        F.lit("work").alias("task"), F.when(F.col("events") % 3 == 0, "active").otherwise("dormant").alias("state"), k.alias("rank"), F.lit(0.5).alias("confidence"), "events", "dwell", F.lit(1).alias("sessions"), F.lit("allowed").alias("gate_mode"),
    )


def _packed(e: DataFrame, target: str) -> DataFrame:
    out = packs.build(_made_spheres(e), e, "coding", target, e.select(F.concat_ws("|", F.col("subject_id"), F.lit("communication")).alias("sphere_id")))
    return out.select("subject_id", "status", "sphere_id", F.col("summary.title").alias("title"), *(F.col("counts")[d].alias(d) for d in packs.DECISIONS))


_PACKS = f"""{_E}, m AS (SELECT subject_id, domain, count(*) AS n FROM e WHERE domain <> 'system' GROUP BY ALL),
b AS (SELECT subject_id, arg_min(domain, (n % 3 <> 0, CASE domain WHEN 'coding' THEN 1 WHEN 'browser-research' THEN 2 WHEN 'planning' THEN 3 ELSE 4 END)) AS d FROM m GROUP BY 1),
p AS (SELECT DISTINCT subject_id, d, CASE WHEN d IS NULL THEN 'empty' WHEN d = 'communication' THEN 'blocked' ELSE 'ready' END AS status FROM e LEFT JOIN b USING (subject_id))"""
named("pack_admission", _of(lambda e: _packed(e, "codex")),
      f"""{_PACKS} SELECT subject_id, status, subject_id || '|' || d AS sphere_id, CASE WHEN status = 'ready' THEN CASE WHEN d = 'planning' THEN 'mail [email]' ELSE 'work on ' || d END END AS title,
      CASE WHEN status = 'empty' THEN 2 WHEN d = 'planning' THEN 4 ELSE 6 END AS allow, CASE WHEN status = 'empty' THEN 1 WHEN d = 'planning' THEN 6 ELSE 7 END AS summarize, 0 AS generalize,
      CASE WHEN d = 'planning' THEN 3 ELSE 0 END AS mask, CASE status WHEN 'ready' THEN 9 ELSE 10 END AS deny FROM p""")  # fmt: skip
named("pack_denied_target", _of(lambda e: _packed(e, "elsewhere")),
      f"{_PACKS} SELECT subject_id, CASE WHEN d IS NULL THEN 'empty' ELSE 'blocked' END AS status, subject_id || '|' || d AS sphere_id, CAST(NULL AS VARCHAR) AS title, 1 AS allow, 1 AS summarize, 0 AS generalize, 0 AS mask, 11 AS deny FROM p")
named("context_packs", _of(lambda e: packs.build(spheres.report(e, spheres.assigned_once(e)).drop("top_artifact", "last_seen"), e, "agent_prompt", "local_file").select("subject_id", "pack_id", "status", "sphere_id", F.to_json("summary").alias("summary"), F.to_json("decisions").alias("decisions"))))


def _handed(e: DataFrame) -> DataFrame:
    """Packs of the spheres that events with private text are dealt to, under the feedback on them."""
    rows = _observed(e)
    own = spheres.assigned_once(rows)
    out = packs.handoff(spheres.report(rows, own), own, e, "coding", "codex", _mostly_resolved(e))
    return out.select("subject_id", "pack_id", "status", "sphere_id", F.to_json("context").alias("context"), F.to_json("decisions").alias("decisions"))


named("handoff_packs", _of(_handed))
_stats = lambda e: overview.artifact_stats(e).select("subject_id", "artifact", T.stable_key("ev", T.json_string(F.col("subject_id")), T.json_string(F.col("artifact")), F.col("visits").cast("string"), T.json_cents(F.col("dwell"))).alias("evidence_key"))
named("evidence_keys", _of(_stats),
      f"""{_E}, a AS (SELECT subject_id, artifact, count(*) AS n, sum(dwell) AS d FROM e GROUP BY 1, 2)
      SELECT subject_id, artifact, 'ev_' || substr(sha256('["' || subject_id || '","' || artifact || '",' || n || ',' || regexp_replace(CAST(CAST(d AS DECIMAL(28,2)) AS VARCHAR), '(\\.\\d)0$', '\\1') || ']'), 1, 16) AS evidence_key FROM a""")  # fmt: skip
named("coverage", _of(packs.coverage),
      f"""{_E}, l AS (SELECT subject_id, count(*) AS events, max(ts_end) AS last_event FROM e GROUP BY 1), g AS (SELECT *, greatest(CAST(trunc(epoch({_CUT} - last_event)) AS BIGINT), 0) AS age_seconds FROM l)
      SELECT *, CASE WHEN age_seconds > 180 THEN 'stale' ELSE 'recent' END AS coverage, CASE WHEN age_seconds <= 180 THEN 'ready' ELSE 'stale' END AS health FROM g""")  # fmt: skip
