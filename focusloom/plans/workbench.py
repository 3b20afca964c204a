"""Registered queries over timelines, health, surfaces, workflow, masked totals and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from focusloom import config
from focusloom.operators import collective, connectors, health, overview, profile, resume, retrieve, spheres, summary, surfaces, workflow
from focusloom.plans.catalogue import _CUT, _DECLARED, _E, _GAP, _KL, _PIVOT, _REDACT, _FIGURES, _RUNS, _SCAN, _STATUS, _TRANS_R, _VOCABULARY, _declared, _feedback, _observed, _of, _runs, _sphere_figures, _windows_sql, named
from focusloom.operators import learning
from focusloom.functions.text import normalize_artifact, redact_emails
from focusloom.schema import as_of_column
from focusloom.sources import maintenance
from focusloom.sources.tables import documents

# spheres of a subject's domains, so that what follows from an assignment can be told in SQL too


def _by_domain(e: DataFrame) -> DataFrame:
    return overview.without_system(e).select("id", "subject_id", F.lit(0).alias("sphere_ordinal"), F.concat_ws("|", "subject_id", "domain").alias("sphere_id"), F.lit(0.5).alias("score"))


def _labelled(e: DataFrame) -> DataFrame:
    """Two domains' spheres with labels: the others aren't selected."""
    return e.where("domain in ('coding', 'planning')").select("subject_id", F.concat_ws("|", "subject_id", "domain").alias("sphere_id"), F.concat(F.lit("work: "), "domain").alias("label")).distinct()


_ROWS = f"""{_E}, r AS (SELECT *, subject_id || '|' || domain AS sphere_id FROM e WHERE domain <> 'system' AND action <> 'system'),
x AS (SELECT *, lag(sphere_id) OVER q AS ps, lag(ts_end) OVER q AS pe FROM r WINDOW q AS (PARTITION BY subject_id ORDER BY ts_start, id)),
y AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> sphere_id OR ts_start > pe + INTERVAL 1440 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id ORDER BY ts_start, id ROWS UNBOUNDED PRECEDING) AS segment FROM x),
a AS (SELECT subject_id, segment, app, min(sphere_id) AS sphere_id, min(ts_start) AS s, max(ts_end) AS t, count(*) AS n, sum(dwell) AS d, min((ts_start, id)) AS f FROM y GROUP BY 1, 2, 3),
sg AS (SELECT subject_id, segment, min(sphere_id) AS sphere_id, min(s) AS seg_start, max(t) AS seg_end, CAST(sum(n) AS BIGINT) AS events, CAST(sum(d) AS DOUBLE) AS dwell, arg_min(app, (-n, f)) AS top_app FROM a GROUP BY 1, 2),
l AS (SELECT DISTINCT subject_id, subject_id || '|' || domain AS sphere_id, 'work: ' || domain AS label FROM e WHERE domain IN ('coding', 'planning')),
mv AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY count DESC, first) AS rank FROM (SELECT subject_id, ps AS source, sphere_id AS target, count(*) AS count, max(ts_start) AS last_seen, min((ts_start, id)) AS first FROM x WHERE ps <> sphere_id GROUP BY 1, 2, 3))"""
named("domain_segments", _of(lambda e: spheres.segments(e, _by_domain(e), 24 * 60)), f"{_ROWS} SELECT * FROM sg")
named("sphere_timeline", _of(lambda e: spheres.timeline(spheres.segments(e, _by_domain(e), 24 * 60), _labelled(e))),
      f"{_ROWS} SELECT subject_id, rank, sphere_id, label, seg_start, seg_end, events, dwell, round(dwell / 3600, 2) AS hours, top_app FROM (SELECT sg.*, label, row_number() OVER (PARTITION BY sg.subject_id ORDER BY seg_start DESC, segment DESC) AS rank FROM sg JOIN l USING (subject_id, sphere_id)) WHERE rank <= 20")
named("sphere_transitions", _of(lambda e: spheres.transitions(e, _by_domain(e))), f"{_ROWS} SELECT subject_id, source, target, count, last_seen, rank FROM mv WHERE rank <= 12")
named("selected_transitions", _of(lambda e: spheres.selected_transitions(spheres.transitions(e, _by_domain(e)), _labelled(e))),
      f"{_ROWS} SELECT mv.subject_id, source, target, count, last_seen, rank, a.label AS source_label, b.label AS target_label FROM mv JOIN l a ON a.subject_id = mv.subject_id AND a.sphere_id = source JOIN l b ON b.subject_id = mv.subject_id AND b.sphere_id = target WHERE rank <= 12")
named("recent_events", _of(lambda e: spheres.recent_events(e, _by_domain(e))),
      f"{_ROWS} SELECT subject_id, sphere_id, rank, id, artifact, app, ts_end FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, sphere_id ORDER BY ts_start DESC, id DESC) AS rank FROM r) WHERE rank <= 8")
named("next_actions", _of(lambda e: e.select("id", spheres.next_action(F.concat_ws(" ", "domain", "artifact")).alias("hint"))),
      f"""{_E} SELECT id, CASE WHEN contains(t, 'research') THEN 'Summarize the strongest source and connect it to the active product concept.'
      WHEN contains(t, 'build') OR contains(t, 'verify') OR contains(t, 'test') THEN 'Open the latest artifact, check the last verification result, then continue the next small implementation step.'
      WHEN contains(t, 'document') OR contains(t, 'plan') THEN 'Review the latest note, extract decisions, and turn the next open item into a task.'
      WHEN contains(t, 'communicate') THEN 'Draft the next response using only the admitted context for this sphere.'
      ELSE 'Review the latest artifact and decide whether this sphere should continue, pause, or be ignored.' END AS hint FROM (SELECT id, domain || ' ' || artifact AS t FROM e)""")  # fmt: skip
def _explained(e: DataFrame) -> DataFrame:
    own = spheres.assigned_once(e)
    return spheres.explanations(spheres.report(e, own)).select("subject_id", "sphere_id", F.array_join("explanations", "; ").alias("explanations"), "next_action")


named("sphere_explanations", _of(_explained))
named("token_ranks", _of(lambda e: spheres.token_ranks(e, _by_domain(e), 4).select("subject_id", "sphere_id", F.array_join("tokens", " ").alias("tokens"))),
      f"""{_ROWS}, tl AS (SELECT subject_id, sphere_id, ts_start, id, list_distinct(ws) AS ds, ws FROM (SELECT *, [x FOR x IN string_split(trim(regexp_replace(lower(artifact), '[^a-z0-9]+', ' ', 'g')), ' ') IF length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+')] AS ws FROM r)),
      tk AS (SELECT subject_id, sphere_id, t, count(*) AS c, min((ts_start, id, list_position(ws, t))) AS f FROM (SELECT *, unnest(ds) AS t FROM tl) GROUP BY ALL)
      SELECT subject_id, sphere_id, string_agg(t, ' ' ORDER BY k) AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, sphere_id ORDER BY c DESC, f) AS k FROM tk) WHERE k <= 4 GROUP BY 1, 2""")  # fmt: skip

# returns


def _resumed(e: DataFrame) -> DataFrame:
    found = _runs(e)
    return resume.report(e, found, resume.resume_events(found, _GAP, 10.0), _GAP, 10.0)


_SEEN = f"""steps AS (SELECT *, epoch(run_start) - epoch(lag(run_end) OVER q) AS pause, lag(dwell) OVER q AS ld, lag(cluster) OVER q AS lc, max(CASE WHEN dwell >= 10 THEN 1 END) OVER (PARTITION BY subject_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchored FROM runs WINDOW q AS (PARTITION BY subject_id ORDER BY run)),
      seen AS (SELECT *, coalesce(pause >= {_GAP} * 60, false) AS far, coalesce(pause < {_GAP} * 60 AND ld >= 10 AND cluster <> lc, false) AS moved FROM steps),
      ev AS (SELECT subject_id, count(*) AS events_considered FROM e GROUP BY 1)"""
_COUNTS = "SELECT subject_id, events_considered, count(*) FILTER (dwell >= 10) AS substantive_runs, count(*) FILTER (far OR moved) AS interruptions, count(*) FILTER (far AND anchored = 1 OR moved) AS with_task FROM seen JOIN ev USING (subject_id) GROUP BY 1, 2"
named("resume_report", _of(lambda e: _resumed(e).withColumns({c: F.round(c, 3) for c in ("least_seconds", "most_seconds")})),
      f"""{_SCAN}, {_SEEN}, told AS ({_COUNTS}), back AS (SELECT x.subject_id, count(*) AS n, round(min(back_at - s), 3) AS lo, round(max(back_at - s), 3) AS hi FROM scan JOIN x ON x.subject_id = scan.subject_id AND x.run = scan.run WHERE hit GROUP BY 1)
      SELECT told.*, coalesce(n, 0) AS resume_events, lo AS least_seconds, hi AS most_seconds, CASE WHEN n > 0 THEN NULL WHEN substantive_runs = 0 THEN 'no substantive run' WHEN interruptions = 0 THEN 'no interruption' WHEN with_task = 0 THEN 'no task to return to' ELSE 'never returned' END AS no_resumes_because FROM told LEFT JOIN back USING (subject_id)""")  # fmt: skip
named("interruptions", _of(lambda e: resume.report(e, _runs(e), resume.resume_events(_runs(e), _GAP, 1e9), _GAP, 10.0).select("subject_id", "events_considered", "substantive_runs", "interruptions", "with_task")),
      f"{_RUNS}, {_SEEN} {_COUNTS}")

# health and fleet

named("last_sample", _of(lambda e: health.last_sample(e, days=3)),
      f"""{_E}, g AS (SELECT subject_id, count(*) FILTER (ts_start >= {_CUT} - INTERVAL 3 DAYS) AS events_in_window, count(*) AS events_all_time, max(ts_end) FILTER (ts_start >= {_CUT} - INTERVAL 3 DAYS) AS last_event, arg_max(app, (ts_end, id)) FILTER (ts_start >= {_CUT} - INTERVAL 3 DAYS) AS last_app FROM e GROUP BY 1),
      h AS (SELECT *, greatest(CAST(trunc(epoch({_CUT} - last_event)) AS BIGINT), CASE WHEN last_event IS NOT NULL THEN 0 END) AS a FROM g)
      SELECT subject_id, events_in_window, events_all_time, last_event, last_app, coalesce(a, 0) AS last_age_seconds, CASE WHEN last_event IS NULL THEN 'waiting' WHEN a <= 180 THEN 'ready' ELSE 'stale' END AS status FROM h""")  # fmt: skip
_COVERED = config.Config(capture_depth=2, device_id="d", store_url_query=True)
named("health_report", _of(lambda e: health.report(e, _COVERED, {"collector": True, "dashboard": True, "watchdog": False, "learning": True}).select("subject_id", "n_ready", "n_attention", "n_blocked", "posture")),
      f"""{_E}, g AS (SELECT subject_id, coalesce(epoch({_CUT} - max(ts_end) FILTER (ts_start >= {_CUT} - INTERVAL 1 DAYS)) < 181, false) AS fresh FROM e GROUP BY 1)
      SELECT subject_id, CASE WHEN fresh THEN 8 ELSE 7 END AS n_ready, CASE WHEN fresh THEN 3 ELSE 4 END AS n_attention, 0 AS n_blocked, 'attention' AS posture FROM g""")  # fmt: skip
named("fleet", _of(lambda e: health.fleet(e, _COVERED, dashboard=False)),
      f"""{_E}, g AS (SELECT subject_id, count(*) AS events, arg_max(ts_end, (ts_start, id)) AS last_event FROM e GROUP BY 1), h AS (SELECT *, CASE WHEN trunc(epoch({_CUT} - last_event)) > 180 THEN 'stale' ELSE 'collector-only' END AS health FROM g)
      SELECT *, health = 'collector-only' AS online, 'local-only' AS status, 'local_only' AS sync_mode, 3 AS readiness_ready, 7 AS readiness_total, 0 AS blocking FROM h""")  # fmt: skip
named("fleet_readiness", lambda s, d: health.check_rows(s, _COVERED),
      "SELECT * FROM (VALUES ('Device identity', 'ready'), ('Local redaction', 'ready'), ('Raw event upload', 'ready'), ('Browser URL minimization', 'attention'), ('Control plane', 'not enrolled'), ('Encryption at rest', 'planned'), ('Signed updates', 'planned')) v(name, status)")

# surfaces and overview

_MEDIA = "contains(lower(app || ' ' || artifact), 'cedar')"
named("media_surface", lambda s, d: documents(s, d).select("doc_id", surfaces.is_media(F.col("source"), F.col("text")).alias("media")),
      "SELECT doc_id, " + " OR ".join(f"contains(lower(source || ' ' || coalesce(text, '')), '{w}')" for w in surfaces.MEDIA) + " AS media FROM documents")
named("media_focus", _of(surfaces.media_focus),
      f"""{_E}, m AS (SELECT *, {" OR ".join(f"contains(lower(app || ' ' || artifact), '{w}')" for w in surfaces.MEDIA)} AS media FROM e), f AS (SELECT subject_id, arg_max((app, artifact, ts_end, media), (media, ts_start, id)) AS f FROM m GROUP BY 1)
      SELECT subject_id, f[1] AS app, substr(f[2], 1, 160) AS artifact, f[3] AS last_seen, CASE WHEN f[4] THEN 'opaque' ELSE 'watching' END AS status, CASE WHEN f[4] THEN 'app/window only' ELSE 'attention only' END AS visibility FROM f""")  # fmt: skip
named("attention_depth", _of(lambda e: surfaces.attention_depth(e, ("app1", "app2"), ("APP3",), ("app4",), depth=3)),
      f"""{_E}, r AS (SELECT * FROM e WHERE domain <> 'system' AND action <> 'system'), b AS (SELECT subject_id, app, artifact, count(*) AS n, sum(dwell) AS d, max(ts_end) AS x, min((ts_start, id)) AS f FROM r GROUP BY 1, 2, 3),
      g AS (SELECT subject_id, app, CAST(sum(n) AS BIGINT) AS events, CAST(sum(d) AS DOUBLE) AS dwell, max(x) AS last_seen, arg_min(artifact, (-n, f)) AS top_artifact FROM b GROUP BY 1, 2)
      SELECT * FROM (SELECT *, CASE WHEN app IN ('app1', 'app2') THEN 'browser metadata' WHEN app = 'app3' THEN 'UI metadata' WHEN app = 'app4' THEN 'local OCR ready at Depth 4' ELSE 'window metadata' END AS status, row_number() OVER (PARTITION BY subject_id ORDER BY dwell DESC, app) AS rank FROM g) WHERE rank <= 8""")  # fmt: skip
named("window_totals", _of(lambda e: surfaces.window_totals(overview.window_scan(e, 14), as_of_column())),
      f"{_E} SELECT subject_id, count(*) AS events, CAST(sum(dwell) AS DOUBLE) AS dwell, min(ts_start) AS first_event, max(ts_end) AS last_event, round(CAST(sum(dwell) AS DOUBLE) / 3600, 2) AS hours, greatest(CAST(trunc(epoch({_CUT} - max(ts_end))) AS BIGINT), 0) AS age_seconds FROM e WHERE ts_start IS NULL OR ts_start >= {_CUT} - INTERVAL 14 DAYS GROUP BY 1")
_SIG = f"""{_E}, {_windows_sql(5, 14)}, {_TRANS_R}, en AS (SELECT subject_id, round(-sum(p * log2(p)), 4) AS entropy FROM (SELECT subject_id, n / sum(n) OVER (PARTITION BY subject_id) AS p FROM t) GROUP BY 1),
rv AS (SELECT subject_id, round(sum(CASE WHEN n > 1 THEN n - 1 ELSE 0 END) / sum(n), 4) AS revisit_rate FROM (SELECT subject_id, artifact, count(*) AS n FROM r GROUP BY ALL) GROUP BY 1),
ow AS (SELECT subject_id, least(count(*) FILTER (long >= 0.15), 5) AS owned FROM w GROUP BY 1), kl AS (SELECT subject_id, {_KL} AS kl FROM w GROUP BY 1),
tp AS (SELECT subject_id, arg_max(domain, (share, domain)) AS top_domain, max(share) AS top_share FROM (SELECT subject_id, domain, round(CAST(d AS DOUBLE) / CAST(sum(d) OVER (PARTITION BY subject_id) AS DOUBLE), 4) AS share FROM (SELECT subject_id, domain, sum(dwell) AS d FROM e GROUP BY ALL)) GROUP BY 1)"""
named("insights", _of(lambda e: surfaces.insights(profile.signature(e), profile.domain_share(e)).select("subject_id", "top_domain", "top_percent", F.array_join("titles", ", ").alias("titles"))),
      f"""{_SIG} SELECT subject_id, top_domain, CAST(round(top_share * 100) AS INTEGER) AS top_percent, 'Primary focus, ' || CASE WHEN revisit_rate >= 0.2 THEN 'Repeated pull' ELSE 'Low revisit pattern' END || ', ' || CASE WHEN kl >= 0.2 THEN 'Baseline shift' ELSE 'Stable rhythm' END || CASE WHEN owned > 0 THEN ', Inferred responsibility' ELSE '' END AS titles
      FROM tp JOIN rv USING (subject_id) JOIN ow USING (subject_id) JOIN kl USING (subject_id)""")  # fmt: skip
named("signature_radar", _of(lambda e: surfaces.radar(profile.signature(e)).drop("depth")),
      f"{_SIG} SELECT subject_id, owned / 5 AS ownership, revisit_rate AS recurrence, round(least(coalesce(entropy, 0) / 3, 1.0), 4) AS switching, round(least(greatest(kl, 0.0), 1.0), 4) AS shift FROM rv JOIN ow USING (subject_id) JOIN kl USING (subject_id) LEFT JOIN en USING (subject_id)")


def _lines(spark, sf_dir: str) -> DataFrame:
    lines = F.transform(F.split("text", r"\n"), lambda t: F.struct(t.alias("text"), F.lit(0.5).alias("confidence")))
    s = surfaces.sanitized_lines(lines, redact_emails)
    return documents(spark, sf_dir).select("doc_id", s.alias("s")).select("doc_id", "s.status", F.array_join("s.hints", "|").alias("hints"), "s.summary", "s.confidence")


_MAIL = _REDACT["redact_email"][1].replace("text,", "x,", 1)
named("surface_lines", _lines,
      rf"""WITH c AS (SELECT doc_id, [substr(trim(regexp_replace(x, '\s+', ' ', 'g')), 1, 120) FOR x IN string_split(coalesce(text, ''), chr(10))[1:12]] AS t, text FROM documents),
      f AS (SELECT doc_id, [x FOR x IN t IF x <> ''] AS t FROM c), m AS (SELECT doc_id, t, [x FOR x IN [trim({_MAIL}) FOR x IN t] IF x <> ''] AS h FROM f),
      d AS (SELECT doc_id, t, ([x FOR x, i IN h IF list_position([lower(y) FOR y IN h], lower(x)) = i])[1:8] AS h FROM m), j AS (SELECT *, array_to_string(h[1:3], '; ') AS s FROM d)
      SELECT doc_id, CASE WHEN len(h) > 0 THEN 'captured' ELSE 'empty' END AS status, array_to_string(h, '|') AS hints, CASE WHEN length(s) > 260 THEN rtrim(substr(s, 1, 257)) || '...' ELSE s END AS summary, CASE WHEN len(t) > 0 THEN 0.5 ELSE 0.0 END AS confidence FROM j""")  # fmt: skip

# feedback and cards


def _cards(e: DataFrame) -> DataFrame:
    return learning.cards(_sphere_figures(e), _feedback(e))


_CARDS = f"{_PIVOT}, s AS ({_FIGURES}), c AS (SELECT s.*, {_STATUS} AS status, coalesce(useful, 0) AS u, coalesce(wrong, 0) AS wr, coalesce(stale, 0) AS st, coalesce(too_broad, 0) AS tb, coalesce(too_private, 0) AS tp, coalesce(missing_context, 0) AS mc FROM s LEFT JOIN v USING (sphere_id))"
named("learning_state", _of(lambda e: workflow.learning_state(_cards(e), _feedback(e))),
      f"""{_CARDS}, g AS (SELECT subject_id, count(*) AS context_cards, count(*) FILTER (status = 'validated') AS validated_cards, count(*) FILTER (status IN ('needs_evidence', 'privacy_review', 'stale', 'weak')) AS needs_review FROM c GROUP BY 1),
      h AS (SELECT subject_id, count(*) AS feedback_count, count(*) FILTER (label = 'useful') AS useful_count, count(*) FILTER (label <> 'useful') AS issue_count FROM f WHERE resolved_at IS NULL GROUP BY 1)
      SELECT subject_id, context_cards, validated_cards, needs_review, coalesce(feedback_count, 0) AS feedback_count, coalesce(useful_count, 0) AS useful_count, coalesce(issue_count, 0) AS issue_count, CASE WHEN coalesce(feedback_count, 0) > 0 THEN 'active' ELSE 'ready' END AS state FROM g LEFT JOIN h USING (subject_id)""")  # fmt: skip


def _when(table, none: str, holds: dict[str, str]) -> str:
    said = ", ".join(f"CASE WHEN {holds[k]} THEN '{text}' END" for k, text in table)
    return f"coalesce(nullif(array_to_string(([x FOR x IN [{said}] IF x IS NOT NULL])[1:4], ' / '), ''), '{none}')"


named("card_prompts", _of(lambda e: _cards(e).select("sphere_id", F.array_join(workflow.questions(F.lit(False)), " / ").alias("questions"), F.array_join(workflow.actions(F.col("status")), " / ").alias("actions"))),
      f"{_CARDS} SELECT sphere_id, {_when(workflow.QUESTIONS, workflow.NO_QUESTION, {'missing_context': 'mc > 0', 'wrong': 'wr > 0', 'too_broad': 'tb > 0', 'stale': 'st > 0', 'private': 'tp > 0'})} AS questions, "
      f"{_when(workflow.ACTIONS, workflow.NO_ACTION, {'useful': 'u > 0', 'grouping': 'wr > 0 OR tb > 0', 'missing_context': 'mc > 0', 'refresh': chr(39).join(['st > 0 OR status = ', 'aging', '']), 'too_private': 'tp > 0'})} AS actions FROM c")  # fmt: skip
named("newer_samples", _of(lambda e: workflow.newer_samples(_feedback(e).where("label = 'useful'").select("sphere_id", F.col("created_at").alias("observed_through"), "created_at", "id"), e.select(F.concat_ws("|", "subject_id", "domain").alias("sphere_id"), F.col("ts_start").alias("time")))),
      f"{_PIVOT}, c AS (SELECT sphere_id, arg_max(id, (created_at, id)) AS checkpoint_id, arg_max(created_at, (created_at, id)) AS observed_through FROM f WHERE label = 'useful' GROUP BY 1) SELECT c.*, count(*) FILTER (ts_start > observed_through) AS recent_samples_since FROM c JOIN e ON subject_id || '|' || domain = sphere_id GROUP BY ALL")

# masked totals


def _synthesized(e: DataFrame) -> DataFrame:
    totals = collective.secure_sum(collective.masked(collective.contributions(_declared(e)), b"cohort secret", "2024-W05"))
    size = overview.without_system(e).agg(F.countDistinct("subject_id").alias("cohort"))
    rows = totals.crossJoin(F.broadcast(size))  # one row
    return collective.synthesize(rows, F.col("cohort"), 3)


named("secure_themes", _of(_synthesized),
      f"""{_DECLARED}, c AS (SELECT count(DISTINCT subject_id) AS n FROM e WHERE domain <> 'system'), t AS (SELECT v.theme, count(DISTINCT subject_id) AS subjects FROM {_VOCABULARY} LEFT JOIN k ON k.theme = v.theme GROUP BY 1),
      x AS (SELECT theme, subjects, n AS cohort, subjects / n AS p, 1 + 1.96 * 1.96 / n AS d, count(*) FILTER (subjects < 3) OVER () AS below FROM t, c)
      SELECT theme, subjects, round(p, 3) AS share, round(greatest(0.0, (p + 1.96 * 1.96 / (2 * cohort)) / d - 1.96 / d * sqrt(p * (1 - p) / cohort + 1.96 * 1.96 / (4 * cohort * cohort))), 3) AS low, round(least(1.0, (p + 1.96 * 1.96 / (2 * cohort)) / d + 1.96 / d * sqrt(p * (1 - p) / cohort + 1.96 * 1.96 / (4 * cohort * cohort))), 3) AS high,
      CASE WHEN below = 0 THEN 'none' WHEN below <= 2 THEN '1-2' WHEN below <= 5 THEN '3-5' ELSE '6+' END AS withheld FROM x WHERE subjects >= 3 AND cohort >= 3""")  # fmt: skip
named("subjects_seen", _of(collective.subjects_seen), f"{_E} SELECT count(DISTINCT subject_id) AS subjects_seen FROM e WHERE trim(subject_id) <> ''")

# stored events

named("fetch_events", _of(lambda e: maintenance.fetch(e, since="2024-01-10 00:00:00", limit=50).select("id", "subject_id", "ts_start", "artifact")),
      f"{_E} SELECT id, subject_id, ts_start, artifact FROM e WHERE ts_start >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts_start, id LIMIT 50")
named("count_events", _of(maintenance.count), f"{_E} SELECT subject_id, count(*) AS events FROM e GROUP BY 1")
named("updated_texts", _of(lambda e: maintenance.updated(e, e.where("app = 'app1'").select("id", F.concat(F.lit("new "), "artifact").alias("artifact"), F.col("ts_end").alias("at"))).select("id", "artifact", "app")),
      f"{_E} SELECT id, CASE WHEN app = 'app1' THEN 'new ' || artifact ELSE artifact END AS artifact, app FROM e")
named("unrepeated_events", _of(lambda e: maintenance.without_repeats(e.union(e)).select("id", "subject_id", "app")), f"{_E} SELECT id, subject_id, app FROM e")
named("redact_dry_run", lambda s, d: maintenance.dry_run(documents(s, d).select("doc_id", "text"), columns=("text",)))
named("parsed_times", _of(lambda e: e.select("id", maintenance.parse_time(F.concat(F.date_format("ts_start", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).cast("timestamp_ntz").alias("at"))), f"{_E} SELECT id, date_trunc('second', ts_start) AS at FROM e")

# connectors: payloads made from the events' artifacts

_NOTES = connectors.load([
    {"id": "notes", "apps": ["app1", "app2"], "min_depth": 1, "sources": ["window_title", "browser_tab"], "fields": [
        {"name": "topic", "store": "token", "from": "title", "tokens": ["cedar", "ledger", "invoice"]}, {"name": "number", "store": "count", "from": "title"}, {"name": "site", "store": "domain", "from": "url_domain"},
    ], "graph": {"node_type": "topic", "label_field": "topic", "context_fields": ["site"]}},
    {"id": "board", "apps": ["app3"], "min_depth": 1, "sources": ["window_title"], "fields": [{"name": "item", "store": "redacted", "pattern": r"artifact (?P<value>\d+)"}]},
])


def _connected(e: DataFrame) -> DataFrame:
    title = connectors.payload(title=F.col("artifact"))
    tab = F.when(F.col("domain") == "coding", connectors.payload(title=F.col("artifact"), url_domain=F.lit("Docs.Example.com:443/path")))
    return connectors.apply_each(e, {"window_title": title, "browser_tab": tab}, 2, _NOTES)


_WORD = "CASE WHEN contains(artifact, 'cedar') THEN 'cedar' WHEN contains(artifact, 'ledger') THEN 'ledger' WHEN contains(artifact, 'invoice') THEN 'invoice' END"
_CONNECTED = rf"""{_E}, n AS (SELECT id, app, domain, artifact, CASE WHEN app IN ('app1', 'app2') THEN 'notes' WHEN app = 'app3' THEN 'board' END AS connector, {_WORD} AS topic, regexp_extract(artifact, '(\d+)', 1) AS number FROM e)"""
named("connector_fields", _of(lambda e: _connected(e).where("structured is not null").select("id", "structured.connector", "structured.status", F.col("structured.fields")["topic"].alias("topic"), F.col("structured.fields")["number"].alias("number"), F.col("structured.fields")["site"].alias("site"), F.col("structured.fields")["item"].alias("item"), "structured.confidence", F.array_join("structured.missing_fields", ",").alias("missing"))),
      f"""{_CONNECTED} SELECT id, connector, 'captured' AS status, CASE connector WHEN 'notes' THEN topic END AS topic, CASE connector WHEN 'notes' THEN number END AS number, CASE WHEN connector = 'notes' AND domain = 'coding' THEN 'docs.example.com' END AS site, CASE connector WHEN 'board' THEN number END AS item,
      round(CASE WHEN connector = 'board' THEN 0.72 ELSE (CASE WHEN topic IS NULL THEN 0 ELSE 0.72 END + 0.72 + CASE WHEN domain = 'coding' THEN 0.88 ELSE 0 END) / (1 + CAST(topic IS NOT NULL AS INTEGER) + CAST(domain = 'coding' AS INTEGER)) END, 3) AS confidence,
      CASE WHEN connector = 'board' THEN '' ELSE array_to_string([x FOR x IN [CASE WHEN domain <> 'coding' THEN 'site' END, CASE WHEN topic IS NULL THEN 'topic' END] IF x IS NOT NULL], ',') END AS missing FROM n WHERE connector IS NOT NULL""")  # fmt: skip
named("connector_activity", _of(lambda e: connectors.activity(_connected(e)).select("connector", "events")), f"{_CONNECTED} SELECT connector, count(*) AS events FROM n WHERE connector IS NOT NULL GROUP BY 1")
named("connector_provenance", _of(lambda e: connectors.provenance_counts(_connected(e))),
      f"""{_CONNECTED}, p AS (SELECT connector, unnest(CASE connector WHEN 'board' THEN [('item', 'window_title')] ELSE [CASE WHEN topic IS NOT NULL THEN ('topic', 'window_title') END, ('number', 'window_title'), CASE WHEN domain = 'coding' THEN ('site', 'browser_tab') END] END) AS x FROM n WHERE connector IS NOT NULL)
      SELECT connector, x[1] AS field, x[2] AS source, count(*) AS n FROM p WHERE x IS NOT NULL GROUP BY ALL""")  # fmt: skip
named("retrieve_reasons", _of(lambda e: retrieve.retrieve(e, "workflow cedar", filters=["sequential"], why=True).select("subject_id", "rank", F.array_join("why", "; ").alias("why"))))
named("retrieve_by_cues", _of(lambda e: retrieve.retrieve(e, "what changed after the budget")))
named("normalized_titles", _of(lambda e: e.select("id", normalize_artifact(F.concat(F.lit("[draft] https://x.y/z "), "artifact")).alias("norm"))), f"{_E} SELECT id, artifact AS norm FROM e")

# rolling profiles, privacy payload and overview

_DAYS = f"""{_E}, d AS (SELECT subject_id, CAST(ts_start AS DATE) AS day, domain, sum(dwell) AS dw, count(*) AS n FROM e GROUP BY 1, 2, 3), a AS (SELECT DISTINCT subject_id, day FROM d),
g AS (SELECT a.subject_id, a.day, b.domain, coalesce(dw, 0) AS dw, coalesce(n, 0) AS n FROM a JOIN (SELECT DISTINCT subject_id, domain FROM d) b ON b.subject_id = a.subject_id LEFT JOIN d ON d.subject_id = a.subject_id AND d.day = a.day AND d.domain = b.domain),
w AS (SELECT subject_id, day, domain, sum(dw) OVER s AS ds, sum(n) OVER s AS ns, sum(dw) OVER l AS dl, sum(n) OVER l AS nl FROM g
  WINDOW s AS (PARTITION BY subject_id, domain ORDER BY day RANGE BETWEEN INTERVAL 4 DAYS PRECEDING AND CURRENT ROW), l AS (PARTITION BY subject_id, domain ORDER BY day RANGE BETWEEN INTERVAL 13 DAYS PRECEDING AND CURRENT ROW)),
x AS (SELECT *, CASE WHEN ns > 0 THEN round(coalesce(CAST(ds AS DOUBLE) / nullif(CAST(sum(ds) OVER q AS DOUBLE), 0), 0), 4) END AS short, round(coalesce(CAST(dl AS DOUBLE) / nullif(CAST(sum(dl) OVER q AS DOUBLE), 0), 0), 4) AS long FROM w WHERE nl > 0 WINDOW q AS (PARTITION BY subject_id, day)),
f AS (SELECT subject_id, day, CAST(sum(nl) AS BIGINT) AS events, round(CAST(sum(dl) AS DOUBLE) / sum(nl) + 1e-9, 2) AS mean_dwell, round(sum(coalesce(short, 1e-6) * ln((coalesce(short, 1e-6) + 1e-6) / (long + 1e-6))), 4) + 0.0 AS kl,
  coalesce(array_to_string(list(domain ORDER BY long DESC, domain) FILTER (long >= 0.15)[1:5], ','), '') AS owned_domains FROM x GROUP BY 1, 2),
t AS (SELECT subject_id, day, s AS source, domain AS target, count(*) AS c FROM (SELECT subject_id, CAST(ts_start AS DATE) AS day, domain, lag(domain) OVER (PARTITION BY subject_id ORDER BY ts_start, id) AS s FROM e) WHERE s IS NOT NULL AND s <> domain GROUP BY ALL),
m AS (SELECT a.subject_id, a.day, (SELECT -sum(p * log2(p)) FROM (SELECT sum(c) / sum(sum(c)) OVER () AS p FROM t WHERE t.subject_id = a.subject_id AND t.day BETWEEN a.day - 13 AND a.day GROUP BY source, target)) AS h FROM a)
SELECT f.*, coalesce(round(h, 4), 0) + 0.0 AS entropy FROM f JOIN m ON m.subject_id = f.subject_id AND m.day = f.day"""
named("rolling_profile", _of(profile.rolling), _DAYS)
_flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
named("privacy_payload", _of(lambda e: summary.privacy(_observed(e).withColumn("structured", F.col("structured").withField("connector", F.col("domain")))).select(
        "subject_id", "events_all_time", "events_in_window", "expired_events", "oldest_event", _flat("redaction_summary").alias("redaction_summary"), _flat("connector_activity").alias("connector_activity"), "retention_days", F.array_join("captured", "; ").alias("captured"))),
      f"""{_E}, x AS (SELECT *, ts_start >= {_CUT} - INTERVAL 14 DAYS AS shown FROM e), k AS (SELECT subject_id, 'email' AS key, 2 * count(*) AS n FROM x WHERE shown AND id % 7 = 0 GROUP BY 1 UNION ALL SELECT subject_id, 'secret', count(*) FROM x WHERE shown AND id % 13 = 0 GROUP BY 1 UNION ALL SELECT subject_id, 'phone', count(*) FROM x WHERE shown AND id % 17 = 0 GROUP BY 1),
      r AS (SELECT subject_id, string_agg(key || ':' || n, ',' ORDER BY key) AS r FROM k GROUP BY 1), c AS (SELECT subject_id, string_agg(domain || ':' || n, ',' ORDER BY domain) AS c FROM (SELECT subject_id, domain, count(*) AS n FROM x WHERE shown AND id % 3 = 0 GROUP BY 1, 2) GROUP BY 1)
      SELECT x.subject_id, count(*) AS events_all_time, count(*) FILTER (shown) AS events_in_window, count(*) FILTER (ts_start < {_CUT} - INTERVAL 30 DAYS) AS expired_events, min(ts_start) AS oldest_event, coalesce(any_value(r), '') AS redaction_summary, coalesce(any_value(c), '') AS connector_activity, 30 AS retention_days, '{"; ".join(summary.CAPTURED)}' AS captured
      FROM x LEFT JOIN r USING (subject_id) LEFT JOIN c USING (subject_id) GROUP BY 1""")  # fmt: skip


def _figures(e: DataFrame) -> DataFrame:
    figures, _ = summary.overview_parts(e)
    return e.sparkSession.createDataFrame([figures], "events_all_time long, expired_events long, oldest_event timestamp_ntz, events_in_window long, dwell double, first_event timestamp_ntz, last_event timestamp_ntz")


named("overview_figures", _of(_figures),
      f"""{_E} SELECT count(*) AS events_all_time, count(*) FILTER (ts_start < {_CUT} - INTERVAL 30 DAYS) AS expired_events, min(ts_start) AS oldest_event, count(*) FILTER (shown) AS events_in_window, CAST(sum(dwell) FILTER (shown) AS DOUBLE) AS dwell, min(ts_start) FILTER (shown) AS first_event, max(ts_start) FILTER (shown) AS last_event
      FROM (SELECT *, ts_start >= {_CUT} - INTERVAL 14 DAYS AS shown FROM e)""")  # fmt: skip
named("overview_domains", _of(lambda e: summary.overview_parts(e)[1]["domains"]),
      f"""{_E}, a AS (SELECT domain, app, sum(dwell) AS d, count(*) AS n FROM e WHERE ts_start >= {_CUT} - INTERVAL 14 DAYS GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY d DESC, app) AS k FROM a),
      g AS (SELECT domain, sum(d) AS dwell, sum(n) AS events, string_agg(app, ',' ORDER BY k) FILTER (k <= 4) AS top_apps FROM k GROUP BY domain)
      SELECT domain, round(CAST(dwell AS DOUBLE), 2) AS dwell, events, round(CAST(dwell AS DOUBLE) / (SELECT CAST(sum(dwell) AS DOUBLE) FROM g), 4) AS share, top_apps FROM g""")  # fmt: skip
