"""The registered queries over the analytics operators, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from focusloom import config
from focusloom.functions import text as T
from focusloom.operators import collective, graph, learning, overview, profile, resume, retrieve, spheres
from focusloom.schema import AS_OF, EVENTS_SQL, as_of_column, events
from focusloom.sources.tables import documents, pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_E = f"WITH e AS ({EVENTS_SQL})"
_CUT = "TIMESTAMP '2024-01-31 00:00:00'"
_GAP = 24 * 60  # minutes; the test events are hours apart


def _of(build: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: build(events(spark, sf_dir))


def named(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql:
        SQL[name] = sql


# scans

named("window_scan", _of(lambda e: overview.window_scan(e, 14).select("id", "subject_id", "app", "artifact", "domain", "action", "ts_start", "ts_end", F.col("dwell").cast("double").alias("dwell"))),
      f"{_E} SELECT id, subject_id, app, artifact, domain, action, ts_start, ts_end, CAST(dwell AS DOUBLE) AS dwell FROM e WHERE ts_start IS NULL OR ts_start >= {_CUT} - INTERVAL 14 DAYS")
named("retention_split", _of(lambda e: overview.retention_split(e, 20)),
      f"{_E} SELECT subject_id, count(*) FILTER (ts_start < {_CUT} - INTERVAL 20 DAYS) AS expired, count(*) FILTER (NOT ts_start < {_CUT} - INTERVAL 20 DAYS) AS kept, min(ts_start) AS oldest FROM e GROUP BY subject_id")
named("retention_survivors", _of(lambda e: e.where(F.col("ts_start") >= F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 20 days")).select("id", "subject_id")),
      f"{_E} SELECT id, subject_id FROM e WHERE ts_start >= {_CUT} - INTERVAL 20 DAYS")
named("system_exclusion", _of(lambda e: overview.without_system(e).groupBy("domain").agg(F.count(F.lit(1)).alias("events"))),
      f"{_E} SELECT domain, count(*) AS events FROM e WHERE domain <> 'system' AND action <> 'system' GROUP BY domain")

# overview

named("domain_share", _of(profile.domain_share),
      f"{_E} SELECT subject_id, domain, CAST(d AS DOUBLE) AS dwell, round(CAST(d AS DOUBLE) / CAST(sum(d) OVER (PARTITION BY subject_id) AS DOUBLE), 4) AS share FROM (SELECT subject_id, domain, sum(dwell) AS d FROM e GROUP BY ALL)")
named("daily_activity", _of(overview.daily_activity),
      f"{_E} SELECT CAST(ts_start AS DATE) AS day, count(*) AS events, CAST(sum(dwell) AS DOUBLE) AS dwell, round(CAST(sum(dwell) AS DOUBLE) / 3600, 2) AS hours FROM e GROUP BY 1")
named("hourly_heatmap", _of(overview.hourly_heatmap),
      f"{_E}, s AS (SELECT hour(ts_start) AS hour, CAST(sum(dwell) AS DOUBLE) AS d FROM e GROUP BY 1) SELECT CAST(r.range AS INTEGER) AS hour, coalesce(d, 0.0) AS dwell, round(coalesce(d, 0.0) / greatest(max(coalesce(d, 0.0)) OVER (), 1e-9), 4) AS intensity FROM range(24) r LEFT JOIN s ON s.hour = r.range")
named("domain_summary", _of(overview.domain_summary),
      f"""{_E}, a AS (SELECT domain, app, sum(dwell) AS d, count(*) AS n FROM e GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY d DESC, app) AS k FROM a),
      g AS (SELECT domain, sum(d) AS dwell, sum(n) AS events, string_agg(app, ',' ORDER BY k) FILTER (k <= 4) AS top_apps FROM k GROUP BY domain)
      SELECT domain, round(CAST(dwell AS DOUBLE), 2) AS dwell, events, round(CAST(dwell AS DOUBLE) / (SELECT CAST(sum(dwell) AS DOUBLE) FROM g), 4) AS share, top_apps FROM g""")  # fmt: skip
for _key in ("app", "artifact"):
    named(f"top_items_{_key}", _of(lambda e, k=_key: overview.top_items(e, k)),
          f"{_E} SELECT {_key} AS item, CAST(sum(dwell) AS DOUBLE) AS dwell, count(*) AS events, arg_min(domain, (ts_start, id)) AS domain FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
named("artifact_stats", _of(lambda e: overview.artifact_stats(e).drop("first_ord")),
      f"{_E} SELECT subject_id, CASE WHEN coalesce(artifact, '') = '' THEN app ELSE artifact END AS artifact, arg_min(domain, (ts_start, id)) AS domain, arg_min(app, (ts_start, id)) AS app, CAST(sum(dwell) AS DOUBLE) AS dwell, count(*) AS visits, min(ts_start) AS first_seen, arg_max(ts_end, (ts_start, id)) AS last_seen FROM e GROUP BY 1, 2")

# profiles

_TRANS = "t AS (SELECT subject_id, p AS source, domain AS target, count(*) AS n FROM (SELECT subject_id, domain, lag(domain) OVER (PARTITION BY subject_id ORDER BY ts_start, id) AS p FROM e) WHERE p IS NOT NULL AND p <> '' AND p <> domain GROUP BY ALL)"
named("transitions", _of(profile.transitions), f"{_E}, {_TRANS} SELECT * FROM t")
named("transition_entropy", _of(profile.transition_entropy), f"{_E}, {_TRANS} SELECT subject_id, round(-sum(p * log2(p)), 4) AS entropy FROM (SELECT subject_id, n / sum(n) OVER (PARTITION BY subject_id) AS p FROM t) GROUP BY 1")
named("revisit_rate", _of(profile.revisit_rate), f"{_E} SELECT subject_id, round(sum(CASE WHEN n > 1 THEN n - 1 ELSE 0 END) / sum(n), 4) AS revisit_rate, sum(n) AS events FROM (SELECT subject_id, artifact, count(*) AS n FROM e GROUP BY ALL) GROUP BY 1")
named("hour_histogram", _of(profile.hour_histogram), f"{_E} SELECT subject_id, hour(ts_start) AS hour, count(*) AS events FROM e GROUP BY ALL")


def _windows_sql(short: int, long: int) -> str:
    return f"""a AS (SELECT subject_id, max(ts_start) AS anchor FROM e GROUP BY 1), r AS (SELECT e.*, anchor FROM e JOIN a USING (subject_id) WHERE ts_start >= anchor - INTERVAL {long} DAYS),
    s AS (SELECT subject_id, domain, CAST(sum(dwell) FILTER (ts_start >= anchor - INTERVAL {short} DAYS) AS DOUBLE) AS s, CAST(sum(dwell) AS DOUBLE) AS l FROM r GROUP BY ALL),
    w AS (SELECT subject_id, domain, round(s / sum(s) OVER (PARTITION BY subject_id), 4) AS short, round(l / sum(l) OVER (PARTITION BY subject_id), 4) AS long FROM s)"""


_KL = "round(sum(coalesce(short, 1e-6) * ln((coalesce(short, 1e-6) + 1e-6) / (coalesce(long, 1e-6) + 1e-6))), 4)"
named("signature_kl", _of(lambda e: profile.divergence(profile.windows(e, 5, 14))), f"{_E}, {_windows_sql(5, 14)} SELECT subject_id, {_KL} AS kl FROM w GROUP BY 1")
named("domain_delta", _of(lambda e: profile.domain_delta(profile.windows(e, 5, 14))), f"{_E}, {_windows_sql(5, 14)} SELECT subject_id, domain, round(coalesce(short, 0) - coalesce(long, 0), 4) AS delta FROM w")
_TRANS_R = _TRANS.replace("FROM e)", "FROM r)")
named("signature", _of(profile.signature),
      f"""{_E}, {_windows_sql(5, 14)}, {_TRANS_R},
      en AS (SELECT subject_id, round(-sum(p * log2(p)), 4) AS entropy FROM (SELECT subject_id, n / sum(n) OVER (PARTITION BY subject_id) AS p FROM t) GROUP BY 1),
      rv AS (SELECT subject_id, round(sum(CASE WHEN n > 1 THEN n - 1 ELSE 0 END) / sum(n), 4) AS revisit_rate FROM (SELECT subject_id, artifact, count(*) AS n FROM r GROUP BY ALL) GROUP BY 1),
      ow AS (SELECT subject_id, string_agg(domain, ',' ORDER BY k) AS owned_domains FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY long DESC, domain) AS k FROM w WHERE long >= 0.15) WHERE k <= 5 GROUP BY 1),
      rh AS (SELECT subject_id, count(*) AS events, round(CAST(avg(dwell) AS DECIMAL(18,9)), 2)::DOUBLE AS mean_dwell, round(CAST(median(CAST(dwell AS DOUBLE)) AS DECIMAL(18,9)), 2)::DOUBLE AS median_dwell FROM r GROUP BY 1),
      kl AS (SELECT subject_id, {_KL} AS kl FROM w GROUP BY 1)
      SELECT subject_id, events, mean_dwell, median_dwell, revisit_rate, coalesce(entropy, 0.0) AS entropy, kl, coalesce(owned_domains, '') AS owned_domains
      FROM rh JOIN rv USING (subject_id) JOIN kl USING (subject_id) LEFT JOIN en USING (subject_id) LEFT JOIN ow USING (subject_id)""")  # fmt: skip

# retrieval

_ASKED = {
    "proportional": "gateway invoice", "recurrent": "gateway repeat", "differential": "what changed in render", "inverse": "ignored ledger", "comparative": "compare cedar",
    "sequential": "workflow juniper", "collective": "team budget",
}


def _retrieve_sql(name: str, asked: str) -> str:
    words = sorted({w for w in asked.split() if len(w) > 1})
    value = {
        "proportional": "d", "recurrent": "v", "differential": "greatest(round(recent - baseline, 4), 0.0) * d", "inverse": "greatest(baseline - recent, 0.0) * (0.5 + v / 2)",
        "comparative": "t", "sequential": "t * d", "collective": "d",
    }
    both = f"0.5 * ({value[name]}) + 0.5 * ({value['differential']})"
    attention = value[name] if name == "differential" else f"CASE WHEN kl > 0.2 THEN {both} ELSE {value[name]} END"
    asked_list = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    return f"""{_E}, {_windows_sql(5, 14)},
    kl AS (SELECT subject_id, {_KL} AS kl FROM w GROUP BY 1),
    st AS (SELECT subject_id, artifact, arg_min(domain, (ts_start, id)) AS domain, arg_min(app, (ts_start, id)) AS app, CAST(sum(dwell) AS DOUBLE) AS dwell, count(*) AS visits, min((ts_start, id)) AS f FROM e GROUP BY 1, 2),
    pr AS (SELECT subject_id, artifact, lag(artifact) OVER (PARTITION BY subject_id ORDER BY ts_start, id) AS p FROM e),
    mv AS (SELECT subject_id, a AS artifact, count(*) AS trans FROM (SELECT subject_id, unnest([p, artifact]) AS a FROM pr WHERE p IS NOT NULL AND p <> artifact) GROUP BY ALL),
    n AS (SELECT st.*, dwell / coalesce(nullif(max(dwell) OVER q, 0), 1) AS d, visits / coalesce(nullif(max(visits) OVER q, 0), 1) AS v, coalesce(trans, 0) / coalesce(nullif(max(coalesce(trans, 0)) OVER q, 0), 1) AS t,
          coalesce(short, 0.0) AS recent, coalesce(long, 0.0) AS baseline, coalesce(kl, 0.0) AS kl
          FROM st LEFT JOIN mv USING (subject_id, artifact) LEFT JOIN w USING (subject_id, domain) LEFT JOIN kl USING (subject_id) WINDOW q AS (PARTITION BY st.subject_id)),
    tk AS (SELECT *, list_distinct([lower(x) FOR x IN regexp_extract_all(artifact || ' ' || app || ' ' || domain, '[a-zA-Z0-9][a-zA-Z0-9._-]+')]) AS toks, {attention} AS attention FROM n),
    sc AS (SELECT *, least(1.0, 0.15 + 0.2 * len(list_intersect({asked_list}, toks)) + 0.08 * len([x FOR x IN {asked_list} IF len([y FOR y IN toks IF contains(y, x)]) > 0])) AS content FROM tk),
    rk AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY round(attention * content, 9) DESC, ln(1 + dwell) DESC, f) AS rank FROM sc WHERE attention * content > 0)
    SELECT subject_id, rank, artifact, round(round(attention, 9), 4) AS attention_score, round(round(content, 9), 4) AS content_score, round(round(attention * content, 9), 4) AS weight FROM rk WHERE rank <= 5"""


for _name, _text in _ASKED.items():
    named(f"retrieve_{_name}", _of(lambda e, q=_text, n=_name: retrieve.retrieve(e, q, filters=[n])), _retrieve_sql(_name, _text))

# graph

_GTASK = "CASE WHEN contains(lower(artifact), 'pull request') THEN 'review code changes' WHEN contains(lower(artifact), 'issue') OR contains(lower(artifact), 'ticket') THEN 'track implementation work' ELSE CASE domain WHEN 'browser-research' THEN 'research and source review' WHEN 'coding' THEN 'build, debug, or review code' WHEN 'communication' THEN 'communicate and follow up' WHEN 'planning' THEN 'plan and coordinate work' WHEN 'system' THEN 'system state' ELSE 'unclassified work' END END"


def _observed(e: DataFrame) -> DataFrame:
    """Events of which some had private text taken out and some were read by a connector."""
    found = F.create_map(F.lit("email"), F.when(F.col("id") % 7 == 0, 2).otherwise(0), F.lit("secret"), F.when(F.col("id") % 13 == 0, 1).otherwise(0), F.lit("phone"), F.when(F.col("id") % 17 == 0, 1).otherwise(0))
    read = F.struct(F.when(F.col("id") % 3 == 0, "captured").otherwise("empty").alias("status"), F.create_map(F.lit("window"), F.col("app")).alias("fields"))
    return e.withColumn("findings", found).withColumn("structured", read)


_G = f"""{_E}, p AS (SELECT *, {_GTASK} AS task, strftime(date_trunc('hour', ts_start), '%Y-%m-%d %H:00') AS "time", lag(domain) OVER q AS pd, lag(artifact) OVER q AS pa, id % 7 = 0 OR id % 13 = 0 OR id % 17 = 0 AS priv
  FROM e WHERE domain <> 'system' AND action <> 'system' WINDOW q AS (PARTITION BY subject_id ORDER BY ts_start, id)),
nn AS (
  SELECT subject_id, ts_start, id, t.pos, dwell, 1 AS w, t.type, t.label, CASE WHEN t.type = 'subject' THEN 'generalized' WHEN t.type = 'artifact' AND priv THEN 'masked' ELSE 'allowed' END AS gate, CASE WHEN t.type = 'artifact' AND priv THEN 'medium' ELSE 'low' END AS sens
  FROM p, LATERAL (VALUES (0, 'subject', 'you'), (1, 'app', app), (2, 'domain', domain), (3, 'artifact', artifact), (4, 'task', task), (5, 'time', "time")) t(pos, type, label)
  UNION ALL SELECT subject_id, ts_start, id, 6, 0, 1, 'connector-field', 'window: ' || app, 'allowed', 'low' FROM p WHERE id % 3 = 0
  UNION ALL SELECT subject_id, ts_start, id, 7, 0, 2, 'private-signal', 'masked identity/contact', 'masked', 'high' FROM p WHERE id % 7 = 0
  UNION ALL SELECT subject_id, ts_start, id, 8, 0, 1, 'private-signal', 'blocked secret/token', 'masked', 'high' FROM p WHERE id % 13 = 0
  UNION ALL SELECT subject_id, ts_start, id, 9, 0, 1, 'private-signal', 'masked identity/contact', 'masked', 'high' FROM p WHERE id % 17 = 0),
nodes AS (SELECT subject_id, type, lower(label) AS key, arg_min(label, (ts_start, id, pos)) AS label, CAST(sum(w) AS BIGINT) AS events, CAST(sum(dwell) AS DOUBLE) AS d, min((ts_start, id, pos)) AS f,
  coalesce(arg_min(gate, (ts_start, id, pos)) FILTER (gate <> 'allowed'), 'allowed') AS gate_mode, coalesce(arg_min(sens, (ts_start, id, pos)) FILTER (gate <> 'allowed'), 'low') AS sensitivity FROM nn GROUP BY 1, 2, 3),
scored AS (SELECT subject_id, type || ':' || substr(sha1(type || ':' || key), 1, 12) AS node_id, type, label, events, round(d, 2) AS dwell, gate_mode, sensitivity, f,
  d + 5.0 * events + 120.0 * CASE type WHEN 'subject' THEN 10 WHEN 'domain' THEN 8 WHEN 'task' THEN 7 WHEN 'artifact' THEN 6 WHEN 'app' THEN 5 WHEN 'time' THEN 4 ELSE 3 END AS score FROM nodes),
ranked AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY type <> 'subject', score DESC, f) AS rank FROM scored),
top AS (SELECT * FROM ranked WHERE rank <= 70),
ee AS (
  SELECT subject_id, ts_start, id, dwell, t.* FROM p, LATERAL (VALUES (0, 'focused_in', 'subject:you', 'domain:' || domain, 'allowed'), (1, 'worked_through', 'domain:' || domain, 'app:' || app, 'allowed'),
    (2, 'opened', 'app:' || app, 'artifact:' || artifact, CASE WHEN priv THEN 'masked' ELSE 'allowed' END), (3, 'suggests_task', 'artifact:' || artifact, 'task:' || task, CASE WHEN priv THEN 'masked' ELSE 'allowed' END), (4, 'observed', 'time:' || "time", 'domain:' || domain, 'allowed'),
    (5, 'transitioned_to', 'domain:' || pd, 'domain:' || domain, 'allowed'), (6, 'next_context', 'artifact:' || pa, 'artifact:' || artifact, 'allowed')) t(pos, relation, a, b, gate) WHERE t.a IS NOT NULL
  UNION ALL SELECT subject_id, ts_start, id, 0, 7, 'described_by', 'artifact:' || artifact, 'connector-field:window: ' || app, 'allowed' FROM p WHERE id % 3 = 0
  UNION ALL SELECT subject_id, ts_start, id, 0, 8, 'redacted_from', 'artifact:' || artifact, 'private-signal:masked identity/contact', 'masked' FROM p WHERE id % 7 = 0
  UNION ALL SELECT subject_id, ts_start, id, 0, 9, 'redacted_from', 'artifact:' || artifact, 'private-signal:blocked secret/token', 'masked' FROM p WHERE id % 13 = 0
  UNION ALL SELECT subject_id, ts_start, id, 0, 10, 'redacted_from', 'artifact:' || artifact, 'private-signal:masked identity/contact', 'masked' FROM p WHERE id % 17 = 0),
joined AS (SELECT subject_id, split_part(a, ':', 1) || ':' || substr(sha1(lower(a)), 1, 12) AS source, relation, split_part(b, ':', 1) || ':' || substr(sha1(lower(b)), 1, 12) AS target, count(*) AS events, CAST(sum(dwell) AS DOUBLE) AS d, min((ts_start, id, pos)) AS f,
  coalesce(min(gate) FILTER (gate <> 'allowed'), 'allowed') AS gate_mode FROM ee WHERE lower(a) <> lower(b) GROUP BY 1, 2, 3, 4),
edges AS (SELECT j.*, s.label AS source_label, t.label AS target_label, j.d + 4.0 * j.events AS score, row_number() OVER (PARTITION BY j.subject_id ORDER BY j.d + 4.0 * j.events DESC, j.f) AS rank
  FROM joined j JOIN top s ON s.subject_id = j.subject_id AND s.node_id = j.source JOIN top t ON t.subject_id = j.subject_id AND t.node_id = j.target)"""
named("graph_nodes", _of(lambda e: graph.nodes(_observed(e))), f"{_G} SELECT * EXCLUDE (f) FROM top")
named("graph_edges", _of(lambda e: graph.edges(_observed(e))), f"{_G} SELECT subject_id, rank, source, relation, target, events, round(d, 2) AS dwell, gate_mode, score FROM edges WHERE rank <= 140")
named("graph_relationships", _of(lambda e: graph.relationships(_observed(e))), f"{_G} SELECT subject_id, rank, source_label, relation, target_label, events, round(d, 2) AS dwell, gate_mode FROM edges WHERE rank <= 14")
named("graph_gates", _of(lambda e: graph.gates(_observed(e))),
      f"{_G} SELECT subject_id, count(*) FILTER (rank <= 70 AND gate_mode = 'allowed') AS allowed, count(*) FILTER (rank <= 70 AND gate_mode = 'masked') AS masked, count(*) FILTER (rank <= 70 AND gate_mode = 'generalized') AS generalized, count(*) FILTER (rank > 70) AS withheld FROM ranked GROUP BY 1")

# runs and returns

_RUNS = f"""{_E}, c AS (SELECT *, coalesce(CAST(domain <> lag(domain) OVER q AS INTEGER), 1) AS ch FROM e WINDOW q AS (PARTITION BY subject_id ORDER BY ts_start, id)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY subject_id ORDER BY ts_start, id ROWS UNBOUNDED PRECEDING) AS island FROM c),
b AS (SELECT *, max(ts_end) OVER (PARTITION BY subject_id, island ORDER BY ts_start, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM i),
n AS (SELECT *, sum(CASE WHEN late IS NULL OR ts_start >= late + INTERVAL {_GAP} MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id ORDER BY ts_start, id ROWS UNBOUNDED PRECEDING) AS run FROM b),
runs AS (SELECT subject_id, run, first(domain) AS cluster, min(ts_start) AS run_start, max(ts_end) AS run_end, CAST(sum(dwell) AS DOUBLE) AS dwell, count(*) AS events FROM n GROUP BY 1, 2)"""


def _runs(e: DataFrame) -> DataFrame:
    return resume.runs(e, _GAP, F.col("domain"))


named("runs", _of(_runs), f"{_RUNS} SELECT * FROM runs")
# the scan as it is defined: run by run, and on from the run after a return
_SCAN = f"""{_RUNS.replace("WITH ", "WITH RECURSIVE ", 1)}, t AS (SELECT subject_id, run, cluster, dwell >= 10.0 AS real, epoch(run_start) AS s, epoch(run_end) AS f FROM runs),
p AS (SELECT i.subject_id, i.run, i.cluster, i.s, l.run AS left_run, l.cluster AS left_cluster, l.real AS left_real, l.f AS left_end, i.s - l.f >= {_GAP} * 60 AS long,
  (SELECT max(run) FROM t a WHERE a.subject_id = i.subject_id AND a.run < i.run AND a.real) AS anchor FROM t i JOIN t l ON l.subject_id = i.subject_id AND l.run = i.run - 1),
q AS (SELECT p.*, a.cluster AS task, (SELECT min(run) FROM t r WHERE r.subject_id = p.subject_id AND r.real AND r.cluster = CASE WHEN p.long THEN a.cluster ELSE p.left_cluster END AND r.run >= CASE WHEN p.long THEN p.run ELSE p.run + 1 END) AS back_run
  FROM p LEFT JOIN t a ON a.subject_id = p.subject_id AND a.run = p.anchor),
x AS (SELECT q.*, r.s AS back_at, CASE WHEN q.long THEN task IS NOT NULL AND r.run IS NOT NULL ELSE left_real AND q.cluster <> left_cluster AND r.s - q.s >= {_GAP} * 60 END AS hit FROM q LEFT JOIN t r ON r.subject_id = q.subject_id AND r.run = q.back_run),
scan AS (SELECT subject_id, 2::HUGEINT AS run FROM (SELECT DISTINCT subject_id FROM t)
  UNION ALL SELECT x.subject_id, CASE WHEN coalesce(hit, false) THEN back_run + 1 ELSE x.run + 1 END FROM scan JOIN x ON x.subject_id = scan.subject_id AND x.run = scan.run)"""
named("resume_events", _of(lambda e: resume.resume_events(_runs(e), _GAP, 10.0).withColumns({c: F.round(c, 3) for c in ("resume_seconds", "gap_seconds")})),
      f"{_SCAN} SELECT x.subject_id, left_run, back_run, CASE WHEN long THEN task ELSE left_cluster END AS cluster, round(back_at - s, 3) AS resume_seconds, round(CASE WHEN long THEN s - left_end ELSE back_at - left_end END, 3) AS gap_seconds FROM scan JOIN x ON x.subject_id = scan.subject_id AND x.run = scan.run WHERE hit")
named("resume_distribution", _of(lambda e: resume.distribution(_runs(e), "dwell", "cluster")),
      f"""{_RUNS}, v AS (SELECT cluster, list_sort(list(dwell)) AS v FROM runs GROUP BY 1), z AS (SELECT cluster, v, len(v) AS n FROM v)
      SELECT cluster, n, (v[CAST(floor((n - 1) / 2) AS INTEGER) + 1] + v[CAST(ceil((n - 1) / 2) AS INTEGER) + 1]) / 2 AS median, v[CAST(round_even(0.25 * (n - 1), 0) AS INTEGER) + 1] AS p25, v[CAST(round_even(0.75 * (n - 1), 0) AS INTEGER) + 1] AS p75, v[CAST(round_even(0.9 * (n - 1), 0) AS INTEGER) + 1] AS p90, v[1] AS least, v[n] AS most FROM z""")  # fmt: skip
named("sphere_assignments", _of(spheres.assign))
named("sphere_segments", _of(lambda e: spheres.segments(e, spheres.assign(e), 24 * 60)))
named("spheres", _of(lambda e: spheres.report(e, spheres.assigned_once(e)).drop("top_artifact", "last_seen")))

# text

named("classify_domain", lambda s, d: documents(s, d).select("doc_id", T.classify_domain(F.lit("none"), F.col("text")).alias("domain"), T.is_ignored(F.col("source")).alias("ignored")),
      """SELECT doc_id, CASE WHEN t LIKE '%github%' OR t LIKE '%pull request%' OR t LIKE '%issue%' OR t LIKE '%repo%' OR t LIKE '%localhost%' THEN 'coding'
      WHEN t LIKE '%gmail%' OR t LIKE '%inbox%' OR t LIKE '%email%' OR t LIKE '%calendar invite%' THEN 'communication'
      WHEN t LIKE '%docs.google%' OR t LIKE '%.docx%' OR t LIKE '%.pdf%' OR t LIKE '%proposal%' OR t LIKE '%brief%' THEN 'documents'
      WHEN t LIKE '%arxiv%' OR t LIKE '%docs%' OR t LIKE '%stackoverflow%' OR t LIKE '%search%' OR t LIKE '%wikipedia%' THEN 'browser-research'
      WHEN t LIKE '%roadmap%' OR t LIKE '%kanban%' OR t LIKE '%todo%' OR t LIKE '%meeting%' OR t LIKE '%spec%' THEN 'planning'
      WHEN t LIKE '%spreadsheet%' OR t LIKE '%.csv%' OR t LIKE '%dashboard%' OR t LIKE '%metrics%' THEN 'data' ELSE 'other' END AS domain, lower(source) IN ('loginwindow', 'screensaverengine') AS ignored
      FROM (SELECT *, lower('none ' || text) AS t FROM documents)""")  # fmt: skip
_KEYWORDS = " OR ".join(f"contains(lower(text), '{k}')" for k in ("password", "passcode", "otp", "2fa", "mfa", "bank", "card number", "secret", "private key", "recovery phrase"))
named("scrub_title", lambda s, d: documents(s, d).select("doc_id", T.scrub_title(F.col("text")).alias("title")),
      rf"SELECT doc_id, CASE WHEN {_KEYWORDS} THEN '[redacted sensitive title]' ELSE substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 240) END AS title FROM documents")
named("task_labels", _of(lambda e: e.select("id", T.graph_task(F.col("domain"), F.col("artifact"), F.col("artifact")).alias("graph_task"), T.sphere_task(F.col("domain"), F.col("artifact"), F.col("artifact")).alias("sphere_task"))),
      f"""{_E} SELECT id, {_GTASK} AS graph_task, CASE WHEN contains(artifact, 'roadmap') THEN 'plan roadmap' ELSE CASE domain WHEN 'browser-research' THEN 'research sources' WHEN 'coding' THEN 'build software' WHEN 'communication' THEN 'communicate' WHEN 'planning' THEN 'plan roadmap' WHEN 'system' THEN 'system state' END END AS sphere_task FROM e""")
named("gate_modes", lambda s, d: T.redact(documents(s, d).select("doc_id", "text"), "text").select("doc_id", T.gate_for_label(F.col("text"), F.lit(False))["mode"].alias("graph_gate"), T.gate_for_event(F.col("text"), F.lit(""), F.lit(False))["mode"].alias("sphere_gate")))
_REDACT = {
    "redact_email": (T.redact_emails, r"regexp_replace(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[email]', 'g')"),
    "redact_ip": (T.redact_ips, r"regexp_replace(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b', '[ip-address]', 'g')"),
    "redact_ssn": (T.redact_ssns, r"regexp_replace(text, '\b\d{3}-\d{2}-\d{4}\b', '[ssn]', 'g')"),
    "redact_secret": (T.redact_secrets, r"regexp_replace(text, '(?i)\b(?:sk-[a-z0-9_-]{16,}|gh[pousr]_[a-z0-9_-]{16,}|xox[baprs]-[a-z0-9_-]{16,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{20,})\b', '[secret]', 'g')"),
}
for _name, (_f, _sql) in _REDACT.items():
    named(_name, lambda s, d, f=_f: documents(s, d).select("doc_id", f(F.col("text")).alias("text")), f"SELECT doc_id, {_sql} AS text FROM documents")
named("redact_url", lambda s, d: pages(s, d).select("page_id", T.redact_urls(F.concat(F.lit("see "), F.col("url"), F.lit(" now"))).alias("text")),
      r"SELECT page_id, 'see ' || lower(regexp_extract(url, '(?i)^(https?)://', 1)) || '://' || lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)', 1)) || '/[redacted-path] now' AS text FROM pages")
named("redact_full", lambda s, d: T.redact(documents(s, d).select("doc_id", "text"), "text").select("doc_id", "text", F.to_json(F.col("findings")).alias("findings")))
named("redact_card", lambda s, d: documents(s, d).select("doc_id", T.redact_cards(F.col("text")).alias("text")))
named("redact_phone", lambda s, d: documents(s, d).select("doc_id", T.redact_phones(F.col("text")).alias("text")))
named("redaction_summary", lambda s, d: T.redact(documents(s, d).select("doc_id", "text"), "text").select(F.explode_outer("findings").alias("category", "n")).where("category is not null").groupBy("category").agg(F.sum("n").alias("n")))
_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\[[^\]]+\]', ' ', 'g'), 'https?://\S+', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
named("normalized_artifact", lambda s, d: documents(s, d).select("doc_id", T.normalize_artifact(F.col("text")).alias("norm")), f"SELECT doc_id, {_NORM} AS norm FROM documents")
_STOP = ", ".join(f"'{w}'" for w in config.SPHERE_STOPWORDS)
named("tokens", lambda s, d: documents(s, d).select("doc_id", F.array_join(T.sphere_tokens(F.col("text")), " ").alias("tokens"), F.size(T.query_tokens(F.col("text"))).alias("n_query_tokens")),
      rf"SELECT doc_id, array_to_string(([x FOR x IN string_split({_NORM}, ' ') IF length(x) >= 3 AND x NOT IN ({_STOP}) AND NOT regexp_full_match(x, '[0-9]+')])[1:24], ' ') AS tokens, len(list_distinct([lower(x) FOR x IN regexp_extract_all(text, '[a-zA-Z0-9][a-zA-Z0-9._-]+')])) AS n_query_tokens FROM documents")
named("stable_ids", _of(lambda e: e.select("id", T.stable_id("artifact", F.col("artifact")).alias("node_id"), T.subject_key(F.col("subject_id")).alias("subject_key"), T.time_bucket(F.col("ts_start")).alias("bucket"))),
      f"{_E} SELECT id, 'artifact:' || substr(sha1('artifact:' || lower(artifact)), 1, 12) AS node_id, 'subj_' || substr(sha256(subject_id), 1, 12) AS subject_key, strftime(date_trunc('hour', ts_start), '%Y-%m-%d %H:00') AS bucket FROM e")
named("url_sanitize", lambda s, d: pages(s, d).select("page_id", T.sanitize_url(F.col("url")).alias("u")).select("page_id", "u.*"),
      r"""SELECT page_id, lower(s) || '://' || h || CASE WHEN p <> '' THEN '/[redacted-path]' ELSE '' END AS url, lower(regexp_replace(h, ':\d*$', '')) AS url_domain, lower(s) AS url_scheme, CAST(p <> '' AS INTEGER) + CAST(q <> '' AS INTEGER) + CAST(f <> '' AS INTEGER) AS findings
      FROM (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+)://', 1) AS s, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS h, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '\?([^#]*)', 1) AS q, regexp_extract(url, '#(.*)$', 1) AS f FROM pages)""")  # fmt: skip
named("event_text_filter", _of(lambda e: e.where(F.lower(F.concat_ws(" ", "app", "artifact", "domain", "action")).contains("cedar")).select("id")), f"{_E} SELECT id FROM e WHERE contains(lower(app || ' ' || artifact || ' ' || domain || ' ' || action), 'cedar')")

# collective


def _work(e: DataFrame) -> DataFrame:
    """Work by theme key: domain and the artifact's words."""
    rows = overview.without_system(e)
    return rows.groupBy("subject_id", T.theme_key(F.col("domain"), F.col("artifact")).alias("theme")).agg(F.count(F.lit(1)).alias("events"), F.sum("dwell").cast("double").alias("dwell"))


def _declared(e: DataFrame) -> DataFrame:
    rows = overview.without_system(e)
    return rows.groupBy("subject_id", collective.theme_of(F.col("domain"), F.col("artifact")).alias("theme")).agg(F.count(F.lit(1)).alias("events"), F.sum("dwell").cast("double").alias("dwell"))


_KEYSQL = r"lower(domain) || ':' || array_to_string(list_sort(list_distinct([lower(x) FOR x IN regexp_extract_all(artifact, '[a-zA-Z][a-zA-Z0-9-]{2,}')]))[1:3], '-')"
_WORK = f"{_E}, k AS (SELECT subject_id, {_KEYSQL} AS theme, count(*) AS events, CAST(sum(dwell) AS DOUBLE) AS dwell FROM e WHERE domain <> 'system' AND action <> 'system' GROUP BY 1, 2)"
named("collective_themes", _of(lambda e: collective.themes(_work(e), 20)),
      f"{_WORK} SELECT theme, count(DISTINCT subject_id) AS subjects, sum(events) AS events, round(sum(dwell) / 3600, 2) AS hours, round(0.65 * least(1.0, count(DISTINCT subject_id) / 40) + 0.35 * least(1.0, sum(events) / 40), 3) AS confidence FROM k GROUP BY 1 HAVING count(DISTINCT subject_id) >= 20 ORDER BY subjects DESC, hours DESC, theme LIMIT 24")
named("themes_withheld", _of(lambda e: collective.withheld(_work(e), 20)),
      f"{_WORK} SELECT CASE WHEN n = 0 THEN 'none' WHEN n <= 2 THEN '1-2' WHEN n <= 5 THEN '3-5' ELSE '6+' END AS band FROM (SELECT count(*) FILTER (s < 20) AS n FROM (SELECT theme, count(DISTINCT subject_id) AS s FROM k GROUP BY 1))")
_DECLARED = f"{_E}, k AS (SELECT DISTINCT subject_id, CASE domain WHEN 'coding' THEN 'coding:implementation' WHEN 'communication' THEN 'communication:async' WHEN 'planning' THEN 'planning:coordination' END AS theme FROM e WHERE domain <> 'system')"


def _gated_spheres(e: DataFrame) -> DataFrame:
    """A sphere of each subject's artifact, of whose titles some were masked, hidden or sensitive: gates and sensitivities of all kinds."""
    shown = F.when(F.col("id") % 11 == 0, config.REDACTED_TITLE).when(F.col("id") % 7 == 0, F.concat(F.lit("[email] "), "artifact")).when(F.col("id") % 5 == 0, config.NO_TITLE).otherwise(F.col("artifact"))
    rows = overview.without_system(e).withColumn("gate", T.gate_for_event(shown, shown, F.lit(False)))
    by = rows.groupBy("subject_id", "domain", "artifact").agg(
        F.count(F.lit(1)).alias("events"), F.sum("dwell").cast("double").alias("dwell"), F.min(F.timestamp_diff("SECOND", F.col("ts_end"), as_of_column())).alias("age_seconds"),
        F.max(F.col("gate.mode") == "masked").alias("masked"), F.max(F.col("gate.sensitivity") == "high").alias("high"),
    )
    gate = F.when(F.col("masked"), "masked").otherwise("allowed").alias("gate_mode")
    return by.select("*", gate, F.when(F.col("high"), "high").when(F.col("masked"), "medium").otherwise("low").alias("sensitivity"))


_GATED = f"""{_E}, s AS (SELECT subject_id, domain, artifact, count(*) AS events, CAST(sum(dwell) AS DOUBLE) AS dwell, min(CAST(trunc(epoch({_CUT} - ts_end)) AS BIGINT)) AS age_seconds,
  bool_or(id % 11 = 0) AS high, bool_or(id % 11 = 0 OR id % 7 = 0) AS masked FROM e WHERE domain <> 'system' AND action <> 'system' GROUP BY 1, 2, 3)"""
_OPEN = f"{_GATED}, k AS (SELECT *, {_KEYSQL} AS theme FROM s WHERE NOT masked AND NOT high)"
_keyed = lambda e: _gated_spheres(e).withColumn("theme", T.theme_key(F.col("domain"), F.col("artifact")))
named("gated_themes", _of(lambda e: collective.themes(_keyed(e), 20)),
      f"{_OPEN} SELECT theme, count(DISTINCT subject_id) AS subjects, sum(events) AS events, round(sum(dwell) / 3600, 2) AS hours, min(age_seconds) AS evidence_age_seconds, round(0.65 * least(1.0, count(DISTINCT subject_id) / 40) + 0.35 * least(1.0, sum(events) / 40), 3) AS confidence FROM k GROUP BY 1 HAVING count(DISTINCT subject_id) >= 20 ORDER BY subjects DESC, hours DESC, theme LIMIT 24")
named("theme_decisions", _of(lambda e: collective.synthesis(_keyed(e), 3)),
      f"""{_OPEN}, t AS (SELECT theme, count(DISTINCT subject_id) AS n FROM k GROUP BY 1), c AS (SELECT count(*) FILTER (n >= 3) AS o, count(*) FILTER (n < 3) AS u FROM t)
      SELECT CASE WHEN o > 0 THEN 'ready' ELSE 'below_floor' END AS status, (SELECT count(DISTINCT subject_id) FROM s) AS subjects_seen, least(o, 24) AS themes_emitted, greatest(o - 24, 0) AS themes_truncated,
      CASE WHEN u = 0 THEN 'none' WHEN u <= 2 THEN '1-2' WHEN u <= 5 THEN '3-5' ELSE '6+' END AS withheld, 'aggregation_floor: enforced; subject_identity: deny; raw_events: deny' || CASE WHEN o > 24 THEN '; themes: truncate' ELSE '' END AS decisions FROM c""")  # fmt: skip
named("gated_contributions", _of(lambda e: collective.contributions(_gated_spheres(e).withColumn("theme", collective.theme_of(F.col("domain"), F.col("artifact"))), 3).drop("position")),
      f"""{_GATED}, k AS (SELECT subject_id, CASE domain WHEN 'coding' THEN 'coding:implementation' WHEN 'communication' THEN 'communication:async' WHEN 'planning' THEN 'planning:coordination' END AS theme, count(*) AS n FROM s WHERE NOT masked AND NOT high GROUP BY 1, 2)
      SELECT u.subject_id, v.theme, CAST(least(coalesce(n, 0), 3) AS BIGINT) AS value FROM (SELECT DISTINCT subject_id FROM s) u CROSS JOIN (VALUES {", ".join(f"('{t}')" for t in config.THEMES)}) v(theme) LEFT JOIN k ON k.subject_id = u.subject_id AND k.theme = v.theme""")  # fmt: skip
_VOCABULARY = "(VALUES " + ", ".join(f"('{t}')" for t in config.THEMES) + ") v(theme)"
named("secure_theme_totals", _of(lambda e: collective.secure_sum(collective.masked(collective.contributions(_declared(e)), b"cohort secret", "2024-W05"))),
      f"{_DECLARED} SELECT v.theme, count(DISTINCT subject_id) AS total FROM {_VOCABULARY} LEFT JOIN k ON k.theme = v.theme GROUP BY 1")
named("wilson", _of(lambda e: collective.totals(collective.contributions(_declared(e))).crossJoin(F.broadcast(overview.without_system(e).agg(F.countDistinct("subject_id").alias("cohort")))).select("theme", "total", "cohort", collective.wilson(F.col("total"), F.col("cohort")).alias("w")).select("theme", "total", "cohort", "w.low", "w.high")),
      f"""{_DECLARED}, c AS (SELECT count(DISTINCT subject_id) AS n FROM e WHERE domain <> 'system'), t AS (SELECT v.theme, count(DISTINCT subject_id) AS total FROM {_VOCABULARY} LEFT JOIN k ON k.theme = v.theme GROUP BY 1),
      x AS (SELECT theme, total, n AS cohort, total / n AS p, 1 + 1.96 * 1.96 / n AS d FROM t, c)
      SELECT theme, total, cohort, round(greatest(0.0, (p + 1.96 * 1.96 / (2 * cohort)) / d - 1.96 / d * sqrt(p * (1 - p) / cohort + 1.96 * 1.96 / (4 * cohort * cohort))), 3) AS low, round(least(1.0, (p + 1.96 * 1.96 / (2 * cohort)) / d + 1.96 / d * sqrt(p * (1 - p) / cohort + 1.96 * 1.96 / (4 * cohort * cohort))), 3) AS high FROM x""")  # fmt: skip

# feedback and cards, on feedback made from the events

_FEEDBACK = "SELECT id, subject_id, subject_id || '|' || domain AS sphere_id, CASE WHEN k % 11 = 0 THEN 'p' || subject_id || '|' || (k % 4) END AS pack_id, CASE WHEN k % 13 = 0 THEN 'k' || subject_id || '|' || (k % 4) END AS evidence_key, CASE WHEN k % 31 = 0 THEN 'too_private' ELSE ['useful','wrong','stale','too_broad','missing_context'][1 + CAST(k % 5 AS INTEGER)] END AS label, CASE WHEN k % 3 <> 1 THEN ts_start END AS resolved_at, ts_start AS created_at FROM (SELECT *, id * 7919 % 1009 AS k FROM e)"


def _feedback(e: DataFrame) -> DataFrame:
    """An entry for each event, on the sphere of its subject and domain."""
    k = F.col("id") * 7919 % 1009
    labels = F.array(*map(F.lit, ("useful", "wrong", "stale", "too_broad", "missing_context")))
    own = lambda p: F.concat(F.lit(p), "subject_id", F.lit("|"), (k % 4).cast("string"))
    return e.select(
        "id", "subject_id", F.concat_ws("|", "subject_id", "domain").alias("sphere_id"), F.when(k % 11 == 0, own("p")).alias("pack_id"), F.when(k % 13 == 0, own("k")).alias("evidence_key"),
        F.when(k % 31 == 0, "too_private").otherwise(F.element_at(labels, (1 + k % 5).cast("int"))).alias("label"), F.when(k % 3 != 1, F.col("ts_start")).alias("resolved_at"), F.col("ts_start").alias("created_at"),
    )


def _sphere_figures(e: DataFrame) -> DataFrame:
    """The sphere of each subject and domain, with a confidence and an age."""
    by = e.groupBy("subject_id", F.concat_ws("|", "subject_id", "domain").alias("sphere_id")).agg(F.count(F.lit(1)).alias("n"), F.max("ts_end").alias("last_seen"))
    return by.select("subject_id", "sphere_id", (F.col("n") % 10 / 10).alias("confidence"), F.datediff(as_of_column(), F.to_date("last_seen")).alias("age_days"))


_FIGURES = f"SELECT subject_id, subject_id || '|' || domain AS sphere_id, count(*) % 10 / 10 AS confidence, date_diff('day', CAST(max(ts_end) AS DATE), CAST({_CUT} AS DATE)) AS age_days FROM e GROUP BY subject_id, domain"
_PIVOT = f"{_E}, f AS ({_FEEDBACK}), v AS (SELECT sphere_id, " + ", ".join(f"count(*) FILTER (label = '{x}') AS {x}" for x in learning.LABELS) + " FROM f WHERE resolved_at IS NULL GROUP BY 1)"
named("feedback_pivot", _of(lambda e: learning.feedback_pivot(_feedback(e))), f"{_PIVOT} SELECT * FROM v")
_STATUS = "CASE WHEN coalesce(too_private, 0) > 0 THEN 'privacy_review' WHEN coalesce(stale, 0) > 0 THEN 'stale' WHEN coalesce(wrong + too_broad + missing_context, 0) > 0 THEN 'needs_evidence' WHEN confidence < 0.45 THEN 'weak' WHEN coalesce(useful, 0) > 0 THEN 'validated' WHEN age_days > 7 THEN 'aging' ELSE 'learning' END"
named("cards", _of(lambda e: learning.cards(_sphere_figures(e), _feedback(e)).select("sphere_id", "status")), f"{_PIVOT}, s AS ({_FIGURES}) SELECT sphere_id, {_STATUS} AS status FROM s LEFT JOIN v USING (sphere_id)")
def _packs_of(e: DataFrame) -> DataFrame:
    """Four packs of each subject's spheres but those of talk: objections to these have lost their sphere."""
    own = lambda p: F.concat(F.lit(p), "subject_id", F.lit("|"), F.col("k").cast("string"))
    rows = e.where("domain <> 'communication'").select("subject_id", "domain", (F.col("id") % 4).alias("k")).distinct()
    return rows.select("subject_id", own("p").alias("pack_id"), F.concat_ws("|", "subject_id", "domain").alias("sphere_id"), own("k").alias("evidence_key"))


def _mostly_resolved(e: DataFrame) -> DataFrame:
    """The feedback, of which most was resolved: else hardly a pack would be free."""
    return _feedback(e).withColumn("resolved_at", F.coalesce("resolved_at", F.when(F.col("id") % 24 != 5, F.col("created_at"))))


named("restrictions", _of(lambda e: learning.blocked_packs(_packs_of(e), _mostly_resolved(e))),
      f"""{_E}, f AS (SELECT * FROM ({_FEEDBACK}) WHERE resolved_at IS NULL AND id % 24 = 5 AND label IN ('too_private', 'wrong', 'stale')),
      p AS (SELECT DISTINCT subject_id, 'p' || subject_id || '|' || (id % 4) AS pack_id, subject_id || '|' || domain AS sphere_id, 'k' || subject_id || '|' || (id % 4) AS evidence_key FROM e WHERE domain <> 'communication')
      SELECT DISTINCT pack_id FROM p WHERE EXISTS (SELECT 1 FROM f WHERE f.subject_id = p.subject_id AND (f.sphere_id = p.sphere_id OR f.pack_id = p.pack_id OR f.evidence_key = p.evidence_key
        OR f.label = 'too_private' AND (f.sphere_id IS NULL OR f.sphere_id NOT IN (SELECT sphere_id FROM p q WHERE q.subject_id = f.subject_id))))""")  # fmt: skip
named("latest_checkpoints", _of(lambda e: learning.latest_checkpoints(_feedback(e), 3).select("id", "sphere_id", "revision")),
      f"{_E}, f AS ({_FEEDBACK}) SELECT id, sphere_id, revision FROM (SELECT *, row_number() OVER (PARTITION BY sphere_id ORDER BY created_at DESC, id DESC) AS revision FROM f) WHERE revision <= 3")
_RUN_A = [("resume", 1.0, 0.0, 9, 11557), ("canary", 1.0, 0.0, 9, 12016), ("gate", 1.0, 0.1, 9, 11091), ("denied", 1.0, 0.0, 11, 5872), ("stale", 1.0, 0.0, 10, 5782), ("gone", 1.0, 0.0, 1, 10)]
_RUN_B = [("resume", 1.0, 0.01, 9, 11600), ("canary", 0.9, 0.0, 9, 12016), ("gate", 1.0, 0.2, 9, 11091), ("denied", 1.0, 0.0, 10, 5872), ("stale", 1.0, 0.0, 10, 9000), ("fresh", 1.0, 0.0, 1, 10)]
_SCHEMA = "name string, recall double, noise double, denied int, chars int"
_VALUES = lambda rows, n: "(VALUES " + ", ".join(map(str, rows)) + f") {n}(name, recall, noise, denied, chars)"
named("baseline_compare", lambda s, d: learning.compare_baseline(s.createDataFrame(_RUN_A, _SCHEMA), s.createDataFrame(_RUN_B, _SCHEMA)),
      f"""SELECT coalesce(b.name, c.name) AS name, CASE WHEN c.name IS NULL THEN 'disappeared' WHEN b.name IS NULL THEN 'new' WHEN c.recall < b.recall - 0.02 THEN 'recall fell' WHEN c.noise > b.noise + 0.05 THEN 'noise rose' WHEN c.denied < b.denied THEN 'fewer denied' WHEN c.chars > b.chars * 1.25 THEN 'pack grew' ELSE 'ok' END AS verdict FROM {_VALUES(_RUN_A, 'b')} FULL JOIN {_VALUES(_RUN_B, 'c')} ON b.name = c.name""")
named("fidelity_score", _of(lambda e: e.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("artifact").alias("a"), F.countDistinct("domain").alias("m")).select("subject_id", learning.fidelity(F.col("n"), F.col("a"), F.col("m"), F.lit(2), F.lit(1000), F.lit(True)).alias("score"))),
      f"{_E} SELECT subject_id, CAST(floor(least(1.0, least(1.0, count(*) / 600) * 0.24 + least(1.0, count(DISTINCT artifact) / 42) * 0.18 + least(1.0, count(DISTINCT domain) / 8) * 0.2 + 2 / 3 * 0.12 + 0.48 * 0.16 + 0.1) * 100 + 0.5) AS INTEGER) AS score FROM e GROUP BY 1")
