"""What is told of collection as a whole: the privacy payload, and the overview over one window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from focusloom import config as C
from focusloom.operators import graph, overview, profile, spheres, surfaces
from focusloom.schema import AS_OF, as_of_column
from focusloom.sources.shared import written

# What is and what isn't captured, in words.
CAPTURED = (
    "active app", "window title or redacted title", "timestamp", "dwell time", "derived work domain", "derived context graph nodes and privacy-gated edges", "derived working spheres and resume packs",
)
NOT_CAPTURED = (
    "keystrokes", "screenshots", "clipboard", "microphone", "camera", "passwords", "tokens", "raw browser URL paths, queries, or fragments by default",
    "in-app player content unless a per-app Accessibility/OCR connector is explicitly enabled",
)


def captured(cfg: C.Config = C.Config()) -> list[str]:
    """What is captured at the depth set."""
    # What each depth adds.
    more = ((cfg.browser_min_depth, "browser tab title and sanitized URL domain"), (cfg.accessibility_min_depth, "allowlisted Accessibility UI labels"), (cfg.ocr_min_depth, "redacted local OCR summaries"))
    return [*CAPTURED, *(what for depth, what in more if cfg.capture_depth >= depth)]


def privacy(events: DataFrame, days: int = 14, as_of: str = AS_OF, cfg: C.Config = C.Config()) -> DataFrame:
    """One row per subject: settings, what is kept beyond its time, and in the window what was redacted and which connectors read.

    Each event becomes a few rows of (kind, key, count), so one pass with one
    aggregation before the shuffle gives all figures.
    """
    cut = lambda n: as_of_column(as_of) - F.expr(f"interval {n} days")
    inside = F.col("ts_start").isNull() | (F.col("ts_start") >= cut(days))
    row = lambda kind, key, n: F.struct(F.lit(kind).alias("kind"), key.alias("key"), n.cast("long").alias("n"))
    none = F.array().cast("array<struct<kind:string,key:string,n:bigint>>")
    parts = [F.array(row("event", F.lit(""), F.lit(1)))]
    if "findings" in events.columns:
        parts.append(F.coalesce(F.when(inside, F.transform(F.filter(F.map_entries("findings"), lambda f: f["value"] > 0), lambda f: row("finding", f["key"], f["value"]))), none))
    if "structured" in events.columns:
        read = F.array(row("connector", F.col("structured.connector"), F.lit(1)))
        parts.append(F.when(inside & (F.col("structured.status") == "captured"), read).otherwise(none))
    each = events.select("subject_id", "ts_start", inside.alias("inside"), F.explode(F.concat(*parts)).alias("r"))
    old = (F.col("r.kind") == "event") & (F.col("ts_start") < cut(cfg.retention_days))
    sums = each.groupBy("subject_id", "r.kind", "r.key").agg(F.sum("r.n").alias("n"), F.count_if(old).alias("old"), F.count_if("inside").alias("shown"), F.min("ts_start").alias("oldest"))
    is_event = F.col("kind") == "event"
    listed = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "n")))))
    out = sums.groupBy("subject_id").agg(
        F.max(F.when(is_event, F.col("n"))).alias("events_all_time"), F.max(F.when(is_event, F.col("shown"))).alias("events_in_window"), F.max(F.when(is_event, F.col("old"))).alias("expired_events"),
        F.min("oldest").alias("oldest_event"), listed("finding").alias("redaction_summary"), listed("connector").alias("connector_activity"),
    )
    on = {"capture_title": cfg.capture_title, "redact_titles": cfg.redact_titles, "mask_pii": cfg.mask_pii, "mask_ip": cfg.mask_ip, "redact_urls": cfg.redact_urls, "collection_paused": cfg.collection_paused}
    settings = F.create_map(*(F.lit(x) for pair in on.items() for x in pair))
    return out.withColumns({"retention_days": F.lit(cfg.retention_days), "settings": settings, "captured": F.array(*map(F.lit, captured(cfg))), "not_captured": F.array(*map(F.lit, NOT_CAPTURED))})


def overview_parts(events: DataFrame, days: int = 14, as_of: str = AS_OF, cfg: C.Config = C.Config()) -> tuple[dict, dict[str, DataFrame]]:
    """(figures, parts) of the window. The events are read once: figures are observed while the window's rows are written, and all parts read those."""
    old = F.col("ts_start") < as_of_column(as_of) - F.expr(f"interval {cfg.retention_days} days")
    stored, shown = Observation("stored"), Observation("shown")
    seen = events.observe(stored, F.count(F.lit(1)).alias("events_all_time"), F.count_if(old).alias("expired_events"), F.min("ts_start").alias("oldest_event"))
    rows = overview.window_scan(seen, days, as_of)
    rows = rows.observe(shown, F.count(F.lit(1)).alias("events_in_window"), F.sum("dwell").cast("double").alias("dwell"), F.min("ts_start").alias("first_event"), F.max("ts_start").alias("last_event"))
    window = written(rows, "window")
    figures = {**stored.get, **shown.get}
    return figures, {
        "profile": profile.signature(window, min(5, days), days), "graph_nodes": graph.nodes(window, cfg.max_nodes, cfg), "graph_edges": graph.edges(window, cfg.max_edges, cfg.max_nodes, cfg), "spheres": spheres.report(window, spheres.assign(window, cfg, carry=True), as_of, cfg),
        "totals": surfaces.window_totals(window, as_of_column(as_of)), "domains": overview.domain_summary(window), "top_apps": overview.top_items(window, "app"), "top_artifacts": overview.top_items(window, "artifact"),
        "daily_activity": overview.daily_activity(window), "hourly_heatmap": overview.hourly_heatmap(window), "transitions": profile.transitions(window), "recent_events": window.orderBy(F.desc("ts_start"), F.desc("id")).limit(50),
    }
