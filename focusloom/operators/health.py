"""Health of a collecting device, policy and readiness of a fleet: ladders over settings and the latest sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from focusloom.config import Config
from focusloom.schema import AS_OF, as_of_column

STALE_AFTER = 180


def last_sample(events: DataFrame, as_of: str = AS_OF, days: int = 1) -> DataFrame:
    """Per subject: events ever and in the last days, the latest one, its age, and whether it is fresh."""
    recent = F.col("ts_start") >= as_of_column(as_of) - F.expr(f"interval {days} days")
    out = events.groupBy("subject_id").agg(F.count_if(recent).alias("events_in_window"), F.count(F.lit(1)).alias("events_all_time"), F.max(F.when(recent, F.col("ts_end"))).alias("last_event"), F.max_by("app", F.when(recent, F.struct("ts_end", "id"))).alias("last_app"))
    age = F.greatest(F.timestamp_diff("SECOND", F.col("last_event"), as_of_column(as_of)), F.lit(0))
    status = F.when(F.col("last_event").isNull(), "waiting").when(age <= STALE_AFTER, "ready").otherwise("stale")
    return out.withColumn("last_age_seconds", age).withColumn("status", status)


def checks(cfg: Config, services: dict[str, bool], fresh: bool, store_there: bool = True) -> list[tuple[str, str]]:
    """(name, status) of each diagnostic that settings and service states decide.

    services: collector, dashboard, watchdog, learning -> running. What only the
    device can tell (window permission) isn't asked.
    """
    up = lambda name, otherwise: "ready" if services.get(name) else otherwise
    deep = cfg.capture_depth >= min(cfg.browser_min_depth, cfg.accessibility_min_depth, cfg.ocr_min_depth)
    return [
        ("Collection mode", "attention" if cfg.collection_paused else "ready"), ("Collector service", up("collector", "blocked")), ("Dashboard service", up("dashboard", "blocked")),
        ("Watchdog service", up("watchdog", "attention")), ("Learning maintenance", up("learning", "attention")), ("Sample freshness", "ready" if fresh or cfg.collection_paused else "attention"),
        ("Automation Permissions", "attention" if deep else "ready"), ("Local OCR provider", "attention" if cfg.capture_depth >= cfg.ocr_min_depth else "gated"), ("PII masking", "ready" if cfg.mask_pii else "blocked"),
        ("URL minimization", "attention" if cfg.store_url_path or cfg.store_url_query else "ready"), ("Raw upload boundary", "blocked" if cfg.raw_event_upload else "ready"), ("Event store", "ready" if store_there else "attention"),
    ]


def posture(blocked: Column, attention: Column) -> Column:
    return F.when(blocked > 0, "blocked").when(attention > 0, "attention").otherwise("ready")


def report(events: DataFrame, cfg: Config = Config(), services: dict[str, bool] | None = None, as_of: str = AS_OF) -> DataFrame:
    """One row per subject: how many checks are ready, need attention or block, and what follows.

    Only the freshness differs between subjects; the settings' checks are counted here once.
    """
    running = {"collector": True, "dashboard": True, "watchdog": True, "learning": True} if services is None else services
    count = lambda fresh, status: sum(s == status for _, s in checks(cfg, running, fresh))
    rows = last_sample(events, as_of)
    fresh = F.col("status") == "ready"
    n = {s: F.when(fresh, count(True, s)).otherwise(count(False, s)) for s in ("ready", "attention", "blocked")}
    rows = rows.select("*", *(c.cast("int").alias(f"n_{s}") for s, c in n.items()))
    return rows.withColumn("posture", posture(F.col("n_blocked"), F.col("n_attention")))


def policy(cfg: Config) -> dict:
    """What a fleet's control plane may know of a device's settings."""
    return {
        "version": cfg.policy_version, "capture_depth": cfg.capture_depth, "collection_paused": cfg.collection_paused, "retention_days": cfg.retention_days, "mask_pii": cfg.mask_pii, "redact_url_paths": cfg.redact_urls,
        "browser_tab_details": cfg.capture_depth >= cfg.browser_min_depth, "browser_url_path": cfg.store_url_path, "browser_url_query": cfg.store_url_query, "raw_event_upload": cfg.raw_event_upload,
        "upload_mode": cfg.upload_mode, "allowed_export_targets": list(cfg.export_targets),
    }


def readiness(cfg: Config) -> list[tuple[str, str]]:
    """(name, status) of what has to hold before a device may sync."""
    return [
        ("Device identity", "ready" if cfg.device_id else "attention"), ("Local redaction", "ready" if cfg.mask_pii else "blocked"), ("Raw event upload", "blocked" if cfg.raw_event_upload else "ready"),
        ("Browser URL minimization", "attention" if cfg.store_url_path or cfg.store_url_query else "ready"), ("Control plane", "ready" if cfg.sync_enabled and cfg.control_plane_url.strip() else "not enrolled"),
        ("Encryption at rest", "planned"), ("Signed updates", "planned"),
    ]


def device_health(collector: bool, dashboard: bool, age_seconds: Column) -> Column:
    if not collector:
        return F.lit("offline")
    return F.when(age_seconds.isNull(), "waiting").when(age_seconds > STALE_AFTER, "stale").otherwise("online" if dashboard else "collector-only")


def fleet(events: DataFrame, cfg: Config = Config(), collector: bool = True, dashboard: bool = True, as_of: str = AS_OF) -> DataFrame:
    """One row per device (a subject): its health by its latest event, enrolment and readiness."""
    enrolled, ready = cfg.sync_enabled and bool(cfg.control_plane_url), readiness(cfg)
    rows = events.groupBy("subject_id").agg(F.count(F.lit(1)).alias("events"), F.max_by("ts_end", F.struct("ts_start", "id")).alias("last_event"))
    age = F.greatest(F.timestamp_diff("SECOND", F.col("last_event"), as_of_column(as_of)), F.lit(0))
    rows = rows.withColumn("health", device_health(collector, dashboard, age)).withColumn("online", F.col("health").isin("online", "collector-only"))
    return rows.select(
        "subject_id", "events", "last_event", "health", "online", F.lit("enrolled" if enrolled else "local-only").alias("status"), F.lit(cfg.upload_mode if enrolled else "local_only").alias("sync_mode"),
        F.lit(sum(s == "ready" for _, s in ready)).alias("readiness_ready"), F.lit(len(ready)).alias("readiness_total"), F.lit(sum(s == "blocked" for _, s in ready)).alias("blocking"),
    )


def check_rows(spark: SparkSession, cfg: Config = Config()) -> DataFrame:
    """The readiness checks as rows."""
    return spark.createDataFrame(readiness(cfg), "name string, status string")


def permitted_sources(cfg: Config) -> list[str]:
    """Which surfaces the capture depth opens."""
    least = {"window_title": 1, "browser_tab": cfg.browser_min_depth, "accessibility": cfg.accessibility_min_depth, "ocr": cfg.ocr_min_depth}
    return [s for s, d in least.items() if d <= cfg.capture_depth]
