"""Scenarios: made-up traces, what a pack must and must not show of them, and how well it does."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from focusloom.schema import AS_OF

FAIL_UNDER = 0.75
EVENT = "scenario string, id long, subject_id string, app string, artifact string, domain string, action string, ts_start timestamp_ntz, ts_end timestamp_ntz"


def scenario_events(spark: SparkSession, scenarios: list[dict], as_of: str = AS_OF) -> DataFrame:
    """The events of scenarios: each {name, events: [{app, artifact, domain, minutes_ago, dwell}]}; a scenario is a subject of its own, and ids are unique over all."""
    end, rows = datetime.fromisoformat(as_of), []
    for s in scenarios:
        for e in s["events"]:
            at = end - timedelta(minutes=float(e.get("minutes_ago", 0)))
            dwell = float(e.get("dwell", 60))
            rows.append((s["name"], len(rows), s["name"], e.get("app", "App"), e.get("artifact", ""), e.get("domain", "other"), e.get("action", "focus"), at, at + timedelta(seconds=dwell)))
    made = spark.createDataFrame(rows, EVENT)
    return made.withColumn("dwell", F.timestamp_diff("SECOND", "ts_start", "ts_end").cast("decimal(18,2)"))


def score(packs: DataFrame, expected: DataFrame) -> DataFrame:
    """packs(scenario, blob, artifacts array) against expected(scenario, must, must_not, wanted: arrays) -> recall, noise, leaks, size, verdict."""
    rows = expected.join(packs, "scenario", "left").withColumn("low", F.lower(F.coalesce("blob", F.lit(""))))
    shown = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.contains(F.col("low"), F.lower(x)))
    wanted = F.transform(F.coalesce("wanted", F.array().cast("array<string>")), F.lower)
    held = F.coalesce("artifacts", F.array().cast("array<string>"))
    noise = F.filter(held, lambda a: ~F.array_contains(wanted, F.lower(a)))
    recall = F.when(F.size("must") > 0, F.size(shown("must")) / F.size("must")).otherwise(1.0)
    ratio = F.when((F.size(wanted) > 0) & (F.size(held) > 0), F.size(noise) / F.size(held)).otherwise(0.0)
    out = rows.select("scenario", recall.alias("recall"), ratio.alias("noise_ratio"), F.size(shown("must_not")).alias("leaks"), F.length(F.coalesce("blob", F.lit(""))).alias("pack_chars"), F.coalesce("least", F.lit(0.0)).alias("least"))
    return out.withColumn("passed", (F.col("leaks") == 0) & (F.col("recall") >= F.col("least"))).drop("least")


def verdict(results: DataFrame, fail_under: float = FAIL_UNDER) -> DataFrame:
    """One row: means, leaks, how many passed, and whether all is well."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    out = results.agg(F.count(F.lit(1)).alias("scenarios"), F.count_if("passed").alias("passed"), mean("recall").alias("mean_recall"), mean("noise_ratio").alias("mean_noise_ratio"), F.coalesce(F.sum("leaks"), F.lit(0)).alias("leak_count"))
    return out.withColumn("ok", (F.col("leak_count") == 0) & (F.col("mean_recall") >= fail_under) & (F.col("passed") == F.col("scenarios")))
