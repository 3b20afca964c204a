"""Window scans and overview aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from focusloom.schema import AS_OF, as_of_column


def window_scan(events: DataFrame, days: int | None, as_of: str = AS_OF, subject: str | None = None) -> DataFrame:
    """The last ``days`` days; rows without a time stay, and no days means no window."""
    if subject is not None:
        events = events.where(F.col("subject_id") == subject)
    if not days or days <= 0:
        return events
    return events.where(F.col("ts_start").isNull() | (F.col("ts_start") >= as_of_column(as_of) - F.expr(f"interval {days} days")))


def retention_split(events: DataFrame, days: int, as_of: str = AS_OF) -> DataFrame:
    old = F.col("ts_start") < as_of_column(as_of) - F.expr(f"interval {days} days")
    return events.groupBy("subject_id").agg(F.count_if(old).alias("expired"), F.count_if(~old).alias("kept"), F.min("ts_start").alias("oldest"))


def without_system(events: DataFrame) -> DataFrame:
    return events.where("domain <> 'system' and action <> 'system'")


def daily_activity(events: DataFrame) -> DataFrame:
    out = events.groupBy(F.to_date("ts_start").alias("day")).agg(F.count(F.lit(1)).alias("events"), F.sum("dwell").cast("double").alias("dwell"))
    return out.withColumn("hours", F.round(F.col("dwell") / 3600, 2))


def hourly_heatmap(events: DataFrame) -> DataFrame:
    """All 24 hours, with dwell as a share of the peak's."""
    sums = events.groupBy(F.hour("ts_start").alias("hour")).agg(F.sum("dwell").cast("double").alias("dwell"))
    hours = events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    out = hours.join(sums, "hour", "left").withColumn("dwell", F.coalesce("dwell", F.lit(0.0)))
    return out.withColumn("intensity", F.round(F.col("dwell") / F.greatest(F.max("dwell").over(Window.partitionBy(F.lit(0))), F.lit(1e-9)), 4))  # 24 rows


def domain_summary(events: DataFrame, top: int = 4) -> DataFrame:
    by_app = events.groupBy("domain", "app").agg(F.sum("dwell").cast("double").alias("d"), F.count(F.lit(1)).alias("n"))
    ranked = by_app.withColumn("k", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("d"), "app")))
    out = ranked.groupBy("domain").agg(F.sum("d").alias("dwell"), F.sum("n").alias("events"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= top, F.struct("k", "app")))), lambda x: x["app"]), ",").alias("top_apps"))
    total = out.agg(F.sum("dwell").alias("total"))
    return out.crossJoin(F.broadcast(total)).select("domain", F.round("dwell", 2).alias("dwell"), "events", F.round(F.col("dwell") / F.col("total"), 4).alias("share"), "top_apps")  # one row


def top_items(events: DataFrame, key: str, k: int = 10) -> DataFrame:
    by = events.groupBy(F.col(key).alias("item")).agg(F.sum("dwell").cast("double").alias("dwell"), F.count(F.lit(1)).alias("events"), F.min_by("domain", F.struct("ts_start", "id")).alias("domain"))
    return by.orderBy(F.desc("dwell"), "item").limit(k)


def artifact_stats(events: DataFrame) -> DataFrame:
    """Per subject and artifact (the app where it has none): first seen attributes, visits, dwell, times."""
    key = F.when(F.coalesce("artifact", F.lit("")) == "", F.col("app")).otherwise(F.col("artifact"))
    at = F.struct("ts_start", "id")
    return events.groupBy("subject_id", key.alias("artifact")).agg(
        F.min_by("domain", at).alias("domain"), F.min_by("app", at).alias("app"), F.sum("dwell").cast("double").alias("dwell"), F.count(F.lit(1)).alias("visits"),
        F.min("ts_start").alias("first_seen"), F.max_by("ts_end", at).alias("last_seen"), F.min(at).alias("first_ord"),
    )
