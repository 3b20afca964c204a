"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from focusloom.config import Config
from focusloom.functions.text import redact
from focusloom.sources.files import Files, recover, swap


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def bundles(spark: SparkSession, path: str) -> DataFrame:
    """Bundles of activities from JSON: a list, or an object with ``bundles``."""
    raw = spark.read.json(path, multiLine=True)
    return raw.select(F.explode("bundles").alias("b")).select("b.*") if "bundles" in raw.columns else raw


def write_events(events: DataFrame, path: str, cfg: Config = Config()) -> None:
    """Appends events, redacted first: there is no writer that takes them as they are. Partitioned by day."""
    safe = redact(events, "title", cfg, "findings_title") if "title" in events.columns else events
    safe = redact(safe, "artifact", cfg, "findings")
    safe.withColumn("event_date", F.to_date("ts_start")).write.mode("append").partitionBy("event_date").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Filters on event_date prune partitions."""
    return spark.read.parquet(path)


def export_json(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").json(path)


def delete_before(spark: SparkSession, path: str, cutoff: str, derived: tuple[str, ...] = ()) -> None:
    """Retention: rewrites the partition of the cutoff's day and drops those before it, and the same in tables derived from it.

    A day's old partition is renamed away before the new one takes its place and
    deleted after that, so that a failure never leaves a day without its rows.
    """
    for table in (path, *derived):
        _delete_before(spark, table, cutoff)


def _delete_before(spark: SparkSession, path: str, cutoff: str) -> None:
    base = path.rstrip("/")
    files, staged = Files(spark, base), f"{base}.staged"
    for name in files.children(base):  # days that a crash left aside
        if name.startswith("_old-"):
            recover(files, f"{base}/event_date={name[5:]}", f"{base}/{name}")
    rows = spark.read.parquet(base).where(F.col("event_date") <= F.to_date(F.lit(cutoff)))
    keep = rows.where(F.col("ts_start") >= F.lit(cutoff).cast("timestamp_ntz"))
    days = [r[0] for r in rows.select("event_date").distinct().orderBy("event_date").collect()]  # one for each day kept so far
    keep.write.mode("overwrite").partitionBy("event_date").parquet(staged)
    for day in days:
        new = f"{staged}/event_date={day}"
        swap(files, new if files.exists(new) else None, f"{base}/event_date={day}", f"{base}/_old-{day}")
    files.delete(staged)
