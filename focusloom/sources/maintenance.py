"""Rewrites of stored events: text updates, redaction after the fact, deletion with what was derived, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from focusloom.config import Config
from focusloom.functions.text import REDACTIONS, redact
from focusloom.sources import crypto
from focusloom.sources.files import Files, recover, replace_table


def fetch(events: DataFrame, subject: str | None = None, since: str | None = None, limit: int | None = None) -> DataFrame:
    """Events in order of time; of a subject, from a time on, at most ``limit``."""
    if subject is not None:
        events = events.where(F.col("subject_id") == subject)
    if since is not None:
        events = events.where(F.col("ts_start") >= F.lit(since).cast("timestamp_ntz"))
    out = events.orderBy("ts_start", "id")
    return out.limit(limit) if limit is not None else out


def count(events: DataFrame, by: str = "subject_id") -> DataFrame:
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("events"))


def parse_time(text: Column) -> Column:
    """An ISO time, with Z, an offset or neither; null for anything else."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def updated(events: DataFrame, changes: DataFrame, columns: tuple[str, ...] = ("artifact",)) -> DataFrame:
    """events with the columns of changes(id, ...) where those have the id and a value; of several changes to an event the latest (``at``) counts."""
    newest = changes.groupBy("id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(f"_{c}") for c in columns))
    rows = events.join(newest, "id", "left")
    return rows.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in events.columns))


def redacted_again(events: DataFrame, cfg: Config = Config(), columns: tuple[str, ...] = ("artifact",)) -> DataFrame:
    """events with their texts redacted, findings_<column> and whether anything changed."""
    out, changed = events, F.lit(False)
    for c in columns:
        out = redact(out.withColumn(f"_was_{c}", F.col(c)), c, cfg, f"findings_{c}")
        changed = changed | ~F.col(f"_was_{c}").eqNullSafe(F.col(c))
    return out.withColumn("changed", changed).drop(*(f"_was_{c}" for c in columns))


def dry_run(events: DataFrame, cfg: Config = Config(), columns: tuple[str, ...] = ("artifact",)) -> DataFrame:
    """What redacting again would do: (category, n), and the number of changed events as category ''."""
    rows = redacted_again(events, cfg, columns)
    kinds = [name for name, _ in REDACTIONS] + ["name"]
    sums = [F.coalesce(F.sum(sum((F.coalesce(F.col(f"findings_{c}")[k], F.lit(0)) for c in columns), F.lit(0))), F.lit(0)) for k in kinds]
    totals = rows.agg(*(n.alias(k) for k, n in zip(kinds, sums)), F.count_if("changed").alias("_changed"))  # one pass
    pairs = F.array(F.struct(F.lit("").alias("category"), F.col("_changed").alias("n")), *(F.struct(F.lit(k).alias("category"), F.col(k).cast("long").alias("n")) for k in kinds))
    return totals.select(F.explode(pairs).alias("p")).select("p.*").where("n > 0 or category = ''")


def delete_all(spark: SparkSession, path: str, subject: str | None = None, derived: tuple[str, ...] = ()) -> None:
    """Deletes all events, or a subject's, and the same from tables derived from them (feedback, cards, sessions). Tables that a crash left half moved are put right first."""
    for table in (path, *derived):
        base = table.rstrip("/")
        files = Files(spark, base)
        recover(files, base, f"{base}.old")
        if not files.exists(base):
            continue
        rows = spark.read.parquet(base)
        keep = rows.where("false") if subject is None else rows.where(~F.col("subject_id").eqNullSafe(F.lit(subject)))
        replace_table(keep, base, "event_date" if "event_date" in rows.columns else None)


def without_repeats(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Events that come once, however often they are sent: by id, within the watermark. For batches and streams."""
    if stream.isStreaming:
        return stream.withWatermark("ts_start", watermark).dropDuplicatesWithinWatermark(["id"])
    return stream.dropDuplicates(["id"])


def unless_paused(events: DataFrame, cfg: Config) -> DataFrame:
    """Nothing while collection is paused."""
    return events.where(F.lit(not cfg.collection_paused))


def rekeyed(rows: DataFrame, columns: tuple[str, ...], old_key: bytes | str | None, new_key: bytes | str) -> DataFrame:
    """Columns encrypted with a new key: read with the old one, or as they are if plain.

    Values that the new key opens already stay, so a change that was broken off can
    go on. A value that neither key opens fails the job.
    """
    out = rows
    for c in columns:
        done = crypto.is_encrypted(F.col(c)) & crypto.decrypt(F.col(c), new_key).isNotNull()
        plain = F.col(c) if old_key is None else crypto.decrypt(F.col(c), old_key)
        lost = crypto.is_encrypted(F.col(c)) & (plain.isNull() | crypto.is_encrypted(plain))
        out = out.withColumn(c, F.when(done, F.col(c)).when(lost, F.raise_error(F.lit("a value needs another key")).cast("string")).otherwise(crypto.encrypt(plain, new_key)))
    return out


def assert_encrypted(rows: DataFrame, columns: tuple[str, ...], key: bytes | str) -> DataFrame:
    """rows, failing at the first value (but null and empty ones) that isn't encrypted, or not with this key."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.coalesce(F.col(c) != "", F.lit(False)) & (~crypto.is_encrypted(F.col(c)) | crypto.decrypt(F.col(c), key).isNull()))
    return rows.where(F.when(bad, F.raise_error(F.lit("a value is not encrypted with this key")).cast("boolean")).otherwise(F.lit(True)))
