"""What surfaces show: sanitised lines, media, the window's totals, insights, and an overview's parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from focusloom.operators.overview import without_system

# Words by which a surface is one of media.
MEDIA = ("player", "music", "spotify", "youtube", "twitch", "netflix", "hulu", "video", "stream", "tv", "podcast", "radio")
#: Surfaces by preference: the first that has something is taken.
PRECEDENCE = ("browser_tab", "accessibility_snapshot", "ocr_summary")


def ordered_distinct(values: Column) -> Column:
    """An array's values without those that only differ in case from an earlier one, in order."""
    low = F.transform(values, F.lower)
    return F.filter(values, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)


def sanitized_lines(lines: Column, redact, text_limit: int = 120, max_lines: int = 12, max_hints: int = 8) -> Column:
    """Of lines(text, confidence): hints without white space runs, clipped, redacted, distinct and capped; their mean confidence; a summary of three.

    redact: a function of a Column.
    """
    first = F.slice(lines, 1, max(1, max_lines))
    clean = lambda t: F.substring(F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"\s+", " ")), 1, text_limit)
    full = F.filter(first, lambda x: clean(x["text"]) != "")
    hints = F.slice(ordered_distinct(F.filter(F.transform(full, lambda x: F.trim(redact(clean(x["text"])))), lambda t: t != "")), 1, max_hints)
    known = F.filter(F.transform(full, lambda x: x["confidence"].cast("double")), lambda c: c.isNotNull())
    mean = F.when(F.size(known) > 0, F.round(F.aggregate(known, F.lit(0.0), lambda a, c: a + c) / F.size(known), 3)).otherwise(0.0)
    joined = F.array_join(F.slice(hints, 1, 3), "; ")
    summary = F.when(F.length(joined) > 260, F.concat(F.rtrim(F.substring(joined, 1, 257)), F.lit("..."))).otherwise(joined)
    return F.struct(F.when(F.size(hints) > 0, "captured").otherwise("empty").alias("status"), hints.alias("hints"), summary.alias("summary"), mean.alias("confidence"))


def chosen_surface(surfaces: dict[str, Column]) -> Column:
    """The first surface, by precedence, that was captured: its kind; null if none."""
    return F.coalesce(*(F.when(surfaces[k]["status"] == "captured", k) for k in PRECEDENCE if k in surfaces), F.lit(None).cast("string"))


def merged_findings(*maps: Column) -> Column:
    """Counts by category of several findings, added up; those that aren't over 0 go."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_zip_with(out, m, lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return F.map_filter(out, lambda _, v: v > 0)


def whole_findings(stored: Column) -> Column:
    """A stored map of strings -> counts: what can't be read as a whole number over 0 goes."""
    counts = F.transform_values(stored, lambda _, v: v.try_cast("int"))
    return F.map_filter(counts, lambda _, v: v > 0)


def is_media(*parts: Column) -> Column:
    """Do an app, title, domain or hints speak of media?"""
    return F.lower(F.concat_ws(" ", *parts)).rlike("|".join(MEDIA))


def media_focus(events: DataFrame) -> DataFrame:
    """Per subject the latest media event, or else the latest one, and what can be told of it."""
    rows = events.withColumn("media", is_media(F.col("app"), F.col("artifact")))
    at = F.struct("media", "ts_start", "id")
    out = rows.groupBy("subject_id").agg(F.max_by(F.struct("app", "artifact", "ts_end", "domain", "media"), at).alias("f"))
    status = F.when(F.col("f.media"), "opaque").otherwise("watching")
    return out.select("subject_id", "f.app", F.substring("f.artifact", 1, 160).alias("artifact"), F.col("f.ts_end").alias("last_seen"), status.alias("status"), F.when(F.col("f.media"), "app/window only").otherwise("attention only").alias("visibility"))


def attention_depth(events: DataFrame, browser_apps: tuple = (), accessibility_apps: tuple = (), ocr_apps: tuple = (), depth: int = 1, cap: int = 8) -> DataFrame:
    """Per subject and app: dwell, top artifact, and how deep its surface may be looked into; the apps with most dwell."""
    rows = without_system(events)
    by = rows.groupBy("subject_id", "app", "artifact").agg(F.count(F.lit(1)).alias("n"), F.sum("dwell").alias("d"), F.max("ts_end").alias("e"), F.min(F.struct("ts_start", "id")).alias("f"))
    out = by.groupBy("subject_id", "app").agg(F.sum("n").alias("events"), F.sum("d").cast("double").alias("dwell"), F.max("e").alias("last_seen"), F.min_by("artifact", F.struct(-F.col("n"), "f")).alias("top_artifact"))
    app = F.lower("app")
    ladder = F.lit("window metadata")
    for apps, least, name in ((ocr_apps, 4, "local OCR"), (accessibility_apps, 3, "UI metadata"), (browser_apps, 2, "browser metadata")):
        mine = app.isin(*(a.lower() for a in apps)) if apps else F.lit(False)
        ladder = F.when(mine, F.lit(name if depth >= least else f"{name} ready at Depth {least}")).otherwise(ladder)
    k = F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc("dwell"), "app"))
    return out.withColumn("status", ladder).withColumn("rank", k).where(F.col("rank") <= cap)


def window_totals(events: DataFrame, as_of: Column) -> DataFrame:
    """Per subject: events, dwell, hours, first and last time, and the last one's age."""
    out = events.groupBy("subject_id").agg(F.count(F.lit(1)).alias("events"), F.sum("dwell").cast("double").alias("dwell"), F.min("ts_start").alias("first_event"), F.max("ts_end").alias("last_event"))
    return out.withColumn("hours", F.round(F.col("dwell") / 3600, 2)).withColumn("age_seconds", F.greatest(F.timestamp_diff("SECOND", F.col("last_event"), as_of), F.lit(0)))


def insights(signature: DataFrame, shares: DataFrame) -> DataFrame:
    """Per subject the titles of what its signature says. signature: revisit_rate, kl, owned_domains; shares: domain, share."""
    top = shares.groupBy("subject_id").agg(F.max_by("domain", F.struct("share", "domain")).alias("top_domain"), F.max("share").alias("top_share"))
    rows = signature.join(top, "subject_id")
    # Titles and their bounds.
    said = F.array_compact(F.array(F.lit("Primary focus"), F.when(F.col("revisit_rate") >= 0.2, "Repeated pull").otherwise("Low revisit pattern"), F.when(F.col("kl") >= 0.2, "Baseline shift").otherwise("Stable rhythm"), F.when(F.col("owned_domains") != "", "Inferred responsibility")))
    return rows.select("subject_id", "top_domain", F.round(F.col("top_share") * 100).cast("int").alias("top_percent"), said.alias("titles"))


def radar(signature: DataFrame) -> DataFrame:
    """Five axes of a signature, each from 0 to 1."""
    unit = lambda x: F.round(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), 4)
    owned = F.when(F.col("owned_domains") == "", 0).otherwise(F.size(F.split("owned_domains", ",")))
    return signature.select("subject_id", unit(owned / 5).alias("ownership"), unit(F.col("revisit_rate")).alias("recurrence"), unit(F.col("entropy") / 3).alias("switching"), unit(F.col("kl")).alias("shift"), unit(F.col("mean_dwell") / 600).alias("depth"))
