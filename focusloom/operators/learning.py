"""Feedback, cards, restrictions, checkpoints, admission; comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = ("useful", "wrong", "stale", "too_broad", "too_private", "missing_context")
#: Labels that, while open, keep a pack from being handed on.
RESTRICTING = ("too_private", "wrong", "stale")
RECALL_TOLERANCE, NOISE_TOLERANCE, GROWTH_TOLERANCE = 0.02, 0.05, 0.25


def feedback_pivot(feedback: DataFrame) -> DataFrame:
    """Unresolved labels counted by sphere, a column each."""
    return feedback.where("resolved_at is null").groupBy("sphere_id").agg(*(F.count_if(F.col("label") == name).alias(name) for name in LABELS))


def card_status(confidence: Column, age_days: Column) -> Column:
    issues = F.col("wrong") + F.col("too_broad") + F.col("missing_context")
    return (
        F.when(F.col("too_private") > 0, "privacy_review").when(F.col("stale") > 0, "stale").when(issues > 0, "needs_evidence").when(confidence < 0.45, "weak")
        .when(F.col("useful") > 0, "validated").when(age_days > 7, "aging").otherwise("learning")
    )


def cards(spheres: DataFrame, feedback: DataFrame) -> DataFrame:
    """spheres(sphere_id, confidence, age_days) with their feedback and status."""
    out = spheres.join(feedback_pivot(feedback), "sphere_id", "left").fillna(0, list(LABELS))
    return out.withColumn("status", card_status(F.col("confidence"), F.col("age_days")))


def blocked_packs(packs: DataFrame, feedback: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Packs that an open restriction of their subject names by sphere, pack or evidence.

    A privacy objection whose sphere is lost (none, or not among known(subject_id,
    sphere_id), by default the packs' own) stays in force: it blocks all the
    subject's packs. Tables without subject_id are one subject's.
    """
    by = ["subject_id"] if "subject_id" in packs.columns and "subject_id" in feedback.columns else []
    open_ones = feedback.where(F.col("resolved_at").isNull() & F.col("label").isin(*RESTRICTING))
    hit = None
    for key in ("sphere_id", "pack_id", "evidence_key"):
        mine = packs.join(open_ones.select(*by, key).where(F.col(key).isNotNull()).distinct(), [*by, key], "left_semi").select("pack_id")
        hit = mine if hit is None else hit.union(mine)
    spheres = (packs if known is None else known).select(*by, "sphere_id").distinct()
    lost = open_ones.where("label = 'too_private'").join(spheres, [*by, "sphere_id"], "left_anti")
    if by:
        return hit.union(packs.join(lost.select(*by).distinct(), by, "left_semi").select("pack_id")).distinct()
    return hit.union(packs.select("pack_id").crossJoin(F.broadcast(lost.limit(1).select(F.lit(1).alias("_x")))).select("pack_id")).distinct()  # a row at most


def latest_checkpoints(checkpoints: DataFrame, history: int = 10) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("sphere_id").orderBy(F.desc("created_at"), F.desc("id")))
    return checkpoints.withColumn("revision", k).where(F.col("revision") <= history)


def compare_baseline(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(scenario, verdict) of two runs' figures: name, recall, noise, denied, chars."""
    b, c = (d.select("name", *(F.col(x).alias(f"{p}_{x}") for x in ("recall", "noise", "denied", "chars")), F.lit(1).alias(f"{p}_here")) for d, p in ((baseline, "b"), (current, "c")))
    both = b.join(c, "name", "full_outer")
    verdict = (
        F.when(F.col("c_here").isNull(), "disappeared").when(F.col("b_here").isNull(), "new").when(F.col("c_recall") < F.col("b_recall") - RECALL_TOLERANCE, "recall fell")
        .when(F.col("c_noise") > F.col("b_noise") + NOISE_TOLERANCE, "noise rose").when(F.col("c_denied") < F.col("b_denied"), "fewer denied")
        .when(F.col("c_chars") > F.col("b_chars") * (1 + GROWTH_TOLERANCE), "pack grew").otherwise("ok")
    )
    return both.select("name", verdict.alias("verdict"))


def fidelity(events: Column, nodes: Column, spheres: Column, depth: Column, age_seconds: Column, private: Column) -> Column:
    """0 to 100: how well a profile stands on its evidence."""
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    recency = F.when(age_seconds < 120, 1.0).when(age_seconds < 900, 0.72).when(age_seconds < 3600, 0.48).otherwise(0.22)
    score = unit(events / 600) * 0.24 + unit(nodes / 42) * 0.18 + unit(spheres / 8) * 0.2 + F.least(F.greatest(depth / 3, F.lit(0.25)), F.lit(1.0)) * 0.12 + recency * 0.16 + F.when(private, 1.0).otherwise(0.45) * 0.1
    return F.floor(unit(score) * 100 + 0.5).cast("int")
