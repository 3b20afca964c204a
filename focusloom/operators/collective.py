"""Themes across subjects above a floor of subjects; masked sums; intervals; noise."""

from __future__ import annotations

import hashlib
import json
import math
import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from focusloom import config as C
from focusloom.sources.shared import written

MODULUS = 2**32


def theme_of(domain: Column, text: Column) -> Column:
    """The declared theme of a piece of work, or null."""
    d, t = F.lower(domain), F.lower(text)
    has = lambda *words: reduce(lambda a, w: a | t.contains(w), words, F.lit(False))
    coding = F.when(has("review", "pull request", "diff", "merge"), "coding:review").when(has("bug", "debug", "error", "failure", "trace", "log"), "coding:debugging").otherwise("coding:implementation")
    operations = F.when(has("incident", "alert", "outage", "page"), "operations:incident").otherwise("operations:runbook")
    analysis = F.when(has("doc", "policy", "spec"), "analysis:document").otherwise("analysis:data")
    talk = F.when(has("call", "meet", "zoom", "standup"), "communication:meeting").otherwise("communication:async")
    return (
        F.when(d == "coding", coding).when(d == "operations", operations).when(d.isin("analysis", "data"), analysis).when(d == "writing", "writing:drafting")
        .when(d.isin("communication", "email", "chat"), talk).when(d.isin("planning", "project"), "planning:coordination").when(d.isin("research", "learning"), "learning:research")
    )


def gated(spheres: DataFrame) -> DataFrame:
    """Spheres that may be counted: not masked or generalised, not of high sensitivity, of a named subject. What a table doesn't tell is open."""
    out = spheres.where(F.trim("subject_id") != "")
    if "gate_mode" in spheres.columns:
        out = out.where(F.coalesce("gate_mode", F.lit("allowed")) == "allowed")
    if "sensitivity" in spheres.columns:
        out = out.where(F.coalesce("sensitivity", F.lit("low")) != "high")
    return out


def themes(work: DataFrame, floor: int, cap: int = 24) -> DataFrame:
    """work(subject_id, theme, events, dwell, and gate_mode, sensitivity, age_seconds if known) -> themes with at least ``floor`` subjects; a floor is 2 or more.

    Only what passes :func:`gated` is counted, so a theme that clears the floor does so without masked work.
    """
    if floor < 2:
        raise ValueError("a floor under 2 would show single subjects")
    aged = [F.min("age_seconds").alias("evidence_age_seconds")] if "age_seconds" in work.columns else []
    out = gated(work).groupBy("theme").agg(F.countDistinct("subject_id").alias("subjects"), F.sum("events").alias("events"), F.round(F.sum("dwell") / 3600, 2).alias("hours"), *aged).where(F.col("subjects") >= floor)
    confidence = 0.65 * F.least(F.lit(1.0), F.col("subjects") / (2 * floor)) + 0.35 * F.least(F.lit(1.0), F.col("events") / 40)
    return out.withColumn("confidence", F.round(confidence, 3)).orderBy(F.desc("subjects"), F.desc("hours"), "theme").limit(cap)


def synthesis(work: DataFrame, floor: int, cap: int = 24) -> DataFrame:
    """One row on the themes of :func:`themes`: status, subjects seen (also those without counted work), how many are told, and the decisions taken."""
    supported = gated(work).groupBy("theme").agg(F.countDistinct("subject_id").alias("s")).agg(F.count_if(F.col("s") >= floor).alias("over"), F.count_if(F.col("s") < floor).alias("n"))
    seen = work.where(F.trim("subject_id") != "").agg(F.countDistinct("subject_id").alias("subjects_seen"))
    told, more = F.least("over", F.lit(cap)), F.greatest(F.col("over") - cap, F.lit(0))
    # Fields and their decisions.
    decisions = F.array_compact(F.array(F.lit("aggregation_floor: enforced"), F.lit("subject_identity: deny"), F.lit("raw_events: deny"), F.when(more > 0, "themes: truncate")))
    return supported.crossJoin(F.broadcast(seen)).select(F.when(told > 0, "ready").otherwise("below_floor").alias("status"), "subjects_seen", told.alias("themes_emitted"), more.alias("themes_truncated"), _band(F.col("n")).alias("withheld"), F.array_join(decisions, "; ").alias("decisions"))  # a row each


def _band(n: Column) -> Column:
    return F.when(n == 0, "none").when(n <= 2, "1-2").when(n <= 5, "3-5").otherwise("6+")


def withheld(work: DataFrame, floor: int) -> DataFrame:
    """How many themes stay under the floor, as a band: never which."""
    n = gated(work).groupBy("theme").agg(F.countDistinct("subject_id").alias("s")).agg(F.count_if(F.col("s") < floor).alias("n"))
    return n.select(_band(F.col("n")).alias("band"))


def contributions(spheres: DataFrame, clip: int = 1, vocabulary=C.THEMES) -> DataFrame:
    """(subject_id, position, theme, value): how many of a subject's spheres each declared theme has, clipped, zeros included.

    spheres(subject_id, theme, and gate_mode, sensitivity if known): a row a sphere; only those of :func:`gated` count.
    """
    if clip < 1:
        raise ValueError("clip must be at least 1")
    spark = spheres.sparkSession
    declared = spark.createDataFrame([(i, t) for i, t in enumerate(vocabulary)], "position int, theme string")
    counts = gated(spheres).where("theme is not null").groupBy("subject_id", "theme").agg(F.least(F.count(F.lit(1)), F.lit(clip)).alias("value"))
    grid = spheres.select("subject_id").distinct().crossJoin(F.broadcast(declared))  # a dozen themes
    return grid.join(counts, ["subject_id", "theme"], "left").select("subject_id", "position", "theme", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


#: With how many others a subject agrees on masks, half of them on each side of it in the ring.
PARTNERS = 32


def _hmac(secret: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex, from Spark's own hashes."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(k ^ 0x36 for k in key)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytes(k ^ 0x5C for k in key)), F.unhex(inner)), 256)


def _padded(key: Column, pad: int) -> Column:
    """A key of 32 bytes, given in hex, xored with a pad and filled up to a block of 64."""
    word = lambda i: F.conv(F.substring(key, 1 + 8 * i, 8), 16, 10).cast("long").bitwiseXOR(F.lit(int.from_bytes(bytes([pad]) * 4)))
    return F.concat(F.unhex(F.concat(*(F.lpad(F.hex(word(i)), 8, "0") for i in range(8)))), F.lit(bytes([pad]) * 32))


def mask_stream(seed: Column, width: int) -> list[Column]:
    """The first words (32 bits) of a seed's stream: HMAC-SHA256 of a counter of 8 bytes, with the seed (hex) as key."""
    inner, outer, words = _padded(seed, 0x36), _padded(seed, 0x5C), []
    for block in range(-(-width // 8)):
        digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.lit(block.to_bytes(8))), 256))), 256)
        words += [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(8)]
    return words[:width]


def pair_seed(secret: bytes, round_id: str, one: Column, other: Column) -> Column:
    """What two subjects share in a round, in hex."""
    return _hmac(secret, F.concat_ws("|", F.lit(round_id), F.least(one, other), F.greatest(one, other)))


def _ring(subjects: DataFrame) -> DataFrame:
    """(subject_id, place, n): subjects in a ring by hash, numbered without gathering them in one task."""
    key = F.sha2("subject_id", 256)
    dealt = subjects.withColumn("_h", key).repartitionByRange("_h", "subject_id").sortWithinPartitions("_h", "subject_id")
    marked = written(dealt.select("subject_id", F.monotonically_increasing_id().alias("_at")), "ring")  # the partition, and the row within it
    part = F.shiftright("_at", 33)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))  # a row a partition
    w = Window.partitionBy(F.lit(0)).orderBy("_part")
    starts = sizes.select("_part", (F.sum("_size").over(w) - F.col("_size")).alias("_before"), F.sum("_size").over(Window.partitionBy(F.lit(0))).alias("n"))
    return marked.withColumn("_part", part).join(F.broadcast(starts), "_part").select("subject_id", (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"), "n")


def pairs(subjects: DataFrame, partners: int = PARTNERS) -> DataFrame:
    """(subject_id, other) both ways: who agrees on masks with whom.

    Each subject pairs with half of ``partners`` on each side of it in one ring of
    all, so all are connected, and pairs grow with the subjects. Where the ring has
    no more than partners + 1 subjects these are all pairs there are.
    """
    ring = _ring(subjects.select("subject_id").distinct())
    away = F.sequence(F.lit(1), F.least(F.lit(max(1, partners // 2)), F.expr("cast(n div 2 as int)")))
    ahead = ring.where("n > 1").select("subject_id", "place", "n", F.explode(away).alias("away")).select("subject_id", F.expr("(place + away) % n").alias("place"))
    met = ahead.join(ring.select(F.col("subject_id").alias("other"), "place"), "place")
    once = met.select(F.least("subject_id", "other").alias("a"), F.greatest("subject_id", "other").alias("b")).distinct()  # in a small ring two meet from both sides
    return once.select(F.explode(F.array(F.struct(F.col("a").alias("subject_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("subject_id"), F.col("a").alias("other")))).alias("p")).select("p.*")


def masked(values: DataFrame, secret: bytes, round_id: str, partners: int = PARTNERS, vocabulary=C.THEMES) -> DataFrame:
    """Each value with its subject's masks added, modulo 2^32, and what the round's cohort is: its digest and size.

    Two partners agree on a stream that the lower one adds and the higher one
    subtracts: masks cancel in the sum over the whole cohort and not before, and a
    subject's value shows only if all its partners collude. A cohort of one is refused.
    """
    width = len(vocabulary)
    pair = written(pairs(values, partners), "pairs").withColumn("seed", pair_seed(secret, round_id, F.col("subject_id"), F.col("other")))
    sign = F.when(F.col("subject_id") < F.col("other"), 1).otherwise(-1)
    drawn = pair.select("subject_id", sign.alias("sign"), F.array(*mask_stream(F.col("seed"), width)).alias("words"))
    masks = drawn.groupBy("subject_id").agg(F.array(*(F.sum(F.col("sign") * F.col("words")[i]) for i in range(width))).alias("mask"))
    part = lambda i: F.bit_xor(F.conv(F.substring(F.sha2("subject_id", 256), 1 + 8 * i, 8), 16, 10).cast("long"))
    members = values.select("subject_id").distinct().agg(F.sha2(F.concat_ws("|", part(0), part(1), part(2), part(3), F.count(F.lit(1))), 256).alias("digest"), F.count(F.lit(1)).alias("cohort_size"))
    refused = F.raise_error(F.lit("masking needs at least two cohort members"))
    cohort = members.select(F.substring("digest", 1, 16).alias("cohort_digest"), F.when(F.col("cohort_size") < 2, refused.cast("long")).otherwise(F.col("cohort_size")).alias("cohort_size"))
    rows = values.crossJoin(F.broadcast(cohort)).join(masks, "subject_id", "left")  # one row of the cohort
    return rows.select("subject_id", "position", "theme", F.pmod(F.col("value") + F.get("mask", F.col("position")), F.lit(MODULUS)).alias("masked"), F.lit(round_id).alias("round_id"), "cohort_digest", "cohort_size")


def totals(values: DataFrame) -> DataFrame:
    """Open totals of (position, theme, value)."""
    return values.groupBy("position", "theme").agg(F.sum("value").alias("total")).select("theme", "total")


def secure_sum(contributed: DataFrame, vocabulary=C.THEMES) -> DataFrame:
    """Totals of masked values by theme.

    Refused, within the plan: rows of different rounds or cohorts, a cohort of which
    not all members contributed once, other positions than the vocabulary's; and a
    total over 2^31, which shows that masks didn't cancel.
    """
    seen = contributed.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("positions"), *(f(c).alias(f"{f.__name__}_{c}") for c in ("round_id", "cohort_digest", "cohort_size") for f in (F.min, F.max)))
    checks = seen.agg(
        F.count(F.lit(1)).alias("members"), F.max("max_cohort_size").alias("size"), F.max((F.col("n") != len(vocabulary)) | (F.col("positions") != len(vocabulary))).alias("wide"),
        *(((F.min(f"min_{c}") != F.max(f"max_{c}")).alias(c)) for c in ("round_id", "cohort_digest", "cohort_size")),
    )
    no = F.lit("masks do not cancel: ")
    why = F.coalesce(
        F.when(F.col("round_id"), F.concat(no, F.lit("contributions come from different rounds"))), F.when(F.col("cohort_digest") | F.col("cohort_size"), F.concat(no, F.lit("contributions describe different cohorts"))),
        F.when(F.col("members") != F.col("size"), F.concat(no, F.lit("the cohort is incomplete, "), F.col("members").cast("string"), F.lit(" of "), F.col("size").cast("string"), F.lit(" reported"))),
        F.when(F.col("wide"), F.concat(no, F.lit("contributions don't have the declared vocabulary's positions once each"))),
    )
    out = contributed.groupBy("position", "theme").agg(F.pmod(F.sum("masked"), F.lit(MODULUS)).alias("total"))
    checked = out.crossJoin(F.broadcast(checks.select(why.alias("why"))))  # one row
    wrong = F.coalesce("why", F.when(F.col("total") > 2**31, F.lit("masks do not cancel: the cohort or secrets differ")))
    return checked.select("theme", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("long")).otherwise(F.col("total")).alias("total"))


def check_round(cohort: list[str], round_id: str, contributed: list[str], width: int, vocabulary=C.THEMES) -> None:
    """Refuses a round whose masks can't cancel: a small or repeated cohort, missing or strange members, another width."""
    if len(cohort) < 2 or len(set(cohort)) < len(cohort) or not all(cohort):
        raise ValueError("a cohort is two or more different subjects")
    if not round_id.strip():
        raise ValueError("masks are bound to a round")
    if set(contributed) != set(cohort) or len(contributed) != len(cohort):
        raise ValueError("each member of the cohort contributes once")
    if width != len(vocabulary):
        raise ValueError("contributions don't have the declared vocabulary's width")


def vocabulary_digest(version: str, themes=C.THEMES) -> str:
    """What names a vocabulary: its version and its themes in order."""
    return hashlib.sha256(json.dumps({"v": version, "t": list(themes)}, sort_keys=True).encode()).hexdigest()[:16]


def load_vocabulary(text: str) -> tuple[str, list[tuple[str, str]], str]:
    """(version, [(theme, description)], digest) of a vocabulary in JSON; a mistake fails the load."""
    raw = json.loads(text)
    version, entries = str(raw.get("version") or "").strip(), raw.get("themes")
    if not version or not isinstance(entries, list) or not entries:
        raise ValueError("a vocabulary has a version and themes")
    rows = [(str((x if isinstance(x, dict) else {}).get("id") or "").strip(), str((x if isinstance(x, dict) else {}).get("description") or "").strip()) for x in entries]
    if not all(a and b for a, b in rows) or len({a for a, _ in rows}) < len(rows):
        raise ValueError("each theme has an id of its own and a description")
    return version, rows, vocabulary_digest(version, [a for a, _ in rows])


def synthesize(totals: DataFrame, cohort: Column, floor: int, cap: int = 24, epsilon: float = 0.0) -> DataFrame:
    """totals(theme, total) of a masked round -> themes over the floor, with their share and interval, and how many were withheld, as a band.

    epsilon: noise of scale 1 / epsilon is added to each total before the floor, none by default.
    """
    if floor < 2:
        raise ValueError("a floor under 2 would show single subjects")
    noise = F.udf(lambda: discrete_laplace(1 / epsilon), "long").asNondeterministic()() if epsilon > 0 else F.lit(0)
    rows = totals.select("theme", F.greatest(F.col("total") + noise, F.lit(0)).alias("subjects"), cohort.alias("cohort"))
    below = F.count_if(F.col("subjects") < floor).over(Window.partitionBy(F.lit(0)))  # as many rows as the vocabulary has themes
    band = F.when(below == 0, "none").when(below <= 2, "1-2").when(below <= 5, "3-5").otherwise("6+")
    share = F.least("subjects", "cohort") / F.col("cohort")
    rows = rows.withColumn("withheld", band).where((F.col("subjects") >= floor) & (F.col("cohort") >= floor))
    interval = wilson(F.least("subjects", "cohort"), F.col("cohort"))
    return rows.select("theme", "subjects", F.round(share, 3).alias("share"), interval["low"].alias("low"), interval["high"].alias("high"), "withheld").orderBy(F.desc("subjects"), "theme").limit(cap)


def subjects_seen(events: DataFrame) -> DataFrame:
    """How many subjects there are at all, also those without any work to count."""
    return events.where("trim(subject_id) <> ''").agg(F.countDistinct("subject_id").alias("subjects_seen"))


def wilson(successes: Column, trials: Column, z: float = 1.96) -> Column:
    p = successes / trials
    d = 1 + z**2 / trials
    centre = (p + z**2 / (2 * trials)) / d
    margin = z / d * F.sqrt(p * (1 - p) / trials + z**2 / (4 * trials * trials))
    return F.when(trials > 0, F.struct(F.round(F.greatest(F.lit(0.0), centre - margin), 3).alias("low"), F.round(F.least(F.lit(1.0), centre + margin), 3).alias("high"))).otherwise(F.struct(F.lit(0.0).alias("low"), F.lit(0.0).alias("high")))


def discrete_laplace(scale: float) -> int:
    """Two-sided geometric noise from the system's random source; none for a scale of 0 or less."""
    if scale <= 0:
        return 0

    def geometric() -> int:
        u = (secrets.randbits(53) + 1) / 2**53
        return int(math.floor(-math.log(u) * scale))

    return geometric() - geometric()
