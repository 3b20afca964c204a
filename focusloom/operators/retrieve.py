"""Attention-weighted lexical retrieval over artifacts, per subject."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from focusloom import config as C
from focusloom.functions.text import query_tokens
from focusloom.operators import profile
from focusloom.operators.overview import artifact_stats


# Fixed value: what a word of a query is.
QUERY_TOKEN = r"[a-zA-Z0-9][a-zA-Z0-9._-]+"


def select_filters(query: str) -> list[str]:
    """Filters that the query's words call for; the default is proportional."""
    low = query.lower()
    return [name for name, cues in C.FILTER_CUES.items() if any(c in low for c in cues)] or ["proportional"]


def content_score(text: Column, query: str) -> Column:
    asked = sorted({t.lower() for t in re.findall(QUERY_TOKEN, query)})
    if not asked:
        return F.lit(1.0)
    tokens, wanted = query_tokens(text), F.array(*map(F.lit, asked))
    overlap = F.size(F.array_intersect(wanted, tokens))
    soft = F.size(F.filter(wanted, lambda q: F.exists(tokens, lambda x: F.contains(x, q))))
    return F.when((overlap > 0) | (soft > 0), F.least(F.lit(1.0), 0.15 + 0.2 * overlap + 0.08 * soft)).otherwise(F.lit(0.15))


def _reasons(names: list[str], value: dict[str, Column], shifted: Column) -> Column:
    # What each filter says of an artifact that it gives weight.
    says = {
        "proportional": F.lit("high dwell time"), "recurrent": F.lit("repeated revisits"), "differential": F.concat(F.lit("recent "), F.col("domain"), F.lit(" attention above baseline")),
        "inverse": F.concat(F.col("domain"), F.lit(" has less recent attention than baseline")), "comparative": F.lit("involved in frequent attention switches"),
        "sequential": F.lit("part of a workflow transition"), "collective": F.lit("single-user stand-in for cohort attention"),
    }
    also = [] if "differential" in names else ["differential"]
    return F.array_compact(F.array(*(F.when((value[n] > 0) & (shifted if n in also else F.lit(True)), F.concat(F.lit(f"{n}: "), says[n])) for n in [*names, *also])))


def retrieve(events: DataFrame, query: str, top_k: int = 5, short_days: int = 5, long_days: int = 14, filters: list[str] | None = None, why: bool = False) -> DataFrame:
    """The top artifacts of each subject by attention x content; with ``why``, the reasons of each.

    Whether the differential filter joins in depends on each subject's own
    divergence, so both weightings are worked out and one is chosen.
    """
    names = filters or select_filters(query)
    stats = artifact_stats(events)
    pairs = events.select("subject_id", "artifact", F.lag("artifact").over(Window.partitionBy("subject_id").orderBy(*profile.ORDER)).alias("p")).where("p is not null and p <> '' and p <> artifact")
    moves = pairs.select("subject_id", F.explode(F.array("p", "artifact")).alias("artifact")).groupBy("subject_id", "artifact").agg(F.count(F.lit(1)).alias("trans"))
    shares = profile.windows(events, short_days, long_days)
    by_domain = shares.select("subject_id", "domain", F.coalesce("short", F.lit(0.0)).alias("recent"), F.coalesce("long", F.lit(0.0)).alias("baseline"))
    kl = profile.divergence(shares)
    w = Window.partitionBy("subject_id")
    norm = lambda c: F.col(c) / F.coalesce(F.nullif(F.max(c).over(w), F.lit(0)), F.lit(1))
    rows = stats.join(moves, ["subject_id", "artifact"], "left").join(by_domain, ["subject_id", "domain"], "left").join(kl, "subject_id", "left")
    rows = rows.fillna(0, ["trans", "recent", "baseline", "kl"]).withColumn("visits_d", F.col("visits").cast("double")).withColumn("trans_d", F.col("trans").cast("double"))
    rows = rows.withColumns({"d": norm("dwell"), "v": norm("visits_d"), "t": norm("trans_d")})
    delta = F.round(F.col("recent") - F.col("baseline"), 4)
    value = {
        "proportional": F.col("d"), "recurrent": F.col("v"), "differential": F.greatest(delta, F.lit(0.0)) * F.col("d"),
        "inverse": F.greatest(F.col("baseline") - F.col("recent"), F.lit(0.0)) * (0.5 + F.col("v") / 2), "comparative": F.col("t"), "sequential": F.col("t") * F.col("d"), "collective": F.col("d"),
    }

    def mixed(chosen: list[str]) -> Column:
        return sum((F.lit(round(1 / len(chosen), 4)) * value[n] for n in chosen), F.lit(0.0))

    four = lambda c: F.floor(F.round(c, 9) * 10_000 + 0.5) / 10_000  # noqa: E731  a double's half goes up, as arithmetic has it and not as it is written
    attention = mixed(names) if "differential" in names else F.when(F.col("kl") > 0.2, mixed([*names, "differential"])).otherwise(mixed(names))
    scored = rows.withColumn("attention", attention).withColumn("content", content_score(F.concat_ws(" ", "artifact", "app", "domain"), query)).withColumn("weight", F.col("attention") * F.col("content")).where("weight > 0")
    rank = F.row_number().over(w.orderBy(F.desc(F.round("weight", 9)), F.desc(F.log1p("dwell")), "first_ord"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top_k).select("subject_id", "rank", "artifact", four("attention").alias("attention_score"), four("content").alias("content_score"), four("weight").alias("weight"), *([_reasons(names, value, F.col("kl") > 0.2).alias("why")] if why else []))
