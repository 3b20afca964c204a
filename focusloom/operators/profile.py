"""Behavioural profiles: shares, transitions, entropy, divergence, rhythm. All per subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-6
ORDER = ("ts_start", "id")


def share(part: Column, whole: Column) -> Column:
    """To four digits; a half is what the quotient times 10,000 comes to, as in SQL, and not what it is written as."""
    return F.when(whole > 0, F.round(part / whole * 10_000) / 10_000).otherwise(F.lit(0.0))


def _double(c: str, over: WindowSpec | None = None) -> Column:
    """A sum of dwells, or that of its window, as a double; decimals are summed as such, whose total no order of rows changes."""
    return (F.sum(c).over(over) if over else F.col(c)).cast("double")


def domain_share(events: DataFrame) -> DataFrame:
    """Dwell and share by domain; the total comes from the aggregated rows."""
    sums = events.groupBy("subject_id", "domain").agg(F.sum("dwell").alias("dwell"))
    return sums.select("subject_id", "domain", _double("dwell").alias("dwell"), share(_double("dwell"), _double("dwell", Window.partitionBy("subject_id"))).alias("share"))


def transitions(events: DataFrame, column: str = "domain") -> DataFrame:
    """Counts of changes from one value to the next."""
    previous = F.lag(column).over(Window.partitionBy("subject_id").orderBy(*ORDER))
    steps = events.select("subject_id", previous.alias("source"), F.col(column).alias("target"))
    return steps.where("source is not null and source <> '' and source <> target").groupBy("subject_id", "source", "target").agg(F.count(F.lit(1)).alias("n"))


def transition_entropy(events: DataFrame) -> DataFrame:
    counts = transitions(events)
    p = F.col("n") / F.sum("n").over(Window.partitionBy("subject_id"))
    return counts.withColumn("p", p).groupBy("subject_id").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 4).alias("entropy"))


def revisit_rate(events: DataFrame) -> DataFrame:
    by = events.groupBy("subject_id", "artifact").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("subject_id").agg(F.round(F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)) / F.sum("n"), 4).alias("revisit_rate"), F.sum("n").alias("events"))


def hour_histogram(events: DataFrame) -> DataFrame:
    return events.groupBy("subject_id", F.hour("ts_start").alias("hour")).agg(F.count(F.lit(1)).alias("events"))


def windows(events: DataFrame, short_days: int, long_days: int) -> DataFrame:
    """Dwell by domain in the windows that end with each subject's last event (null: no row there)."""
    last = events.groupBy("subject_id").agg(F.max("ts_start").alias("anchor"))
    rows = events.join(last, "subject_id").where(F.col("ts_start") >= F.col("anchor") - F.expr(f"interval {long_days} days"))
    in_short = F.col("ts_start") >= F.col("anchor") - F.expr(f"interval {short_days} days")
    sums = rows.groupBy("subject_id", "domain").agg(F.sum(F.when(in_short, F.col("dwell"))).alias("s"), F.sum("dwell").alias("l"))
    w = Window.partitionBy("subject_id")
    p = F.when(F.col("s").isNotNull(), share(_double("s"), _double("s", w)))
    return sums.select("subject_id", "domain", p.alias("short"), share(_double("l"), _double("l", w)).alias("long"))


def divergence(shares: DataFrame) -> DataFrame:
    """KL divergence of the short from the long window, natural log."""
    p, q = F.coalesce("short", F.lit(EPS)), F.coalesce("long", F.lit(EPS))
    return shares.groupBy("subject_id").agg(F.round(F.sum(p * F.log((p + EPS) / (q + EPS))), 4).alias("kl"))


def domain_delta(shares: DataFrame) -> DataFrame:
    return shares.select("subject_id", "domain", F.round(F.coalesce("short", F.lit(0.0)) - F.coalesce("long", F.lit(0.0)), 4).alias("delta"))


def signature(events: DataFrame, short_days: int = 5, long_days: int = 14) -> DataFrame:
    """One row per subject: rhythm, divergence and owned domains of its long window."""
    last = events.groupBy("subject_id").agg(F.max("ts_start").alias("anchor"))
    rows = events.join(last, "subject_id").where(F.col("ts_start") >= F.col("anchor") - F.expr(f"interval {long_days} days"))
    shares = windows(events, short_days, long_days)
    rhythm = rows.groupBy("subject_id").agg(F.count(F.lit(1)).alias("events"), F.round(F.round(F.avg(F.col("dwell").cast("double")), 9), 2).alias("mean_dwell"), F.round(F.round(F.median(F.col("dwell").cast("double")), 9), 2).alias("median_dwell"))
    owned = shares.where("long >= 0.15").withColumn("k", F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc("long"), "domain"))).where("k <= 5")
    owned = owned.groupBy("subject_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "domain"))), lambda x: x["domain"]), ",").alias("owned_domains"))
    out = rhythm.join(revisit_rate(rows).drop("events"), "subject_id").join(transition_entropy(rows), "subject_id", "left").join(divergence(shares), "subject_id").join(owned, "subject_id", "left")
    return out.select("subject_id", "events", "mean_dwell", "median_dwell", "revisit_rate", F.coalesce("entropy", F.lit(0.0)).alias("entropy"), "kl", F.coalesce("owned_domains", F.lit("")).alias("owned_domains"))


def rolling(events: DataFrame, short_days: int = 5, long_days: int = 14) -> DataFrame:
    """The profile of each subject at each day on which it was active, over the short and the long window that end with that day.

    Days are aggregated once, by domain and by change of domain; windows are sums of
    days. So an event is read once however many windows it is in, and what is kept
    grows with a subject's days and domains.
    """
    day = F.to_date("ts_start")
    number = F.datediff(F.col("day"), F.lit("1970-01-01").cast("date"))
    by_day = events.groupBy("subject_id", day.alias("day"), "domain").agg(F.sum("dwell").alias("dwell"), F.count(F.lit(1)).alias("n"))
    active = by_day.select("subject_id", "day").distinct()

    def summed(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
        """For each active day and key of a subject: the sums over both windows."""
        own = rows.select("subject_id", *keys).distinct()
        grid = active.join(own, "subject_id").join(rows, ["subject_id", "day", *keys], "left").withColumn("k", number)
        w = Window.partitionBy("subject_id", *keys).orderBy("k")
        over = {f"{v}_{name}": F.coalesce(F.sum(v).over(w.rangeBetween(1 - days, 0)), F.lit(0)) for v in values for name, days in (("short", short_days), ("long", long_days))}
        return grid.select("subject_id", "day", *keys, *(c.alias(name) for name, c in over.items()))

    whole = Window.partitionBy("subject_id", "day")
    told = summed(by_day, ["domain"], ["dwell", "n"]).where("n_long > 0")
    of = lambda name: share(F.col(f"dwell_{name}").cast("double"), F.sum(f"dwell_{name}").over(whole).cast("double"))
    shares = told.select("*", F.when(F.col("n_short") > 0, of("short")).alias("short"), of("long").alias("long"))
    p, q = F.coalesce("short", F.lit(EPS)), F.col("long")
    owned = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("long") >= 0.15, F.struct((-F.col("long")).alias("less"), "domain")))), 1, 5), lambda x: x["domain"])
    days = shares.groupBy("subject_id", "day").agg(
        F.sum("n_long").alias("events"), F.round(F.sum("dwell_long").cast("double") / F.sum("n_long") + F.lit(1e-9), 2).alias("mean_dwell"), (F.round(F.sum(p * F.log((p + EPS) / (q + EPS))), 4) + F.lit(0.0)).alias("kl"), F.array_join(owned, ",").alias("owned_domains")
    )
    previous = F.lag("domain").over(Window.partitionBy("subject_id").orderBy(*ORDER))
    steps = events.select("subject_id", day.alias("day"), previous.alias("source"), F.col("domain").alias("target")).where("source is not null and source <> '' and source <> target")
    moves = summed(steps.groupBy("subject_id", "day", "source", "target").agg(F.count(F.lit(1)).alias("c")), ["source", "target"], ["c"]).where("c_long > 0")
    part = F.col("c_long") / F.sum("c_long").over(whole)
    entropy = moves.withColumn("p", part).groupBy("subject_id", "day").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 4).alias("entropy"))
    return days.join(entropy, ["subject_id", "day"], "left").select("subject_id", "day", "events", "mean_dwell", (F.coalesce("entropy", F.lit(0.0)) + F.lit(0.0)).alias("entropy"), "kl", "owned_domains")
