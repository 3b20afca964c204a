"""Runs of attention, interruptions and returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from focusloom.sources.shared import written

GAP_MINUTES, SUBSTANTIVE = 15, 60.0


def cluster_key() -> Column:
    artifact = F.lower(F.trim(F.coalesce("artifact", F.lit(""))))
    return F.when(artifact != "", artifact).otherwise(F.concat(F.lit("app:"), F.lower(F.trim("app"))))


def runs(events: DataFrame, gap_minutes: int = GAP_MINUTES, cluster: Column | None = None) -> DataFrame:
    """Stretches of one cluster whose rows begin less than a gap after all before have ended.

    Windows only: the break test needs the running maximum of the ends.
    """
    rows = events.select("subject_id", "id", "ts_start", "ts_end", "dwell", (cluster if cluster is not None else cluster_key()).alias("cluster"), "artifact", "app")
    w = Window.partitionBy("subject_id").orderBy("ts_start", "id")
    changed = F.coalesce((F.col("cluster") != F.lag("cluster").over(w)).cast("int"), F.lit(1))
    rows = rows.withColumn("_c", changed).withColumn("island", F.sum("_c").over(w))
    inside = Window.partitionBy("subject_id", "island").orderBy("ts_start", "id").rowsBetween(Window.unboundedPreceding, -1)
    late = F.max("ts_end").over(inside)
    new = F.when(late.isNull() | (F.col("ts_start") >= late + F.expr(f"interval {gap_minutes} minutes")), 1).otherwise(0)
    rows = rows.withColumn("_n", new).withColumn("run", F.sum("_n").over(w))
    return rows.groupBy("subject_id", "run").agg(F.first("cluster").alias("cluster"), F.min("ts_start").alias("run_start"), F.max("ts_end").alias("run_end"), F.sum("dwell").cast("double").alias("dwell"), F.count(F.lit(1)).alias("events"))


def returns(found: DataFrame, gap_minutes: int = GAP_MINUTES, substantive: float = SUBSTANTIVE) -> DataFrame:
    """Each run at which work was interrupted and later taken up again, with the first substantive run that does so.

    The last substantive run before an interruption and the next one of its cluster
    are window functions: no run of that cluster can lie between the two.
    """
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    timed = found.select("subject_id", "run", "cluster", "dwell", seconds("run_start").alias("start"), seconds("run_end").alias("end"), (F.col("dwell") >= substantive).alias("real"))
    mine = Window.partitionBy("subject_id", "cluster", "real").orderBy("run")
    after = timed.withColumn("back", F.when(F.col("real"), F.struct("run", "cluster", F.lead("run").over(mine).alias("to"), F.lead("start").over(mine).alias("at"))))
    w = Window.partitionBy("subject_id").orderBy("run")
    anchor = F.last("back", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = after.select("subject_id", "run", "cluster", "start", F.lag("run").over(w).alias("left_run"), F.lag("end").over(w).alias("left_end"), anchor.alias("task")).where("left_run is not null and task.to is not null")
    gap, away = F.lit(gap_minutes * 60.0), F.col("task.at") - F.col("start")
    long = F.col("start") - F.col("left_end") >= gap
    switched = (F.col("task.run") == F.col("left_run")) & (F.col("task.cluster") != F.col("cluster")) & (away >= gap)
    told = F.when(long, F.col("start") - F.col("left_end")).otherwise(F.col("task.at") - F.col("left_end"))
    return rows.where(long | switched).select("subject_id", "run", "left_run", F.col("task.to").alias("back_run"), F.col("task.cluster").alias("cluster"), away.alias("resume_seconds"), told.alias("gap_seconds"))


def _next_beyond(steps: DataFrame) -> DataFrame:
    """hop: the first of a subject's steps after each step's own return. One sorted pass, latest first."""
    ends = steps.select("subject_id", F.col("back_run").alias("at"), F.lit(0).alias("is_step"), F.struct(*steps.columns).alias("step"))
    both = steps.select("subject_id", F.col("run").alias("at"), F.lit(1).alias("is_step"), F.lit(None).cast(ends.schema["step"].dataType).alias("step")).unionByName(ends)
    w = Window.partitionBy("subject_id").orderBy(F.desc("at"), "is_step").rowsBetween(Window.unboundedPreceding, 0)
    hop = F.last(F.when(F.col("is_step") == 1, F.col("at")), ignorenulls=True).over(w)
    return both.withColumn("hop", hop).where("is_step = 0").select("step.*", "hop")


def resume_events(found: DataFrame, gap_minutes: int = GAP_MINUTES, substantive: float = SUBSTANTIVE) -> DataFrame:
    """Interruptions that end in a return. Each return moves the scan on past it, to the next interruption beyond.

    The scan is a path through these pointers. It is marked by doubling them: in
    each round twice as many steps of the path are known, for all subjects at once.
    """
    steps = returns(found, gap_minutes, substantive)
    first = F.min("run").over(Window.partitionBy("subject_id")) == F.col("run")
    told = written(_next_beyond(steps).withColumn("told", first), "returns")
    now = told.select("subject_id", "run", "hop", "told")
    while True:
        reached = now.where("told and hop is not null").select("subject_id", F.col("hop").alias("run"), F.lit(True).alias("met"))
        beyond = now.select("subject_id", F.col("run").alias("hop"), F.col("hop").alias("next"))
        after = now.join(reached, ["subject_id", "run"], "left").join(beyond, ["subject_id", "hop"], "left")
        # two steps can't reach one: a path's pointers all lead ahead, each to another run
        now = written(after.select("subject_id", "run", F.col("next").alias("hop"), (F.col("told") | F.col("met").isNotNull()).alias("told")).distinct(), "returns")
        if not now.where("told and hop is not null").limit(1).count():
            break
    return told.drop("told", "hop").join(now.where("told").select("subject_id", "run"), ["subject_id", "run"]).select("subject_id", "left_run", "back_run", "cluster", "resume_seconds", "gap_seconds")


#: Fractions whose places a distribution tells.
PLACES = {"p25": 0.25, "p75": 0.75, "p90": 0.9, "least": 0.0, "most": 1.0}


def distribution(values: DataFrame, column: str, by: str | None = None, width: float = 1.0) -> DataFrame:
    """n, quartiles, p90, extremes: the value at the half-even rounded place of each fraction.

    Without ``by`` no values give one row with n = 0.

    Equal values are counted, counts are summed over buckets of ``width``, and
    only the buckets that hold a place are looked into: no task gets a group's values.
    """
    group = F.col(by) if by else F.lit(0)
    counts = values.where(F.col(column).isNotNull()).groupBy(group.alias("g"), F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c")).withColumn("b", F.floor(F.col("v") / width))
    every, before = Window.partitionBy("g"), Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy("g", "b").agg(F.sum("c").alias("c")).select("g", "b", "c", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"), F.sum("c").over(every).alias("n"))
    place = lambda f: F.bround(F.lit(f) * (F.col("n") - 1)).cast("long")
    wanted = [(k, place(f)) for k, f in PLACES.items()] + [("low", F.floor((F.col("n") - 1) / 2)), ("high", F.ceil((F.col("n") - 1) / 2))]
    places = buckets.select("g", "b", "c", "before", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), at.alias("at")) for k, at in wanted))).alias("p")).where("p.at >= before and p.at < before + c")
    inside = Window.partitionBy("g", "b", "p.name").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = places.select("g", "b", "before", "n", "p").join(counts, ["g", "b"]).withColumn("to", F.col("before") + F.sum("c").over(inside)).where("p.at < to and p.at >= to - c")
    value = lambda k: F.max(F.when(F.col("p.name") == k, F.col("v")))
    one = values.sparkSession.range(1).select(F.lit(0).alias("g"))
    out = rows.groupBy("g").agg(F.max("n").alias("n"), ((value("low") + value("high")) / 2).alias("median"), *(value(k).alias(k) for k in PLACES))
    if not by:
        out = one.join(out, "g", "left").fillna(0, ["n"])
    return out.select(*([F.col("g").alias(by)] if by else []), "n", "median", *PLACES)


def report(events: DataFrame, found: DataFrame, returns: DataFrame, gap_minutes: int = GAP_MINUTES, substantive: float = SUBSTANTIVE) -> DataFrame:
    """One row per subject: how many returns, over which runs, their delays, and why there are none if so.

    found: :func:`runs` of the events; returns: :func:`resume_events` of found.
    """
    w = Window.partitionBy("subject_id").orderBy("run")
    steps = found.select("subject_id", "dwell", "cluster", (F.col("run_start").cast("timestamp").cast("double") - F.lag(F.col("run_end").cast("timestamp").cast("double")).over(w)).alias("pause"), F.lag("dwell").over(w).alias("left_dwell"), F.lag("cluster").over(w).alias("left"), F.max(F.when(F.col("dwell") >= substantive, 1)).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("anchored"))
    long = F.col("pause") >= gap_minutes * 60.0
    switched = ~long & (F.col("left_dwell") >= substantive) & (F.col("cluster") != F.col("left"))
    seen = steps.groupBy("subject_id").agg(F.count_if(F.col("dwell") >= substantive).alias("substantive_runs"), F.count_if(long | switched).alias("interruptions"), F.count_if((long & (F.col("anchored") == 1)) | switched).alias("with_task"))
    own = events.groupBy("subject_id").agg(F.count(F.lit(1)).alias("events_considered"))
    told = returns.groupBy("subject_id").agg(F.count(F.lit(1)).alias("resume_events"), F.min("resume_seconds").alias("least_seconds"), F.max("resume_seconds").alias("most_seconds"))
    out = own.join(seen, "subject_id", "left").join(told, "subject_id", "left").fillna(0, ["substantive_runs", "interruptions", "with_task", "resume_events"])
    why = F.when(F.col("resume_events") > 0, None).when(F.col("substantive_runs") == 0, "no substantive run").when(F.col("interruptions") == 0, "no interruption").when(F.col("with_task") == 0, "no task to return to").otherwise("never returned")
    return out.withColumn("no_resumes_because", why)
