"""Streaming: redacting ingest of raw samples, hourly aggregates with late data, stateful spheres."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from focusloom.config import Config
from focusloom.functions.text import classify_domain, is_ignored, redact, scrub_title
from focusloom.operators.resume import runs
from focusloom.operators.spheres import ASSIGNED, Assigner

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RAW = "id bigint, subject_id string, app string, title string, ts_start timestamp, ts_end timestamp, dwell double"


def prepare(raw: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Raw samples -> events: classified, scrubbed and redacted before anything is written."""
    rows = raw.withColumn("domain", F.when(is_ignored(F.col("app"), cfg.ignored_apps), "system").otherwise(classify_domain(F.col("app"), F.col("title"), cfg.domain_rules)))
    rows = rows.withColumn("action", F.when(F.col("domain") == "system", "system").otherwise("focus")).withColumn("title", scrub_title(F.col("title"), cfg))
    return redact(rows, "title", cfg).withColumn("artifact", F.col("title"))


def start(raw: DataFrame, path: str, checkpoint: str, cfg: Config = Config(), once: bool = False, every: str = "15 seconds"):
    """Appends the prepared stream to a table, by day."""
    writer = prepare(raw, cfg).withColumn("event_date", F.to_date("ts_start")).writeStream.format("parquet").partitionBy("event_date").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start(path)


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Dwell by hour and domain; rows later than the watermark are left out."""
    return events.withWatermark("ts_start", late).groupBy(F.window("ts_start", "1 hour"), "domain").agg(F.sum("dwell").alias("dwell"), F.count(F.lit(1)).alias("events"))


_SESSION = "subject_id string, start long, end long, dwell double, events long"


class _Sessions(StatefulProcessor):
    """One subject: the session that is open, and the rows that the watermark hasn't passed yet.

    Rows are taken in order of time once nothing earlier can come. A session is told,
    and forgotten, when the watermark is a gap past the latest end in it. So what is
    kept is bounded by the rows of the time allowed for lateness.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "start long, end long, dwell double")
        self.open = handle.getValueState("open", "start long, end long, dwell double, events long")

    def handleInputRows(self, key, rows, timerValues):
        came = [tuple(r) for frame in rows for r in zip(*(frame[c].tolist() for c in ("start", "end", "dwell")))]
        yield self._advance(key, came, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._advance(key, [], timerValues)

    def _advance(self, key, came: list, timerValues) -> pd.DataFrame:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted([tuple(r) for r in self.pending.get()] + came)
        own = tuple(self.open.get()) if self.open.exists() else None
        told = []
        for start, end, dwell in (r for r in rows if r[0] <= now):
            if own and start >= own[1] + self.gap:
                told.append((*key, *own))
                own = None
            own = (own[0], max(own[1], end), own[2] + dwell, own[3] + 1) if own else (start, end, dwell, 1)
        if own and now >= own[1] + self.gap:
            told.append((*key, *own))
            own = None
        left = [r for r in rows if r[0] > now]
        if own:
            self.open.update(own)
        elif self.open.exists():
            self.open.clear()
        if left:
            self.pending.put(left)
        else:
            self.pending.clear()
        due = [left[0][0]] if left else []
        due += [own[1] + self.gap] if own else []
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if due:
            self.handle.registerTimer(-(-min(due) // 1000))
        return pd.DataFrame(told, columns=["subject_id", "start", "end", "dwell", "events"])

    def close(self) -> None:
        pass


def sessions(events: DataFrame, gap_minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """Stretches of a subject's events, each of which begins less than the gap after all before have ended.

    The same for batches and streams; a stream leaves out rows later than the
    watermark, tells a session when no more can join, and needs the state store of RocksDB.
    """
    if not events.isStreaming:
        found = runs(events, gap_minutes, F.lit(""))
        return found.select("subject_id", F.col("run_start").alias("session_start"), F.col("run_end").alias("session_end"), "dwell", "events")
    spark, kind = events.sparkSession, events.schema["ts_start"].dataType
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    timed = events.select("subject_id", F.col("ts_start").cast("timestamp").alias("_at"), micros("ts_start").alias("start"), F.coalesce(micros("ts_end"), micros("ts_start")).alias("end"), F.coalesce(F.col("dwell").cast("double"), F.lit(0.0)).alias("dwell"))
    out = timed.withWatermark("_at", late).groupBy("subject_id").transformWithStateInPandas(_Sessions(gap_minutes * 60_000_000), _SESSION, "append", "EventTime")
    time = lambda c: F.timestamp_micros(c).cast(kind)
    return out.select("subject_id", time("start").alias("session_start"), time("end").alias("session_end"), "dwell", "events")


def assign_spheres(features: DataFrame, cfg: Config = Config(), keep_days: int | None = None, late: str = "1 hour") -> DataFrame:
    """The batch assignment kept as state for each subject; rows of later triggers must be later.

    With ``keep_days`` a subject's spheres are forgotten after so many days without
    events: at its next event, however triggers fall, or when the watermark passes.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pickle

        if state.hasTimedOut:
            state.remove()
            return
        own = pickle.loads(state.get[0]) if state.exists else None
        rows = []
        # a subject's rows of one trigger can come in several frames
        for r in pd.concat(list(frames)).sort_values(["ts_start", "id"]).itertuples():
            if own is None or (keep_days is not None and own.ended is not None and r.ts_start - own.ended > pd.Timedelta(days=keep_days)):
                own = Assigner(cfg.session_gap_minutes, cfg.match_threshold)
            rows.append((r.id, r.subject_id, *own.assign(r)))
        state.update((pickle.dumps(own),))
        if keep_days is not None:
            ends = (pd.Timestamp(own.ended) + pd.Timedelta(days=keep_days)).timestamp()
            state.setTimeoutTimestamp(max(int(ends * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["id", "subject_id", "sphere_ordinal", "sphere_id", "score"])

    timeout = GroupStateTimeout.NoTimeout
    if keep_days is not None:
        timeout = GroupStateTimeout.EventTimeTimeout
        features = features.withColumn("_at", F.col("ts_start").cast("timestamp")).withWatermark("_at", late)
    return features.groupBy("subject_id").applyInPandasWithState(step, ASSIGNED, "state binary", "append", timeout)
