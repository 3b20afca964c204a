"""A typed property graph of each subject's context: two DataFrames, nodes and edges.

Tables may tell what redaction found (findings, a map of counts) and what a
connector read (structured, with status and fields): both become nodes of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from focusloom import config as C
from focusloom.functions.text import gate_for_label, graph_task, lookup, stable_id, time_bucket
from focusloom.operators.overview import without_system
from focusloom.operators.profile import ORDER

MODES = ("allowed", "masked", "generalized", "withheld")
#: What an event names itself, in the order in which its nodes are made.
OWN = ("app", "domain", "artifact", "task", "time")


def _label(column: str, fallback: str) -> Column:
    text = F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return F.when(text == "", fallback).otherwise(text)


def _parts(events: DataFrame, cfg: C.Config = C.Config()) -> DataFrame:
    """An event's own labels, those of the subject's event before, what was found in it and what a connector read."""
    rows = events if cfg.graph_system_events else without_system(events)
    fields = F.when(F.col("structured.status") == "captured", F.col("structured.fields")) if "structured" in events.columns else F.lit(None)
    findings = F.col("findings") if "findings" in events.columns else F.lit(None)
    artifact, domain = _label("artifact", "untitled artifact"), _label("domain", "other")
    rows = rows.select(
        "subject_id", *ORDER, F.coalesce("dwell", F.lit(0)).alias("dwell"), domain.alias("domain"), _label("app", "unknown app").alias("app"), artifact.alias("artifact"), graph_task(F.col("domain"), artifact, artifact).alias("task"), time_bucket(F.col("ts_start")).alias("time"),
        F.filter(F.map_entries(fields.cast("map<string,string>")), lambda f: F.coalesce(f["value"], F.lit("")) != "").alias("fields"), F.filter(F.map_entries(findings.cast("map<string,int>")), lambda f: f["value"] > 0).alias("found"),
    )
    gate = gate_for_label(F.col("artifact"), F.coalesce(F.size("found") > 0, F.lit(False)))
    w = Window.partitionBy("subject_id").orderBy(*ORDER)
    return rows.withColumn("gate", gate).withColumn("prev_domain", F.lag("domain").over(w)).withColumn("prev_artifact", F.lag("artifact").over(w))


def _field_label(f: Column) -> Column:
    return F.concat(f["key"], F.lit(": "), f["value"])


def _signal_label(f: Column) -> Column:
    return F.coalesce(*(F.when(f["key"] == k, v) for k, v in C.PRIVATE_SIGNALS.items()), F.concat(F.lit("masked "), F.replace(f["key"], F.lit("_"), F.lit(" "))))


def _first_gate(at: Column) -> list[Column]:
    """The gate of the first event that wasn't let through as it is; else the first one's."""
    closed = F.when(F.col("mode") != "allowed", at)
    return [F.coalesce(F.min_by("mode", closed), F.lit("allowed")).alias("gate_mode"), F.coalesce(F.min_by("sensitivity", closed), F.lit("low")).alias("sensitivity")]


def all_nodes(events: DataFrame, cfg: C.Config = C.Config()) -> DataFrame:
    """All nodes of each subject, merged by type and lower-cased label, with their score and when they were first seen."""

    def one(kind, label, mode="allowed", sensitivity="low", events_=1, dwell=None):
        value = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(F.lit(kind).alias("type"), value(label).alias("label"), value(mode).alias("mode"), value(sensitivity).alias("sensitivity"), value(events_).cast("long").alias("w"), (F.col("dwell") if dwell is None else F.lit(dwell)).cast("decimal(28,2)").alias("d"))

    own = [one(k, F.col(k), F.col("gate.mode") if k == "artifact" else "allowed", F.col("gate.sensitivity") if k == "artifact" else "low") for k in OWN]
    none = F.array().cast("array<struct<type:string,label:string,mode:string,sensitivity:string,w:bigint,d:decimal(28,2)>>")
    read = F.coalesce(F.transform("fields", lambda f: one("connector-field", _field_label(f), dwell=0)), none)
    hidden = F.coalesce(F.transform("found", lambda f: one("private-signal", _signal_label(f), "masked", "high", f["value"], 0)), none)
    made = F.concat(F.array(one("subject", "you", "generalized"), *own), read, hidden)
    rows = _parts(events, cfg).select("subject_id", *ORDER, F.posexplode(made).alias("at", "n")).select("subject_id", *ORDER, "at", "n.*")
    at = F.struct(*ORDER, "at")
    out = rows.groupBy("subject_id", "type", F.lower("label").alias("key")).agg(F.min_by("label", at).alias("label"), F.sum("w").alias("events"), F.sum("d").cast("double").alias("dwell"), *_first_gate(at), F.min(at).alias("first"))
    ids = F.concat(F.col("type"), F.lit(":"), F.substring(F.sha1(F.concat(F.col("type"), F.lit(":"), F.col("key"))), 1, 12))
    priority = lookup(F.col("type"), {k: str(v) for k, v in C.TYPE_PRIORITY.items()}, "1").cast("int")
    return out.select("subject_id", ids.alias("node_id"), "type", "label", "events", F.round("dwell", 2).alias("dwell"), "gate_mode", "sensitivity", (F.col("dwell") + 5.0 * F.col("events") + 120.0 * priority).alias("score"), "first")


def _top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each subject; Spark cuts each task's rows to k before it shuffles them."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("subject_id").orderBy(*order))).where(F.col("rank") <= k)


def nodes(events: DataFrame, max_nodes: int = C.Config.max_nodes, cfg: C.Config = C.Config()) -> DataFrame:
    """Each subject's heaviest nodes, itself first; of equal ones those seen first."""
    return _top(all_nodes(events, cfg), max_nodes, (F.col("type") == "subject").desc(), F.desc("score"), F.col("first")).drop("first")


def all_edges(events: DataFrame, cfg: C.Config = C.Config()) -> DataFrame:
    """All edges of each subject between merged nodes; loops are dropped."""

    def one(relation, a, b, mode="allowed", dwell=None, when=None):
        value = F.struct(F.lit(relation).alias("relation"), a.alias("source"), b.alias("target"), (mode if isinstance(mode, Column) else F.lit(mode)).alias("mode"), (F.col("dwell") if dwell is None else F.lit(dwell)).cast("decimal(28,2)").alias("d"))
        return value if when is None else F.when(when, value)

    # ids are worked out once a row, not once an edge
    rows = _parts(events, cfg).withColumns({f"n_{k}": stable_id(k, F.col(k)) for k in OWN} | {"n_before": stable_id("domain", F.col("prev_domain")), "n_last": stable_id("artifact", F.col("prev_artifact"))})
    n = {k: F.col(f"n_{k}") for k in OWN}
    gate = F.col("gate.mode")
    there = F.col("prev_domain").isNotNull()
    own = F.array_compact(F.array(
        one("focused_in", stable_id("subject", F.lit("you")), n["domain"]), one("worked_through", n["domain"], n["app"]), one("opened", n["app"], n["artifact"], gate), one("suggests_task", n["artifact"], n["task"], gate),
        one("observed", n["time"], n["domain"]), one("transitioned_to", F.col("n_before"), n["domain"], when=there), one("next_context", F.col("n_last"), n["artifact"], when=there),
    ))
    none = F.array().cast("array<struct<relation:string,source:string,target:string,mode:string,d:decimal(28,2)>>")
    read = F.coalesce(F.transform("fields", lambda f: one("described_by", n["artifact"], stable_id("connector-field", _field_label(f)), dwell=0)), none)
    hidden = F.coalesce(F.transform("found", lambda f: one("redacted_from", n["artifact"], stable_id("private-signal", _signal_label(f)), "masked", 0)), none)
    made = rows.select("subject_id", *ORDER, F.posexplode(F.concat(own, read, hidden)).alias("at", "e")).select("subject_id", *ORDER, "at", "e.*", F.lit("low").alias("sensitivity")).where("source <> target")
    at = F.struct(*ORDER, "at")
    out = made.groupBy("subject_id", "source", "relation", "target").agg(F.count(F.lit(1)).alias("events"), F.sum("d").cast("double").alias("d"), _first_gate(at)[0], F.min(at).alias("first"))
    return out.select("subject_id", "source", "relation", "target", "events", F.round("d", 2).alias("dwell"), "gate_mode", (F.col("d") + 4.0 * F.col("events")).alias("score"), "first")


def _between(events: DataFrame, max_nodes: int, cfg: C.Config) -> DataFrame:
    kept = nodes(events, max_nodes, cfg)
    end = lambda name: kept.select("subject_id", F.col("node_id").alias(name), F.col("label").alias(f"{name}_label"))
    return all_edges(events, cfg).join(end("source"), ["subject_id", "source"]).join(end("target"), ["subject_id", "target"])


def edges(events: DataFrame, max_edges: int = C.Config.max_edges, max_nodes: int = C.Config.max_nodes, cfg: C.Config = C.Config()) -> DataFrame:
    """Each subject's heaviest edges between its selected nodes; of equal ones those seen first."""
    out = _top(_between(events, max_nodes, cfg), max_edges, F.desc("score"), F.col("first"))
    return out.select("subject_id", "rank", "source", "relation", "target", "events", "dwell", "gate_mode", "score")


def relationships(events: DataFrame, k: int = 14, cfg: C.Config = C.Config()) -> DataFrame:
    """Each subject's heaviest edges between selected nodes, with their labels."""
    out = _top(_between(events, cfg.max_nodes, cfg), k, F.desc("score"), F.col("first"))
    return out.select("subject_id", "rank", "source_label", "relation", "target_label", "events", "dwell", "gate_mode")


def gates(events: DataFrame, max_nodes: int = C.Config.max_nodes, cfg: C.Config = C.Config()) -> DataFrame:
    """How many of each subject's nodes are shown by gate, and how many are withheld for want of room."""
    made = all_nodes(events, cfg)
    total = made.groupBy("subject_id").agg(F.count(F.lit(1)).alias("total"))
    shown = _top(made, max_nodes, (F.col("type") == "subject").desc(), F.desc("score"), F.col("first")).groupBy("subject_id").agg(*(F.count_if(F.col("gate_mode") == m).alias(m) for m in MODES), F.count(F.lit(1)).alias("shown"))
    return total.join(shown, "subject_id").select("subject_id", *MODES[:3], (F.col("withheld") + F.col("total") - F.col("shown")).alias("withheld"))
