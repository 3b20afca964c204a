"""Working spheres: order-dependent grouping of a subject's events into activities, and what follows from it."""

from __future__ import annotations

import hashlib
from datetime import timedelta
from itertools import combinations
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from focusloom import config as C
from focusloom.functions.text import gate_for_event, normalize_artifact, shorten, sphere_task, sphere_tokens
from focusloom.operators.overview import without_system
from focusloom.schema import AS_OF, as_of_column
from focusloom.sources.shared import written

ASSIGNED = "id long, subject_id string, sphere_ordinal int, sphere_id string, score double"
TOP_TOKENS = 18
#: How many apps, artifacts and keywords of a sphere its report names.
APPS, ARTIFACTS, KEYWORDS = 4, 5, 6


def features(events: DataFrame) -> DataFrame:
    """What the assignment reads: task, normalised artifact and tokens, worked out in the JVM."""
    return without_system(events).select(
        "id", "subject_id", "ts_start", "ts_end", "domain", "app", sphere_task(F.col("domain"), F.col("artifact"), F.col("artifact")).alias("task"), normalize_artifact(F.col("artifact")).alias("norm"), sphere_tokens(F.col("artifact")).alias("tokens")
    )


def findings_of(events: DataFrame) -> Column:
    """What redaction found in a row and how often; nothing where the table doesn't tell."""
    nothing = F.expr("cast(map() as map<string,int>)")
    return F.coalesce(F.col("findings"), nothing) if "findings" in events.columns else nothing


class Event(NamedTuple):
    """What the assignment reads of an event."""

    subject_id: str
    ts_start: object
    ts_end: object
    domain: str
    app: str
    task: str
    norm: str
    tokens: list


class Sphere:
    """One open activity. Its top tokens are those of most events; of equal ones those seen first."""

    __slots__ = ("ordinal", "sphere_id", "domains", "apps", "tasks", "norms", "counts", "seen", "top")

    def __init__(self, ordinal: int, sphere_id: str):
        self.ordinal, self.sphere_id = ordinal, sphere_id
        self.domains, self.apps, self.tasks, self.norms = set(), set(), set(), set()
        self.counts: dict[str, int] = {}
        self.seen: dict[str, int] = {}
        self.top: set[str] = set()

    def _place(self, token: str) -> tuple[int, int]:
        return self.counts[token], -self.seen[token]

    def add(self, row, tokens: list) -> tuple[set, set]:
        """Takes an event in; tells which tokens came into the top and which left it."""
        self.domains.add(row.domain)
        self.apps.add(row.app)
        self.tasks.add(row.task)
        if row.norm:
            self.norms.add(row.norm)
        before = set(self.top)
        for t in tokens:
            self.seen.setdefault(t, len(self.seen))
            self.counts[t] = self.counts.get(t, 0) + 1
        for t in tokens:  # counts only grow, so nothing else can come into the top
            if t not in self.top:
                self.top.add(t)
                if len(self.top) > TOP_TOKENS:
                    self.top.remove(min(self.top, key=self._place))
        return self.top - before, before - self.top

    def score(self, row, tokens: set, continuing: bool) -> float:
        same = row.norm != "" and row.norm in self.norms
        shared = len(tokens & self.top)
        if not same and shared < 2:
            return 0.0
        total = 0.18 * (row.domain in self.domains) + 0.12 * (row.app in self.apps) + 0.13 * (row.task in self.tasks) + 0.46 * same
        if tokens and self.top:
            total += min(0.48, 0.72 * (shared / len(tokens | self.top)))
            total += 0.08 * (shared >= 2)
        return round(min(total + 0.16 * continuing, 1.0), 4)


class Assigner:
    """State of one subject; rows come in order of time. Used by the batch and the streaming form alike.

    A sphere can only take an event whose artifact it has had or of whose tokens
    two are among its top ones. Posting lists, from artifacts and from pairs of top
    tokens to spheres, give just these; all others score nothing.
    """

    def __init__(self, gap_minutes: int, threshold: float):
        self.gap = timedelta(seconds=max(300, gap_minutes * 60))
        self.threshold = threshold
        self.spheres: list[Sphere] = []
        self.by_norm: dict[str, set[int]] = {}
        self.by_pair: dict[tuple[str, str], set[int]] = {}
        self.before: Sphere | None = None
        self.ended = None
        self.segment = 0
        self.opens = True

    def candidates(self, row, tokens) -> list[Sphere]:
        found = set(self.by_norm.get(row.norm, ())) if row.norm else set()
        for pair in combinations(sorted(tokens), 2):
            found |= self.by_pair.get(pair, set())
        return [self.spheres[k] for k in sorted(found)]

    def assign(self, row) -> tuple[int, str, float]:
        ordered = list(dict.fromkeys(row.tokens))
        tokens = set(ordered)
        near = self.ended is not None and row.ts_start - self.ended <= self.gap
        best, score = None, 0.0
        for s in self.candidates(row, tokens):
            x = s.score(row, tokens, near and s.sphere_id == self.before.sphere_id)
            if x > score:
                best, score = s, x
        if best is None or score < self.threshold:
            seed = "|".join((row.domain or "", row.app or "", row.task, row.norm[:80], "-".join(sorted(tokens)[:5]), row.subject_id or "")).lower()
            best, score = Sphere(len(self.spheres), f"sphere:{hashlib.sha1(seed.encode()).hexdigest()[:12]}"), 0.52
            self.spheres.append(best)
        self._post(best, row, ordered)
        self.opens = not near or self.before.sphere_id != best.sphere_id
        self.segment += self.opens
        self.before, self.ended = best, row.ts_end
        return best.ordinal, best.sphere_id, score

    def _post(self, sphere: Sphere, row, tokens: list) -> None:
        came, left = sphere.add(row, tokens)
        if row.norm:
            self.by_norm.setdefault(row.norm, set()).add(sphere.ordinal)
        stayed = (sphere.top | left) - came
        for token, others in ((t, stayed - {t}) for t in left):
            for other in others:
                at = self.by_pair.get((min(token, other), max(token, other)))
                if at:
                    at.discard(sphere.ordinal)
        for token in came:
            for other in sphere.top:
                if other != token:
                    self.by_pair.setdefault((min(token, other), max(token, other)), set()).add(sphere.ordinal)


def assigned_once(events: DataFrame, cfg: C.Config = C.Config()) -> DataFrame:
    """The assignment, written once: what follows from it reads it more than once."""
    return written(assign(events, cfg, carry=True), "spheres")


def assign(events: DataFrame, cfg: C.Config = C.Config(), carry: bool = False) -> DataFrame:
    """(id, subject_id, sphere_ordinal, sphere_id, score): sequential for a subject, parallel over subjects.

    Subjects' rows stream by in order: a task holds one subject's spheres, never its
    events. With ``carry`` the columns that reports need come along, and segment and
    opens: the number of the stretch an event is in, and whether it begins it.
    """
    rows = without_system(events)
    title = F.col("artifact")
    row = rows.select(
        "id", "subject_id", "ts_start", "ts_end", "domain", "app", sphere_task(F.col("domain"), title, title).alias("task"), normalize_artifact(title).alias("norm"), F.coalesce(sphere_tokens(title), F.array().cast("array<string>")).alias("tokens"),
        *(["dwell", "artifact", findings_of(rows).alias("findings")] if carry else []),
    )
    if carry:
        row = row.withColumn("gate", gate_for_event(title, title, F.size("findings") > 0, F.col("findings")))
    row = row.withColumn("norm", F.coalesce("norm", F.lit("")))
    names = row.columns
    read = [names.index(c) for c in Event._fields]

    def stream(batches):
        state, subject = None, None
        for batch in batches:
            made: list[tuple] = []
            for event in map(Event, *(batch.column(k).to_pylist() for k in read)):
                if state is None or event.subject_id != subject:
                    state, subject = Assigner(cfg.session_gap_minutes, cfg.match_threshold), event.subject_id
                made.append((*state.assign(event), state.segment, state.opens))
            new = [pa.array(c, t) for c, t in zip(zip(*made) if made else [()] * 5, (pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*names, "sphere_ordinal", "sphere_id", "score", "segment", "opens"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in row.schema) + ", sphere_ordinal int, sphere_id string, score double, segment int, opens boolean"
    out = row.repartition("subject_id").sortWithinPartitions("subject_id", "ts_start", "id").mapInArrow(stream, schema)
    return out if carry else out.select("id", "subject_id", "sphere_ordinal", "sphere_id", "score")


def segments(events: DataFrame, assigned: DataFrame, gap_minutes: int = C.Config.session_gap_minutes) -> DataFrame:
    """Stretches of one sphere with no pause longer than the session gap."""
    rows = without_system(events).join(assigned.select("id", "sphere_id"), "id")
    w = Window.partitionBy("subject_id").orderBy("ts_start", "id")
    pause = F.col("ts_start") > F.lag("ts_end").over(w) + F.expr(f"interval {max(5, gap_minutes)} minutes")
    rows = rows.withColumn("_n", F.coalesce(((F.lag("sphere_id").over(w) != F.col("sphere_id")) | pause).cast("int"), F.lit(1))).withColumn("segment", F.sum("_n").over(w))
    # by app first, within the subject's partition: no shuffle more
    by_app = rows.groupBy("subject_id", "segment", "app").agg(F.first("sphere_id").alias("sphere_id"), F.min("ts_start").alias("s"), F.max("ts_end").alias("e"), F.count(F.lit(1)).alias("n"), F.sum("dwell").alias("d"), F.min(F.struct("ts_start", "id")).alias("f"))
    return by_app.groupBy("subject_id", "segment").agg(
        F.first("sphere_id").alias("sphere_id"), F.min("s").alias("seg_start"), F.max("e").alias("seg_end"), F.sum("n").alias("events"), F.sum("d").cast("double").alias("dwell"), F.min_by("app", F.struct(-F.col("n"), "f")).alias("top_app")
    )


def transitions(events: DataFrame, assigned: DataFrame, cap: int = 12) -> DataFrame:
    """Moves from one sphere to another, the most frequent ones of each subject, with when they were last seen."""
    rows = without_system(events).join(assigned.select("id", "sphere_id"), "id")
    w = Window.partitionBy("subject_id").orderBy("ts_start", "id")
    moved = rows.select("subject_id", F.lag("sphere_id").over(w).alias("source"), F.col("sphere_id").alias("target"), "ts_start", "id").where("source <> target")
    by = moved.groupBy("subject_id", "source", "target").agg(F.count(F.lit(1)).alias("count"), F.max("ts_start").alias("last_seen"), F.min(F.struct("ts_start", "id")).alias("first"))
    k = F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc("count"), "first"))
    return by.withColumn("rank", k).where(F.col("rank") <= cap).drop("first")


def recent_events(events: DataFrame, assigned: DataFrame, n: int = 8) -> DataFrame:
    """The last n events of each sphere, latest first."""
    rows = without_system(events).join(assigned.select("id", "sphere_id"), "id")
    k = F.row_number().over(Window.partitionBy("subject_id", "sphere_id").orderBy(F.desc("ts_start"), F.desc("id")))
    return rows.withColumn("rank", k).where(F.col("rank") <= n).select("subject_id", "sphere_id", "rank", "id", "artifact", "app", "ts_end")


def timeline(stretches: DataFrame, selected: DataFrame, cap: int = 20) -> DataFrame:
    """Segments of the selected spheres with their labels, latest first. selected: subject_id, sphere_id, label."""
    rows = stretches.join(selected.select("subject_id", "sphere_id", "label"), ["subject_id", "sphere_id"])
    k = F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc("seg_start"), F.desc("segment")))
    return rows.withColumn("rank", k).where(F.col("rank") <= cap).select("subject_id", "rank", "sphere_id", "label", "seg_start", "seg_end", "events", "dwell", F.round(F.col("dwell") / 3600, 2).alias("hours"), "top_app")


def selected_transitions(moves: DataFrame, selected: DataFrame) -> DataFrame:
    """Moves between selected spheres, with both labels."""
    label = lambda name: selected.select("subject_id", F.col("sphere_id").alias(name), F.col("label").alias(f"{name}_label"))
    return moves.join(label("source"), ["subject_id", "source"]).join(label("target"), ["subject_id", "target"])


def next_action(task: Column) -> Column:
    """A hint for going on with a sphere, by its task."""
    # The first group of words found in the task gives the hint.
    hints = (
        (("research",), "Summarize the strongest source and connect it to the active product concept."),
        (("build", "verify", "test"), "Open the latest artifact, check the last verification result, then continue the next small implementation step."),
        (("document", "plan"), "Review the latest note, extract decisions, and turn the next open item into a task."),
        (("communicate",), "Draft the next response using only the admitted context for this sphere."),
    )
    out = F.lit("Review the latest artifact and decide whether this sphere should continue, pause, or be ignored.")
    for words, hint in reversed(hints):
        out = F.when(task.rlike("|".join(words)), hint).otherwise(out)
    return out


def token_ranks(events: DataFrame, assigned: DataFrame, n: int) -> DataFrame:
    """The n tokens that most events of a sphere have (of equal ones the one seen first), as an array."""
    rows = without_system(events).join(assigned.select("id", "sphere_id"), "id")
    each = rows.select("subject_id", "sphere_id", "ts_start", "id", F.posexplode(F.array_distinct(sphere_tokens(F.col("artifact")))).alias("at", "t"))
    by = each.groupBy("subject_id", "sphere_id", "t").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("ts_start", "id", "at")).alias("f"))
    k = F.row_number().over(Window.partitionBy("subject_id", "sphere_id").orderBy(F.desc("c"), "f"))
    top = by.withColumn("k", k).where(F.col("k") <= n)
    return top.groupBy("subject_id", "sphere_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]).alias("tokens"))


def explanations(found: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Why each sphere of a report is one: sentences on its signal, terms, artifact, sessions and gate."""
    rows = found.withColumnRenamed("keywords", "tokens") if tokens is None else found.drop("tokens").join(tokens, ["subject_id", "sphere_id"], "left")
    terms = F.when(F.size("tokens") > 0, F.concat(F.lit("Shared terms: "), F.array_join(F.slice("tokens", 1, 4), ", ")))
    fired = F.array_join(F.transform(F.array_sort(F.map_entries("redaction_summary")), lambda f: F.concat(f["key"], F.lit(": "), f["value"].cast("string"))), ", ")
    # The sentences.
    said = F.array_compact(F.array(
        F.concat(F.lit("Dominant work signal: "), "domain", F.lit(" / "), "task"), terms, F.concat(F.lit("Top artifact: "), shorten(F.col("top_artifact"), 76)),
        F.when(F.col("sessions") > 1, F.concat(F.lit("Returned across "), F.col("sessions").cast("string"), F.lit(" sessions"))).otherwise("Single continuous session so far"),
        F.when(F.size("redaction_summary") > 0, F.concat(F.lit("Privacy gate fired before inference: "), fired)).otherwise("Uses redacted Depth 1 metadata only"),
    ))
    return rows.select("subject_id", "sphere_id", said.alias("explanations"), next_action(F.col("task")).alias("next_action"))


def resume_packs(found: DataFrame, recent: DataFrame, n: int = 5) -> DataFrame:
    """What to show someone who comes back to a sphere: its last artifact and app, returns, recent events and a hint."""
    last = recent.where(F.col("rank") <= n).groupBy("subject_id", "sphere_id").agg(F.array_sort(F.collect_list(F.struct("rank", "artifact", "app", "ts_end"))).alias("recent"))
    rows = found.join(last, ["subject_id", "sphere_id"], "left")
    return rows.select("subject_id", "sphere_id", "state", F.col("recent")[0]["artifact"].alias("last_artifact"), F.col("recent")[0]["app"].alias("last_app"), F.greatest(F.col("sessions") - 1, F.lit(0)).alias("return_count"), "recent", next_action(F.col("task")).alias("next_action"))


def _named(rows: DataFrame) -> DataFrame:
    """(subject_id, sphere_id, sphere_ordinal, kind, value, n, dwell, k, size): what a sphere's events name, by how many name it, then by first sight; findings by their counts."""
    keys = ["subject_id", "sphere_id", "sphere_ordinal"]
    one = lambda kind, value, at=F.lit(0): F.struct(F.lit(kind).alias("kind"), value.alias("value"), at.alias("at"), F.lit(1).alias("w"))
    single = F.array(*(one(c, F.col(c)) for c in ("domain", "app", "task", "artifact")))
    words = F.transform(F.array_distinct("tokens"), lambda t, i: one("token", t, i))
    found = F.transform(F.map_entries("findings"), lambda f: F.struct(F.lit("finding").alias("kind"), f["key"].alias("value"), F.lit(0).alias("at"), f["value"].alias("w")))
    each = rows.select(*keys, "ts_start", "id", "dwell", F.explode(F.concat(single, words, found)).alias("e"))
    by = each.groupBy(*keys, "e.kind", "e.value").agg(F.sum("e.w").alias("n"), F.sum("dwell").cast("double").alias("dwell"), F.min(F.struct("ts_start", "id", "e.at")).alias("f")).where("n > 0")
    # one shuffle of counts serves the ranks and what gathers them
    within = Window.partitionBy(*keys, "kind")
    return by.repartition(*keys).withColumn("k", F.row_number().over(within.orderBy(F.desc("n"), "f"))).withColumn("size", F.count(F.lit(1)).over(within)).where(f"k <= {max(APPS, ARTIFACTS, KEYWORDS)} or kind = 'finding'")


def report(events: DataFrame, assigned: DataFrame, as_of: str = AS_OF, cfg: C.Config = C.Config()) -> DataFrame:
    """One row per sphere: size, state, confidence, share, label, gate and what it is about; the top ones of each subject.

    assigned: :func:`assign` of the events; if it carries their columns they aren't read again.
    Spheres without any term that began alike share an id and its sessions, and stay rows of their own.
    """
    rows = assigned if "findings" in assigned.columns else assign(events, cfg, carry=True)
    keys = ["subject_id", "sphere_id", "sphere_ordinal"]
    at = F.struct("ts_start", "id")
    masked = (F.col("gate.mode") == "masked") | (F.size("findings") > 0)
    spheres = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"), F.sum("dwell").cast("double").alias("dwell"), F.min("ts_start").alias("first_seen"), F.max_by("ts_end", at).alias("last_seen"), F.max(F.struct(at, "ts_end")).alias("last"), F.avg("score").alias("mean_score"),
        F.max(masked).alias("masked"), F.max(F.col("gate.sensitivity") == "high").alias("high"), F.count_if("opens").alias("sessions"),
    )
    value = lambda kind, what: F.when(F.col("kind") == kind, what)
    listed = lambda kind, n: F.slice(F.array_sort(F.collect_list(value(kind, F.struct("k", "value", "n", "dwell")))), 1, n)
    names = _named(rows).groupBy(*keys).agg(
        *(listed(kind, n).alias(f"{kind}s") for kind, n in (("domain", 1), ("task", 1), ("app", APPS), ("artifact", ARTIFACTS), ("token", KEYWORDS))),
        F.max(value("token", F.col("size"))).alias("n_tokens"), F.map_from_entries(F.array_sort(F.collect_list(value("finding", F.struct("value", F.col("n").cast("int")))))).alias("redaction_summary"),
    )
    same = F.col("subject_id").eqNullSafe(F.col("_s")) & (F.col("sphere_ordinal") == F.col("_k"))
    out = spheres.join(names.drop("sphere_id").withColumnsRenamed({"subject_id": "_s", "sphere_ordinal": "_k"}), same).drop("_s", "_k").withColumn("sessions", F.sum("sessions").over(Window.partitionBy("subject_id", "sphere_id")))
    w = Window.partitionBy("subject_id")
    age = F.timestamp_diff("SECOND", F.col("last_seen"), as_of_column(as_of))
    state = F.when((F.col("last_seen") == F.max("last").over(w)["ts_end"]) & (age <= 900), "active").when(age <= 86400, "suspended").otherwise("dormant")
    score = (
        0.25 + F.least(F.lit(1.0), F.log1p("events") / F.log1p(F.lit(24.0))) * 0.22 + F.least(F.lit(1.0), F.col("sessions") / 5) * 0.2 + F.least(F.lit(1.0), F.coalesce("n_tokens", F.lit(0)) / 8) * 0.12
        + F.coalesce(F.col("domains")[0]["n"] / F.col("events"), F.lit(0.0)) * 0.11 + F.col("mean_score") * 0.14 - F.when(F.size("redaction_summary") > 0, 0.04).otherwise(0.0)
    )
    first = lambda column, otherwise: F.coalesce(F.get(column, F.lit(0))["value"], F.lit(otherwise))
    domain, task, top = first("domains", "other"), first("tasks", "unclassified work"), F.get("artifacts", F.lit(0))
    words = F.transform("tokens", lambda t: t["value"])
    terms = F.when(F.size("tokens") > 0, F.array_join(F.slice(words, 1, 3), " ")).otherwise(domain)
    label = shorten(F.when((top["n"] >= 2) & ~top["value"].startswith("["), top["value"]).otherwise(F.concat_ws(": ", task, terms)), 72)
    out = out.withColumn("state", state).withColumn("confidence", F.round(F.greatest(F.lit(0.2), F.least(F.lit(0.96), score)), 2)).withColumn("share", F.round(F.col("dwell") / F.greatest(F.sum("dwell").over(w), F.lit(1.0)), 4))
    order = F.when(F.col("state") == "active", 0).when(F.col("state") == "suspended", 1).otherwise(2)
    ranked = out.withColumn("rank", F.row_number().over(w.orderBy(order, F.desc(F.round("dwell", 2)), F.desc("confidence"), "sphere_ordinal"))).where(F.col("rank") <= cfg.max_spheres)
    gate = F.when(F.col("masked"), "masked").otherwise("allowed")
    apps = F.transform("apps", lambda a: F.struct(a["value"].alias("name"), a["n"].alias("events")))
    artifacts = F.transform("artifacts", lambda a: F.struct(a["value"].alias("name"), a["n"].alias("events"), F.round(a["dwell"], 2).alias("dwell"), F.round(a["dwell"] / 3600, 2).alias("hours")))
    return ranked.select(
        "subject_id", "rank", "sphere_id", label.alias("label"), domain.alias("domain"), task.alias("task"), "events", "sessions", "dwell", "share", "state", "confidence", gate.alias("gate_mode"),
        F.when(F.col("high"), "high").when(F.col("masked"), "medium").otherwise("low").alias("sensitivity"), top["value"].alias("top_artifact"), "first_seen", "last_seen", apps.alias("apps"), artifacts.alias("artifacts"), words.alias("keywords"), "redaction_summary",
    )
