"""Masked sums against plain HMAC, the marked path of returns and the subject graph against plain versions."""

import hashlib
import hmac
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from focusloom import config as C
from focusloom.operators import collective, connectors, graph, resume
from focusloom.schema import EVENT

BASE = datetime(2024, 1, 1)
MOD = 2**32


def stream(secret, round_id, a, b, width):
    seed = hmac.new(secret, f"{round_id}|{min(a, b)}|{max(a, b)}".encode(), hashlib.sha256).digest()
    raw = b"".join(hmac.new(seed, k.to_bytes(8, "big"), hashlib.sha256).digest() for k in range(-(-width // 8)))
    return [int.from_bytes(raw[4 * i : 4 * i + 4], "big") for i in range(width)]


def work(spark, n):
    return collective.contributions(spark.createDataFrame([(f"s{i:03}", "coding:review") for i in range(n)], "subject_id string, theme string"))


@pytest.mark.parametrize("n, partners", [(2, 32), (7, 32), (6, 4), (40, 4), (33, 32)])
def test_masks_equal_plain_hmac_row_by_row(spark, n, partners):
    values = work(spark, n)
    met = defaultdict(set)
    for r in collective.pairs(values, partners).collect():
        assert r.other not in met[r.subject_id] and r.other != r.subject_id
        met[r.subject_id].add(r.other)
    assert all(a in met[b] for a in met for b in met[a]) and {len(m) for m in met.values()} == {min(partners, n - 1)}
    reached, left = set(), {next(iter(met))}
    while left:  # one ring: no group of the cohort can be told apart by its masks
        reached |= left
        left = set().union(*(met[a] for a in left)) - reached
    assert len(reached) == n
    masked = collective.masked(values, b"secret", "2024-W05", partners).collect()
    width, position = len(C.THEMES), {t: i for i, t in enumerate(C.THEMES)}
    want = {}
    for a in met:
        total = [int(t == "coding:review") for t in C.THEMES]
        for b in met[a]:
            sign = 1 if a < b else -1
            total = [(x + sign * m) % MOD for x, m in zip(total, stream(b"secret", "2024-W05", a, b, width))]
        want |= {(a, i): x for i, x in enumerate(total)}
    assert {(r.subject_id, r.position): r.masked for r in masked} == want and len(masked) == n * width
    assert {(r.round_id, r.cohort_size) for r in masked} == {("2024-W05", n)} and len({r.cohort_digest for r in masked}) == 1
    sums = {r.theme: r.total for r in collective.secure_sum(spark.createDataFrame(masked)).collect()}
    assert sums == {t: n * (t == "coding:review") for t in position}


def test_rounds_that_do_not_cancel_are_refused(spark):
    values = work(spark, 5)
    masked = spark.createDataFrame(collective.masked(values, b"k", "r").collect())
    other = spark.createDataFrame(collective.masked(values, b"k", "q").collect())
    wrong = spark.createDataFrame(collective.masked(values, b"x", "r").collect())
    first = F.col("subject_id") == "s000"
    for bad, why in (
        (masked.where(~first), "incomplete, 4 of 5"), (masked.where(~first).union(other.where(first)), "different rounds"), (masked.where(~first).union(wrong.where(first)), "do not cancel"),
        (masked.where(~first).union(spark.createDataFrame(collective.masked(work(spark, 6), b"k", "r").where(first).collect())), "different cohorts"),
        (masked.where("position <> 3"), "positions once"), (masked.union(masked.where(first)), "positions once"),
    ):
        with pytest.raises(Exception, match=why):
            collective.secure_sum(bad).collect()
    with pytest.raises(Exception, match="at least two"):
        collective.masked(work(spark, 1), b"k", "r").collect()


def plain_scan(runs, gap, least):
    """One subject's runs, interruption by interruption; on from the run after a return."""
    out, i = [], 1
    while i < len(runs):
        p, step = runs[i - 1], i + 1
        if runs[i]["start"] - p["end"] < gap:
            if p["dwell"] >= least and runs[i]["cluster"] != p["cluster"]:
                back = next((r for r in runs[i + 1 :] if r["cluster"] == p["cluster"] and r["dwell"] >= least), None)
                if back and back["start"] - runs[i]["start"] >= gap:
                    out.append((p["run"], back["run"], back["start"] - runs[i]["start"], back["start"] - p["end"]))
                    step = runs.index(back) + 1
        else:
            task = next((r for r in reversed(runs[:i]) if r["dwell"] >= least), None)
            back = task and next((r for r in runs[i:] if r["cluster"] == task["cluster"] and r["dwell"] >= least), None)
            if back:
                out.append((p["run"], back["run"], back["start"] - runs[i]["start"], runs[i]["start"] - p["end"]))
                step = runs.index(back) + 1
        i = step
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_returns_follow_the_scan(spark, seed):
    r = random.Random(seed)
    rows, want = [], []
    for s in range(12):
        runs, at = [], 0.0
        for k in range(r.choice([0, 1, 2, 60, 300])):
            at += r.choice([0, 10, 899, 900, 2000])
            dwell = float(r.choice([5, 59, 60, 400]))
            runs.append({"run": k + 1, "cluster": r.choice("abc"), "start": at, "end": at + dwell, "dwell": dwell})
            at += dwell
        rows += [(f"u{s}", x["run"], x["cluster"], BASE + timedelta(seconds=x["start"]), BASE + timedelta(seconds=x["end"]), x["dwell"], 1) for x in runs]
        want += [(f"u{s}", *x) for x in plain_scan(runs, 900.0, 60.0)]
    found = spark.createDataFrame(rows, "subject_id string, run long, cluster string, run_start timestamp_ntz, run_end timestamp_ntz, dwell double, events long")
    got = [(x.subject_id, x.left_run, x.back_run, x.resume_seconds, x.gap_seconds) for x in resume.resume_events(found).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20
    assert resume.resume_events(found.where("false")).collect() == []


def test_graph_of_each_subject(spark):
    rows = [
        (1, "u", "Safari", None, "Docs of parser - arxiv", "browser-research", "focus", BASE, BASE, 15, None),
        (2, "u", "Safari", None, "[name] checkout [credit-card]", "browser-research", "focus", BASE + timedelta(seconds=15), BASE, 15, {"name": 1, "credit_card": 1, "odd_kind": 2, "phone": 0}),
        (3, "u", "System", None, "locked", "system", "system", BASE + timedelta(seconds=30), BASE, 15, None),
        (4, "u", None, None, " ", None, "focus", BASE + timedelta(seconds=45), BASE, 0, None),
        (1, "v", "Safari", None, "docs OF parser - arxiv", "coding", "focus", BASE, BASE, 9, None),
    ]
    from decimal import Decimal

    events = spark.createDataFrame([(*x[:9], Decimal(x[9]), x[10]) for x in rows], EVENT).fillna({"domain": "other"})
    read = connectors.apply_each(events, {"browser_tab": connectors.payload(title=F.col("artifact"), url_domain=F.lit("x.org"))}, 2)
    nodes = graph.nodes(read).collect()
    by = {(n.subject_id, n.type, n.label): n for n in nodes}
    assert {n.subject_id for n in nodes} == {"u", "v"} and not any(n.type == "domain" and n.label == "system" for n in nodes)
    assert by["u", "subject", "you"].rank == 1 and by["u", "subject", "you"].gate_mode == "generalized" and by["u", "subject", "you"].events == 3
    masked = by["u", "artifact", "[name] checkout [credit-card]"]
    assert (masked.gate_mode, masked.sensitivity, masked.dwell) == ("masked", "medium", 15.0)
    assert by["u", "private-signal", "masked identity/contact"].events == 1 and by["u", "private-signal", "blocked card data"].sensitivity == "high" and by["u", "private-signal", "masked odd kind"].events == 2
    assert ("u", "connector-field", "domain: x.org") in by and ("u", "artifact", "untitled artifact") in by and ("u", "app", "unknown app") in by
    names = {(n.subject_id, n.node_id): n.label for n in nodes}
    edges = {(e.subject_id, names[e.subject_id, e.source], e.relation, names[e.subject_id, e.target]): e for e in graph.edges(read).collect()}
    assert edges["u", "Safari", "opened", masked.label].gate_mode == "masked" and edges["u", masked.label, "redacted_from", "blocked card data"].dwell == 0
    assert edges["u", "Docs of parser - arxiv", "next_context", masked.label].events == 1 and edges["u", masked.label, "next_context", "untitled artifact"].events == 1
    assert Counter(k[2] for k in edges if k[0] == "v") == Counter(k[2] for k in edges if k[0] == "v" and k[2] not in ("next_context", "transitioned_to"))
    few = graph.gates(read, 3).where("subject_id = 'u'").first()
    total = sum(n.subject_id == "u" for n in nodes)
    assert few.withheld == total - 3 and few.allowed + few.masked + few.generalized == 3
    assert {(e.source in kept and e.target in kept) for kept in [{n.node_id for n in graph.nodes(read, 5).collect()}] for e in graph.edges(read, max_nodes=5).collect()} == {True}
