"""Working spheres against a plain version that compares each event with all spheres."""

import math
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from focusloom import config as C
from focusloom.operators import spheres
from focusloom.plans import catalogue
from focusloom.schema import EVENT

BASE = datetime(2024, 1, 1)
CFG = C.Config()


def norm(text):
    text = re.sub(r"https?://\S+", " ", re.sub(r"\[[^\]]+\]", " ", text.lower()))
    return " ".join(re.sub(r"[^a-z0-9]+", " ", text).split())


def words(text):
    return list(dict.fromkeys([t for t in norm(text).split() if len(t) >= 3 and t not in C.SPHERE_STOPWORDS and not t.isdigit()][:24]))


class Plain:
    """One sphere; Counter.most_common breaks ties by first sight."""

    def __init__(self, k):
        self.k, self.domains, self.apps, self.tasks, self.artifacts, self.tokens, self.findings = k, Counter(), Counter(), Counter(), Counter(), Counter(), Counter()
        self.norms, self.scores, self.dwell, self.last, self.segments, self.masked, self.high = set(), [], 0.0, None, 0, False, False

    def score(self, e, near):
        tokens, top = set(words(e["artifact"])), {t for t, _ in self.tokens.most_common(18)}
        same = norm(e["artifact"]) in self.norms
        if not same and len(tokens & top) < 2:
            return 0.0
        x = 0.18 * (e["domain"] in self.domains) + 0.12 * (e["app"] in self.apps) + 0.13 * (e["task"] in self.tasks) + 0.46 * same
        if tokens and top:
            x += min(0.48, len(tokens & top) / len(tokens | top) * 0.72)
            x += 0.08 * (len(tokens & top) >= 2)
        return round(min(x + 0.16 * near, 1.0), 4)


def plain(events):
    """{id: (ordinal, score)} and the spheres of one subject's events."""
    found, out, before, ended, segments = [], {}, None, None, Counter()
    gap = timedelta(minutes=CFG.session_gap_minutes)
    for e in sorted(events, key=lambda e: (e["ts_start"], e["id"])):
        near = ended is not None and e["ts_start"] - ended <= gap
        best, score = None, 0.0
        for s in found:
            x = s.score(e, near and s.sid == before.sid)
            if x > score:
                best, score = s, x
        if best is None or score < CFG.match_threshold:
            best, score = Plain(len(found)), 0.52
            best.sid = (e["domain"], e["app"], e["task"], norm(e["artifact"])[:80], *sorted(words(e["artifact"]))[:5])
            found.append(best)
        segments[best.sid] += not near or best.sid != before.sid
        for counter, value in ((best.domains, e["domain"]), (best.apps, e["app"]), (best.tasks, e["task"]), (best.artifacts, e["artifact"])):
            counter[value] += 1
        best.tokens.update(words(e["artifact"]))
        best.findings.update(e["findings"] or {})
        best.norms |= {norm(e["artifact"])} - {""}
        best.scores.append(score)
        best.dwell += float(e["dwell"])
        best.last = e["ts_end"]
        low = e["artifact"].lower()
        best.high |= C.REDACTED_TITLE in low
        best.masked |= bool(e["findings"]) or C.REDACTED_TITLE in low or any(m in low for m in C.PLACEHOLDERS)
        out[e["id"]] = (best.k, score)
        before, ended = best, e["ts_end"]
    for s in found:
        s.segments = segments[s.sid]
    return out, found


def rows_of(events):
    listed = events.withColumn("task", spheres.sphere_task(F.col("domain"), F.col("artifact"), F.col("artifact"))).where("domain <> 'system' and action <> 'system'")
    by = {}
    for r in listed.collect():
        e = r.asDict() | {"findings": r.asDict().get("findings")}
        by.setdefault(e["subject_id"], []).append(e)
    return by


def same_assignment(events):
    want = {i: x for rows in rows_of(events).values() for i, x in plain(rows)[0].items()}
    got = {r.id: (r.sphere_ordinal, r.score) for r in spheres.assign(events).collect()}
    assert got == want and want


def test_all_events_go_where_the_plain_rule_puts_them(spark):
    same_assignment(catalogue.events(spark, "/root/testdata/sf0.01"))


def made(spark, seed, n=500, vocabulary=40):
    """Many tokens to a sphere, so that top tokens change places; findings, placeholders and hidden titles now and then."""
    r = random.Random(seed)
    names = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(vocabulary)]
    at, rows = BASE, []
    for i in range(n):
        at += timedelta(minutes=r.choice([1, 1, 5, 44, 46, 90]))
        artifact = " ".join(r.choices(names, k=r.randint(1, 9)))
        kind = r.random()
        found = {"email": 2} if kind < 0.03 else None
        artifact = C.REDACTED_TITLE if kind > 0.98 else f"mail [secret] {artifact}" if kind > 0.95 else artifact
        dwell = float(r.randint(0, 600))
        rows.append((i, r.choice(["1", "2"]), f"app{r.randint(0, 2)}", artifact, artifact, r.choice(["coding", "planning"]), "focus", at, at + timedelta(seconds=dwell), dwell, found))
    return spark.createDataFrame(rows, EVENT.replace("dwell decimal(18,2)", "dwell double"))


@pytest.mark.parametrize("seed", [1, 2])
def test_assignment_and_report_of_crowded_spheres(spark, seed):
    events = made(spark, seed)
    same_assignment(events)
    cfg = C.Config(max_spheres=10**6)
    as_of = str(BASE + timedelta(days=30))
    own = spheres.assigned_once(events)
    got = {(r.subject_id, r.label, r.events, r.dwell): r for r in spheres.report(events, own, as_of, cfg).collect()}
    n = 0
    for subject, rows in rows_of(events).items():
        for s in plain(rows)[1]:
            n += 1
            (artifact, times), (domain, most) = s.artifacts.most_common(1)[0], s.domains.most_common(1)[0]
            task, terms = s.tasks.most_common(1)[0][0], [t for t, _ in s.tokens.most_common(6)]
            label = artifact if times >= 2 and not artifact.startswith("[") else f"{task}: {' '.join(terms[:3]) or domain}"
            label = " ".join(label.split())
            label = label if len(label) <= 72 else label[:69].rstrip() + "..."
            r = got[subject, label, len(s.scores), s.dwell]
            assert (r.domain, r.task, r.sessions, r.keywords, r.last_seen) == (domain, task, s.segments, terms, s.last)
            assert [(a.name, a.events) for a in r.apps] == s.apps.most_common(4) and [(a.name, a.events) for a in r.artifacts] == s.artifacts.most_common(5)
            assert r.redaction_summary == dict(s.findings) and r.gate_mode == ("masked" if s.masked else "allowed") and r.sensitivity == ("high" if s.high else "medium" if s.masked else "low")
            value = 0.25 + min(1, math.log1p(len(s.scores)) / math.log1p(24)) * 0.22 + min(1, s.segments / 5) * 0.2 + min(1, len(s.tokens) / 8) * 0.12 + most / len(s.scores) * 0.11 + sum(s.scores) / len(s.scores) * 0.14 - 0.04 * bool(s.findings)
            assert abs(r.confidence - max(0.2, min(0.96, value))) <= 0.0051
    assert n == len(got) > 5


def test_an_event_meets_only_spheres_that_can_take_it():
    state = spheres.Assigner(45, 0.42)
    met = 0
    for i in range(20_000):
        k = i % 4000
        at = BASE + timedelta(minutes=i)
        row = spheres.Event("1", at, at, "coding", f"app{k % 3}", "build", f"common thing{k}", ["common", f"thing{k}", f"place{k % 50}"])
        met += len(state.candidates(row, set(row.tokens)))
        state.assign(row)
    assert len(state.spheres) > 40 and met < 60 * 20_000  # all 'common' and a fiftieth share a place; scanning all spheres would meet thousands each


def test_null_and_empty(spark):
    rows = [(1, None, None, None, None, "coding", "focus", BASE, BASE, None, None), (2, None, None, None, "", "coding", "focus", BASE, BASE, None, None)]
    events = spark.createDataFrame(rows, EVENT)
    assert len(spheres.assign(events).collect()) == 2
    assert spheres.report(events, spheres.assigned_once(events)).count() == 2  # alike, but without a term that could join them
    assert spheres.report(events.where("false"), spheres.assigned_once(events.where("false"))).collect() == []
