"""Assembled rows against a plain version of the rule; ties, repeats, nulls and empty samples."""

import random
import re
from collections import Counter
from datetime import datetime, timedelta

from focusloom import config as C
from focusloom.operators import assembly, connectors

CFG = C.Config(capture_depth=4, browser_apps=("Web",), accessibility_apps=("Tree", "Both"), ocr_apps=("Screen", "Both"), ignored_apps=("lock",), accessibility_max_hints=3, ocr_max_hints=2, ocr_max_lines=5)
MAIL, LINK = re.compile(r"\b[\w.]+@[\w.]+\.[a-z]{2,}\b"), re.compile(r"https?://[^\s<>'\"]+")
NOW = datetime(2024, 5, 1, 12)


def plain_redact(text):
    found = Counter()
    text, n = MAIL.subn("[email]", text)
    found["email"] += n
    text, n = LINK.subn(lambda m: re.match(r"https?://[^/]+", m[0])[0] + "/[redacted-path]", text)
    found["url"] += n
    return text, +found


def squeeze(text, limit):
    return re.sub(r"\s+", " ", text or "").strip()[:limit]


def plain_lines(texts, limit, most):
    """Hints, findings, and how many lines were read."""
    hints, found, read = [], Counter(), 0
    for t in texts:
        read += 1
        t = squeeze(t, limit)
        if t:
            t, f = plain_redact(t)
            found += f
            if t.strip().lower() not in [h.lower() for h in hints]:
                hints.append(t.strip())
                if len(hints) == most:
                    break
    return hints, found, read


def plain(row):
    """(title, kind, hints, confidence, roles, findings) of a sample."""
    _, _, app, title, _, _, tab, nodes, screen = row
    title, kind, hints, found, mean, roles = title or "", None, None, Counter(), None, None
    nodes, lines = nodes or [], [x for x in (screen[1] or [])][: CFG.ocr_max_lines] if screen else []
    if app == "Web" and tab and ((tab[0] or "").strip() or tab[1]):
        kind, hints = "browser_tab", []
        shown, found = plain_redact((tab[0] or "").strip()[:240])
        if tab[1]:
            found["url"] += 1 + ("/" in tab[1][8:])  # the path, and the address as such
        title = shown or title
    elif app in ("Tree", "Both") and nodes:
        kind = "accessibility_snapshot"
        hints, found, read = plain_lines([" ".join(x or "" for x in n[1:]) for n in nodes], 96, CFG.accessibility_max_hints)
        roles = Counter(squeeze(n[0], 64) or "unknown" for n in nodes[:read]).most_common(8)
    elif app in ("Screen", "Both") and any(squeeze(x[0], 120) for x in lines):
        kind = "ocr_summary"
        hints, found, read = plain_lines([x[0] for x in lines], 120, CFG.ocr_max_hints)
        sure = [x[1] for x in lines[:read] if squeeze(x[0], 120) and x[1] is not None]
        mean = round(sum(sure) / len(sure), 3) if sure else 0.0
    if app == "lock":
        title = "[system state: lock]"
    else:
        title = "[redacted sensitive title]" if "password" in title.lower() else squeeze(title, 240)
    title, f = plain_redact(title)
    return title, kind, hints, mean, roles, dict(+(found + f))


def told(r):
    s = r.surface
    roles = s and s.roles and [(x["role"], x["count"]) for x in s.roles]
    return r.title, s and s.kind, s and s.text_hints, s and s.confidence, roles or None, r.findings


def samples(n=400, seed=3):
    r = random.Random(seed)
    texts = ["a note", "A  Note", "mail bob@x.org", "", "  ", None, "see https://a.org/x?y", "ledger 1161", "ends in 2", "\nline\n", "x" * 300, "[email]", "two b@y.org c@z.org"]
    rows = []
    for i in range(n):
        nodes = [(r.choice(["button", "text", " ", None, "b" * 80]), r.choice(texts), r.choice(texts)) for _ in range(r.choice([0, 1, 2, 6, 12]))]
        lines = [(r.choice(texts), r.choice([None, 0.5, 0.25])) for _ in range(r.choice([0, 1, 4, 9]))]
        title = r.choice([*texts, "my Password", "to a@b.org"])
        tab = r.choice([None, (r.choice(texts), r.choice([None, "", "https://docs.a.org/x", "https://docs.a.org"]))])
        rows.append((i // 2, "s", r.choice(["Web", "Tree", "Screen", "Both", "lock", "other"]), title, NOW, r.choice([None, 0.0, 30.0]), tab, r.choice([None, nodes]), r.choice([None, ("w a@b.org", lines), ("w", None)])))
    return rows


def test_rows_equal_a_plain_version(spark):
    rows = samples()
    got = assembly.assemble(spark.createDataFrame(rows, assembly.SAMPLE).coalesce(1), CFG).collect()
    assert len(got) == len(rows)
    for row, r in zip(rows, got):
        assert told(r) == plain(row), row
        assert r.action == ("system" if row[2] == "lock" else "focus") and (r.domain == "system") == (row[2] == "lock")
        assert r.artifact == (r.title or row[2]) and r.ts_end - r.ts_start == timedelta(seconds=max(row[5] or 0, 0.1))
    assert {r.surface.kind for r in got if r.surface} == {"browser_tab", "accessibility_snapshot", "ocr_summary"}


def test_settings_connectors_and_odd_columns(spark):
    manifest = connectors.load([{"id": "m", "apps": ["Tree"], "sources": ["accessibility", "window_title"], "min_depth": 1, "fields": [{"name": "to", "store": "redacted", "pattern": r"for (?P<value>\S+)"}]}])
    row = (1, "s", "Tree", "t", NOW, 1.0, None, [("b", "for bob@x.org", "")], None)
    df = spark.createDataFrame([row], assembly.SAMPLE).selectExpr("*", "1 AS `findings.x`", "2 AS surface")
    r = assembly.assemble(df, CFG, manifest).collect()[0]
    assert r.findings == {"email": 1 + r.structured.redaction_findings.get("email", 0)} and r["findings.x"] == 1 and r.structured.connector == "m"
    lock = spark.createDataFrame([(1, "s", "lock", "t", NOW, 1.0, None, None, None), (2, "s", None, None, NOW, None, None, None, None)], assembly.SAMPLE)
    shallow = C.Config(capture_depth=1, ignored_apps=("lock",), record_ignored=False)
    assert [(x.id, x.title, x.surface, x.domain) for x in assembly.assemble(lock, shallow).collect()] == [(2, "", None, "other")]
    assert assembly.assemble(lock, C.Config(collection_paused=True)).count() == 0
    assert assembly.assemble(lock.where("false"), CFG).count() == 0
