"""Registered queries over what is collected: samples with their surfaces made into event rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from focusloom import config as C
from focusloom.operators import assembly
from focusloom.plans.catalogue import _E, _of, named

_CFG = C.Config(capture_depth=4, browser_apps=("app0", "app1"), accessibility_apps=("app2", "app3"), ocr_apps=("app3", "app4"), ignored_apps=("app6",))


def _samples(e: DataFrame) -> DataFrame:
    """Samples made from events: tabs with and without a title, element trees with and without elements, lines with repeats."""
    even = F.col("id") % 2 == 0
    tab = F.when(F.col("app") == "app0", F.struct(F.concat("artifact", F.lit(" for ana@x.org")).alias("title"), F.concat(F.lit("https://docs.example.com/a?id="), "id").alias("url")))
    tab = tab.when((F.col("app") == "app1") & ~even, F.struct(F.lit("").alias("title"), F.lit("https://docs.example.com").alias("url")))
    node = lambda role, name, value: F.struct(F.lit(role).alias("role"), name.alias("name"), value.cast("string").alias("value"))
    nodes = F.array(node("button", F.col("artifact"), F.lit("")), node(" ", F.lit("mail ana@x.org"), F.col("id")), node("button", F.upper("artifact"), F.lit(None)))
    line = lambda text, confidence: F.struct(text.alias("text"), F.lit(confidence).cast("double").alias("confidence"))
    lines = F.array(line(F.col("artifact"), 0.9), line(F.lit(" "), 0.1), line(F.concat(F.lit("see  "), "domain"), None), line(F.concat(F.lit(" "), F.upper("artifact")), 0.5))
    screen = F.struct(F.lit("a window").alias("window_title"), lines.alias("lines"))
    return e.select("id", "subject_id", "app", F.col("artifact").alias("title"), "ts_end", F.col("dwell").cast("double").alias("dwell"), tab.alias("tab"), F.when(F.col("app") == "app2", nodes).alias("elements"), screen.alias("screen"))


def _assembled(e: DataFrame) -> DataFrame:
    s = F.col("surface")
    roles = F.array_join(F.transform(s["roles"], lambda x: F.concat_ws(":", x["role"], x["count"].cast("string"))), ",")
    found = F.array_join(F.transform(F.array_sort(F.map_entries("findings")), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",")
    return assembly.assemble(_samples(e), _CFG).select(
        "id", "subject_id", "title", "domain", "action", "ts_start", "ts_end", s["kind"].alias("kind"), s["url"].alias("url"), F.array_join(s["text_hints"], "|").alias("hints"), s["summary"].alias("summary"),
        s["confidence"].alias("confidence"), roles.alias("roles"), F.coalesce(s["elements"], F.lit(0)).alias("elements"), found.alias("findings"),
    )


named("assembled_events", _of(_assembled),
      f"""{_E}, k AS (SELECT *, CASE WHEN app = 'app0' OR app = 'app1' AND id % 2 = 1 THEN 'browser_tab' WHEN app = 'app2' THEN 'accessibility_snapshot' WHEN app IN ('app3', 'app4') THEN 'ocr_summary' END AS kind, contains(artifact, 'roadmap') AS r FROM e)
      SELECT id, subject_id, CASE app WHEN 'app6' THEN '[system state: app6]' WHEN 'app0' THEN artifact || ' for [email]' ELSE artifact END AS title,
      CASE WHEN app = 'app6' THEN 'system' WHEN app IN ('app0', 'app2') THEN 'communication' WHEN kind = 'browser_tab' OR kind = 'ocr_summary' AND domain = 'browser-research' THEN 'browser-research' WHEN r THEN 'planning' ELSE 'other' END AS domain,
      CASE app WHEN 'app6' THEN 'system' ELSE 'focus' END AS action, ts_end - to_microseconds(CAST(round(greatest(CAST(dwell AS DOUBLE), 0.1) * 1000000) AS BIGINT)) AS ts_start, ts_end, kind,
      CASE WHEN app = 'app0' THEN 'https://docs.example.com/[redacted-path]' WHEN kind = 'browser_tab' THEN 'https://docs.example.com/[redacted-path]' WHEN kind IS NOT NULL THEN '' END AS url,
      CASE kind WHEN 'browser_tab' THEN '' WHEN 'accessibility_snapshot' THEN artifact || '|mail [email] ' || id WHEN 'ocr_summary' THEN artifact || coalesce('|see ' || domain, '') END AS hints,
      CASE WHEN kind = 'ocr_summary' THEN artifact || coalesce('; see ' || domain, '') WHEN kind IS NOT NULL THEN '' END AS summary,
      CASE WHEN kind = 'ocr_summary' THEN 0.7 END AS confidence, CASE WHEN kind = 'accessibility_snapshot' THEN 'button:2,unknown:1' END AS roles,
      CAST(CASE kind WHEN 'accessibility_snapshot' THEN 3 WHEN 'ocr_summary' THEN 4 ELSE 0 END AS INTEGER) AS elements,
      CASE WHEN app = 'app0' THEN 'email:1,url:3' WHEN kind = 'browser_tab' THEN 'url:1' WHEN kind = 'accessibility_snapshot' THEN 'email:1' ELSE '' END AS findings FROM k""")  # fmt: skip
