"""From raw samples to event rows: which surface tells, what of it stays, and what redaction took out.

A sample holds what was to be seen at one moment: the window's title and, where
they could be read, the browser's tab, the accessibility tree's elements and the
lines read off the screen. Of these the first that the settings allow and that
holds something is the sample's surface. All its texts are redacted joined, in
one pass of built-in functions, so nothing is shuffled and no row goes to Python.

Defined cases: null texts are empty; a null app is no app that is ignored or may
be looked into; a null dwell is none and the event begins a tenth of a second
before its end; rows that repeat stay; columns beyond a sample's are kept, but for those
that have the name of one that is made here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from focusloom import config as C
from focusloom.functions.text import classify_domain, is_ignored, redact, sanitize_url, scrub_title
from focusloom.operators import connectors
from focusloom.operators.surfaces import merged_findings

SAMPLE = (
    "id bigint, subject_id string, app string, title string, ts_end timestamp, dwell double, tab struct<title:string,url:string>, "
    "elements array<struct<role:string,name:string,value:string>>, screen struct<window_title:string,lines:array<struct<text:string,confidence:double>>>"
)
#: Parts texts that are redacted as one; no pattern reaches over it.
_PART = "\n|\n"
_COUNTS = "map<string,int>"
_OWN = ("id", "subject_id", "app", "title", "ts_end", "dwell", "tab", "elements", "screen")
_MADE = ("artifact", "domain", "action", "ts_start", "surface", "structured", "findings")


def _clean(text: Column, limit: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 1, limit)


def _allowed(apps: tuple, least: int, cfg: C.Config) -> Column:
    return F.coalesce(F.lower("app").isin(*(a.lower() for a in apps)), F.lit(False)) if apps and cfg.capture_depth >= least else F.lit(False)


def _hints(safe: Column, most: int) -> Column:
    """struct(hints, used): the first texts that differ in more than case, and how many lines were read until there were enough."""
    none = F.array().cast("array<string>")

    def step(a: Column, text: Column) -> Column:
        full, known = F.size(a["hints"]) >= most, (text == "") | F.array_contains(a["low"], F.lower(text))
        new = lambda name, value: F.when(full | known, a[name]).otherwise(F.array_append(a[name], value)).alias(name)
        return F.struct(new("hints", text), new("low", F.lower(text)), (a["used"] + F.when(full, 0).otherwise(1)).alias("used"))

    start = F.struct(none.alias("hints"), none.alias("low"), F.lit(0).alias("used"))
    return F.aggregate(safe, start, step)


def _roles(elements: Column) -> Column:
    """How often each role was met, the eight most frequent; of equals the first seen."""
    roles = F.transform(elements, lambda x: F.coalesce(F.nullif(_clean(x["role"], 64), F.lit("")), F.lit("unknown")))
    counted = F.transform(F.array_distinct(roles), lambda r, i: F.struct((-F.size(F.filter(roles, lambda x: x == r))).alias("n"), i.alias("i"), r.alias("role")))
    return F.transform(F.slice(F.array_sort(counted), 1, 8), lambda x: F.struct(x["role"].alias("role"), (-x["n"]).alias("count")))


def _summary(hints: Column) -> Column:
    joined = F.array_join(F.slice(hints, 1, 3), "; ")
    return F.when(F.length(joined) > 260, F.concat(F.rtrim(F.substring(joined, 1, 257)), F.lit("..."))).otherwise(joined)


def surface(samples: DataFrame, cfg: C.Config = C.Config()) -> DataFrame:
    """Adds ``surface``: the sample's sanitised surface; null where none may be looked into or none holds anything.

    The browser's tab comes before the accessibility tree, and that before the
    screen's lines. Reading stops once there are hints enough: roles, confidence
    and findings are of the lines read.
    """
    kept = [c for c in samples.columns if c != "surface"]
    seen = ~F.coalesce(is_ignored(F.col("app"), cfg.ignored_apps), F.lit(False))
    tab = sanitize_url(F.coalesce("tab.url", F.lit("")), cfg)
    tab_title = F.substring(F.trim(F.coalesce("tab.title", F.lit(""))), 1, 240)
    nodes = F.coalesce("elements", F.expr("cast(array() as array<struct<role:string,name:string,value:string>>)"))
    lines = F.slice(F.coalesce("screen.lines", F.expr("cast(array() as array<struct<text:string,confidence:double>>)")), 1, max(1, cfg.ocr_max_lines))
    df = samples.withColumn("_tab", tab).withColumn("_title", tab_title).withColumn("_nodes", nodes).withColumn("_lines", lines)
    df = df.withColumn("_node_texts", F.transform("_nodes", lambda x: _clean(F.concat_ws(" ", x["name"], x["value"]), cfg.accessibility_text_limit)))
    df = df.withColumn("_line_texts", F.transform("_lines", lambda x: _clean(x["text"], cfg.ocr_text_limit)))
    kind = (
        F.when(seen & _allowed(cfg.browser_apps, cfg.browser_min_depth, cfg) & ((F.col("_title") != "") | (F.col("_tab.url_domain") != "")), "browser_tab")
        .when(seen & _allowed(cfg.accessibility_apps, cfg.accessibility_min_depth, cfg) & (F.size("_nodes") > 0), "accessibility_snapshot")
        .when(seen & _allowed(cfg.ocr_apps, cfg.ocr_min_depth, cfg) & F.exists("_line_texts", lambda t: t != ""), "ocr_summary")
    )
    df = df.withColumn("_kind", kind)
    is_tab, is_tree, is_screen = (F.coalesce(F.col("_kind") == k, F.lit(False)) for k in ("browser_tab", "accessibility_snapshot", "ocr_summary"))
    none = F.expr("cast(array() as array<string>)")
    title = F.when(is_tab, F.col("_title")).when(is_screen, _clean(F.col("screen.window_title"), cfg.ocr_text_limit)).otherwise("")
    # a title's own line ends stay what they are, but mustn't look like the seam of two texts
    head = F.array(F.translate(title, "\n", "\x0b"), F.when(is_tab & (F.col("_tab.url_domain") != ""), F.col("_tab.url")).otherwise(""))
    df = df.withColumn("_raw", F.when(is_tree, F.col("_node_texts")).when(is_screen, F.col("_line_texts")).otherwise(none))
    df = redact(df.withColumn("_text", F.array_join(F.concat(head, "_raw"), _PART)), "_text", cfg, "_text_found")
    df = df.withColumn("_safe", F.split("_text", r"\n\|\n", -1))
    most = F.when(is_tree, cfg.accessibility_max_hints).otherwise(cfg.ocr_max_hints)
    df = df.withColumn("_told", _hints(F.transform(F.slice("_safe", 3, F.size("_raw")), lambda t: F.trim(t)), most))
    used = F.col("_told.used")
    # findings are of the lines read: they are counted again where something else was redacted with them
    apart = is_screen | (used < F.size("_raw"))
    df = redact(df.withColumn("_read", F.when(apart, F.array_join(F.slice("_raw", 1, used), _PART))), "_read", cfg, "_read_found")
    zero = F.expr(f"cast(map() as {_COUNTS})")
    policy = F.when(is_tab & (F.col("_tab.findings") > 0), F.create_map(F.lit("url"), F.col("_tab.findings"))).otherwise(zero)
    found = merged_findings(F.when(apart, F.col("_read_found")).otherwise(F.col("_text_found")), policy)
    shown_title, shown_url = F.translate(F.get("_safe", F.lit(0)), "\x0b", "\n"), F.get("_safe", F.lit(1))
    read = F.filter(F.slice("_lines", 1, used), lambda x: (_clean(x["text"], cfg.ocr_text_limit) != "") & x["confidence"].isNotNull())
    mean = F.when(is_screen, F.when(F.size(read) > 0, F.round(F.aggregate(read, F.lit(0.0), lambda a, x: a + x["confidence"]) / F.size(read), 3)).otherwise(0.0))
    held = F.struct(
        F.col("_kind").alias("kind"), shown_title.alias("title"), shown_url.alias("url"), F.when(is_tab, F.col("_tab.url_domain")).otherwise("").alias("url_domain"),
        F.when(is_tab, F.col("_tab.url_scheme")).otherwise("").alias("url_scheme"), F.col("_told.hints").alias("text_hints"), F.when(is_screen, _summary(F.col("_told.hints"))).otherwise("").alias("summary"),
        mean.alias("confidence"), F.when(is_tree, _roles(F.slice("_nodes", 1, used))).alias("roles"),
        F.when(is_tree, F.size("_nodes")).when(is_screen, F.size("screen.lines")).alias("elements"), found.alias("findings"),
    )
    return df.select(*(F.col(f"`{c}`") for c in kept), F.when(F.col("_kind").isNotNull(), held).alias("surface"))


def _payloads(window: Column) -> dict[str, Column]:
    """What connectors may ask: the window's title always, of the surfaces the one that told."""
    s, none = F.col("surface"), F.lit(None)
    of = lambda kind, **known: F.when(s["kind"] == kind, connectors.payload(**known)).otherwise(none)
    return {
        "window_title": F.when(F.col("action") == "focus", connectors.payload(title=window)),
        "browser_tab": of("browser_tab", title=s["title"], url_domain=s["url_domain"]),
        "accessibility": of("accessibility_snapshot", text_hints=s["text_hints"]),
        "ocr": of("ocr_summary", window_title=s["title"], summary=s["summary"], text_hints=s["text_hints"]),
    }


def assemble(samples: DataFrame, cfg: C.Config = C.Config(), manifests: list | None = None) -> DataFrame:
    """Event rows from samples: title, artifact, domain, action, times, surface, connector fields, and all findings added up.

    A tab's own title stands for the window's. Hints help to find the domain.
    Ignored apps are system events, or none at all if the settings say so. While
    collection is paused there are no rows. ``manifests`` are the connectors to ask; none by default.
    """
    ignored = F.coalesce(is_ignored(F.col("app"), cfg.ignored_apps), F.lit(False))
    further = [F.col(f"`{c}`") for c in samples.columns if c not in _MADE and c not in _OWN]
    samples = samples.select(*_OWN, *further)
    df = surface(samples, cfg).withColumn("action", F.when(ignored, "system").otherwise("focus"))
    if cfg.collection_paused:
        df = df.where("false")
    elif not cfg.record_ignored:
        df = df.where("action = 'focus'")
    raw = F.coalesce("title", F.lit(""))
    df = df.withColumn("_window", scrub_title(raw, cfg))
    tab = F.when(F.col("surface.kind") == "browser_tab", F.col("surface.title"))
    chosen = scrub_title(F.coalesce(F.nullif(tab, F.lit("")), raw), cfg)
    df = df.withColumn("_shown", F.when(ignored, F.concat(F.lit("[system state: "), "app", F.lit("]"))).otherwise(chosen))
    hint = F.concat_ws(" ", "_shown", "surface.url_domain", tab, F.array_join(F.slice("surface.text_hints", 1, 4), " "))
    df = df.withColumn("domain", F.when(ignored, "system").otherwise(classify_domain(F.coalesce("app", F.lit("")), hint, cfg.domain_rules)))
    df = redact(df, "_shown", cfg, "_shown_findings")
    zero = F.expr(f"cast(map() as {_COUNTS})")
    found = [F.col("_shown_findings"), F.coalesce("surface.findings", zero)]
    if manifests:
        told = _payloads(F.col("_window"))
        if not cfg.capture_title:
            del told["window_title"]
        df = connectors.apply(df, told, cfg.capture_depth, manifests, cfg)
        df = df.withColumn("structured", F.when(F.col("action") == "focus", F.col("structured")))
        found.append(F.coalesce("structured.redaction_findings", zero))
    dwell = F.coalesce(F.col("dwell"), F.lit(0.0))
    start = F.timestamp_micros(F.unix_micros(F.col("ts_end").cast("timestamp")) - F.round(F.greatest(dwell, F.lit(0.1)) * 1000000).cast("bigint")).cast(samples.schema["ts_end"].dataType)
    return df.select(
        "id", "subject_id", "app", F.col("_shown").alias("title"), F.coalesce(F.nullif("_shown", F.lit("")), F.col("app")).alias("artifact"), "domain", "action", start.alias("ts_start"), "ts_end", dwell.alias("dwell"),
        "surface", *(["structured"] if manifests else []), merged_findings(*found).alias("findings"), *further,
    )
