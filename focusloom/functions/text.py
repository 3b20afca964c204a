"""Text functions as Columns: classification, redaction, normalisation, tokens, ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from focusloom import config as C

# Patterns of personal data (Unicode words and digits, as (?U) says).
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
PHONE = r"(?U)(?<!\w)(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}(?!\w)"
URL = r"(?i)https?://[^\s<>'\"]+"
CARD = r"(?<![\d-])(?:\d{13,19}|\d{3,6}(?:[ -]\d{3,6}){1,5})(?![\d-])"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
SECRET = r"(?i)\b(?:sk-[a-z0-9_-]{16,}|gh[pousr]_[a-z0-9_-]{16,}|xox[baprs]-[a-z0-9_-]{16,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{20,}|eyJ[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})\b"


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, w: a | text.contains(w.lower()), words, F.lit(False))


def first_match(text: Column, pairs, otherwise: Column) -> Column:
    """The value of the first pair whose keyword stands in the text."""
    return reduce(lambda rest, p: F.when(text.contains(p[0]), F.lit(p[1])).otherwise(rest), reversed(list(pairs)), otherwise)


def lookup(key: Column, values: dict, otherwise: str) -> Column:
    return reduce(lambda rest, p: F.when(key == p[0], F.lit(p[1])).otherwise(rest), values.items(), F.lit(otherwise))


def classify_domain(app: Column, title: Column, rules=C.DOMAIN_RULES) -> Column:
    text = F.lower(F.concat_ws(" ", app, title))
    out = F.lit("other")
    for domain, apps, keywords in reversed(rules):
        out = F.when(F.lower(app).isin([a.lower() for a in apps]) | contains_any(text, keywords), domain).otherwise(out)
    return out


def is_ignored(app: Column, apps=C.IGNORED_APPS) -> Column:
    return F.lower(app).isin([a.lower() for a in apps])


def scrub_title(title: Column, cfg: C.Config = C.Config()) -> Column:
    if not cfg.capture_title:
        return F.lit(C.NO_TITLE)
    if not cfg.redact_titles:
        return title
    squeezed = F.substring(F.trim(F.regexp_replace(title, r"\s+", " ")), 1, cfg.title_limit)
    return F.when(contains_any(F.lower(title), cfg.sensitive_keywords), C.REDACTED_TITLE).otherwise(squeezed)


def graph_task(domain: Column, title: Column, artifact: Column) -> Column:
    return first_match(F.lower(F.concat_ws(" ", title, artifact)), C.GRAPH_TASKS, lookup(domain, C.GRAPH_TASK_BY_DOMAIN, "unclassified work"))


def sphere_task(domain: Column, title: Column, artifact: Column) -> Column:
    return first_match(F.lower(F.concat_ws(" ", title, artifact)), C.SPHERE_TASKS, lookup(domain, C.SPHERE_TASK_BY_DOMAIN, "unclassified work"))


def _gate(mode: str, sensitivity: str, reason: Column | str) -> Column:
    return F.struct(F.lit(mode).alias("mode"), F.lit(sensitivity).alias("sensitivity"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def _found_gate(findings: Column | None) -> Column:
    """The gate of a text from which redaction took something; findings: its map of counts, to name what."""
    names = F.lit("") if findings is None else F.array_join(F.array_sort(F.map_keys(findings)), ", ")
    return _gate("masked", "medium", F.concat(F.lit("redaction findings: "), names))


# Reasons.
_HIDDEN = ("generalized", "low", "window title capture is disabled")
_REPLACED = ("masked", "high", "sensitive window title was replaced")
_MARKED = ("masked", "medium", "label contains a redaction placeholder")


def gate_for_label(label: Column, has_findings: Column, findings: Column | None = None) -> Column:
    """The graph's gate (mode, sensitivity, reason): a title that isn't captured comes first."""
    text = F.lower(label)
    return (
        F.when(text.contains(C.NO_TITLE), _gate(*_HIDDEN)).when(text.contains(C.REDACTED_TITLE), _gate(*_REPLACED)).when(has_findings, _found_gate(findings))
        .when(contains_any(text, C.PLACEHOLDERS), _gate(*_MARKED)).otherwise(_gate("allowed", "low", "metadata allowed by current graph depth"))
    )


def gate_for_event(title: Column, artifact: Column, has_findings: Column, findings: Column | None = None) -> Column:
    """The spheres' gate (mode, sensitivity, reason): a sensitive title comes first, a title that isn't captured last."""
    text = F.lower(F.concat_ws(" ", title, artifact))
    return (
        F.when(text.contains(C.REDACTED_TITLE), _gate(*_REPLACED)).when(has_findings, _found_gate(findings)).when(contains_any(text, C.PLACEHOLDERS), _gate(*_MARKED))
        .when(text.contains(C.NO_TITLE), _gate(*_HIDDEN)).otherwise(_gate("allowed", "low", "redacted metadata allowed by current policy"))
    )


def redact_secrets(text: Column) -> Column:
    return F.regexp_replace(text, SECRET, "[secret]")


def redact_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "[email]")


def redact_ssns(text: Column) -> Column:
    return F.regexp_replace(text, SSN, "[ssn]")


def redact_phones(text: Column) -> Column:
    return F.regexp_replace(text, PHONE, "[phone]")


def redact_ips(text: Column) -> Column:
    return F.regexp_replace(text, IPV4, "[ip-address]")


def redact_urls(text: Column) -> Column:
    """scheme://host/[redacted-path], without user, port, path and query; host in lower case."""
    hits = F.regexp_extract_all(text, F.lit(URL), 0)
    parts = r"(?i)^(https?)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"
    shown = F.transform(hits, lambda u: F.concat(F.lower(F.regexp_extract(u, parts, 1)), F.lit("://"), F.coalesce(F.nullif(F.lower(F.regexp_extract(u, parts, 2)), F.lit("")), F.lit("url")), F.lit("/[redacted-path]")))
    return _woven(text, URL, shown)


def _woven(text: Column, pattern: str, shown: Column) -> Column:
    """The text with its matches replaced, one by one, by the elements of an array."""
    return F.array_join(F.zip_with(F.split(text, pattern, -1), shown, lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit("")))), "")


def card_hits(text: Column) -> Column:
    """Each candidate of the card pattern, with whether it is a card."""
    digits = F.transform(F.regexp_extract_all(text, F.lit(CARD), 0), lambda c: F.struct(c.alias("text"), F.regexp_replace(c, r"\D", "").alias("digits")))
    return F.transform(digits, lambda c: F.struct(c["text"].alias("text"), (F.length(c["digits"]).between(13, 19) & F.call_function("luhn_check", c["digits"])).alias("card")))


def redact_cards(text: Column) -> Column:
    return _woven(text, CARD, F.transform(card_hits(text), lambda c: F.when(c["card"], "[credit-card]").otherwise(c["text"])))


def redact_names(text: Column, names) -> Column:
    for term in sorted({n.strip() for n in names}, key=lambda n: (-len(n), n)):
        if len(term) >= 3:
            text = F.regexp_replace(text, rf"(?i)(?<![A-Za-z0-9_-])\Q{term}\E(?![A-Za-z0-9_-])", "[name]")
    return text


#: The order in which redactions apply.
REDACTIONS = (("secret", redact_secrets), ("credit_card", redact_cards), ("email", redact_emails), ("ssn", redact_ssns), ("phone", redact_phones), ("ip_address", redact_ips), ("url", redact_urls))
_MARKS = {"secret": "[secret]", "credit_card": "[credit-card]", "email": "[email]", "ssn": "[ssn]", "phone": "[phone]", "ip_address": "[ip-address]"}


def redact(df, column: str, cfg: C.Config = C.Config(), findings: str = "findings"):
    """Replaces ``column`` by its redacted text and adds the counts by category (those over 0).

    Each step is a column of its own, named twice by the next, so that Spark
    evaluates it once. With mask_pii off texts stay as they are and nothing counts.
    """
    if not cfg.mask_pii:
        return df.withColumn(findings, F.expr("cast(map() as map<string,int>)"))
    counts = []
    for name, step in REDACTIONS:
        if name == "ip_address" and not cfg.mask_ip or name == "url" and not cfg.redact_urls:
            continue
        if name == "url":
            counts.append((name, f"_n_{name}"))
            df = df.withColumn(f"_n_{name}", F.regexp_count(column, F.lit(URL)))
            df = df.withColumn(column, step(F.col(column)))
            continue
        before = F.regexp_count(column, F.lit(rf"\Q{_MARKS[name]}\E"))
        df = df.withColumn("_after", step(F.col(column))).withColumn(f"_n_{name}", F.regexp_count("_after", F.lit(rf"\Q{_MARKS[name]}\E")) - before).withColumn(column, F.col("_after")).drop("_after")
        counts.append((name, f"_n_{name}"))
    if cfg.names:
        df = df.withColumn("_after", redact_names(F.col(column), cfg.names)).withColumn("_n_name", F.regexp_count("_after", F.lit(r"\Q[name]\E")) - F.regexp_count(column, F.lit(r"\Q[name]\E"))).withColumn(column, F.col("_after")).drop("_after")
        counts.append(("name", "_n_name"))
    pairs = F.create_map(*(x for name, c in counts for x in (F.lit(name), F.coalesce(F.col(c), F.lit(0)))))
    return df.withColumn(findings, F.map_filter(pairs, lambda _, v: v > 0)).drop(*(c for _, c in counts))


def normalize_artifact(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), r"\[[^\]]+\]", " ")
    out = F.regexp_replace(out, r"https?://\S+", " ")
    return F.trim(F.regexp_replace(out, r"[^a-z0-9]+", " "))


def sphere_tokens(text: Column) -> Column:
    words = F.split(normalize_artifact(text), " ")
    return F.slice(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(list(C.SPHERE_STOPWORDS)) & ~w.rlike("^[0-9]+$")), 1, 24)


def query_tokens(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[a-zA-Z0-9][a-zA-Z0-9._-]+"), 0), F.lower)))


def theme_key(domain: Column, label: Column) -> Column:
    words = F.filter(F.transform(F.regexp_extract_all(label, F.lit(r"[a-zA-Z][a-zA-Z0-9-]{2,}"), 0), F.lower), lambda w: ~w.isin(list(C.THEME_STOPWORDS)))
    top = F.slice(F.array_sort(F.array_distinct(words)), 1, 3)
    return F.concat(F.lower(domain), F.lit(":"), F.when(F.size(top) > 0, F.array_join(top, "-")).otherwise("general"))


def shorten(text: Column, limit: int) -> Column:
    squeezed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(squeezed) <= limit, squeezed).otherwise(F.concat(F.rtrim(F.substring(squeezed, 1, limit - 3)), F.lit("...")))


def stable_id(kind: str, label: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha1(F.concat(F.lit(f"{kind}:"), F.lower(label))), 1, 12))


def json_string(text: Column) -> Column:
    """A string as canonical JSON: quoted, all but printable ASCII escaped, null as null."""
    code = lambda c: F.lower(F.hex(F.encode(c, "UTF-16BE")))
    # The short escapes.
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def sign(c: Column) -> Column:
        out = F.when(c.rlike(r"^[\x20-\x7e]$"), c).when(F.length(code(c)) > 4, F.concat(F.lit("\\u"), F.substring(code(c), 1, 4), F.lit("\\u"), F.substring(code(c), 5, 4))).otherwise(F.concat(F.lit("\\u"), code(c)))
        for plain, escaped in short.items():
            out = F.when(c == plain, F.lit(escaped)).otherwise(out)
        return out

    inner = F.when(text.rlike(r"^[\x20\x21\x23-\x5b\x5d-\x7e]*$"), text).otherwise(F.array_join(F.transform(F.split(text, ""), sign), ""))
    return F.when(text.isNull(), "null").otherwise(F.concat(F.lit('"'), inner, F.lit('"')))


def json_cents(value: Column) -> Column:
    """A number of at most two decimals as canonical JSON: without idle zeros, but with one decimal."""
    text = F.regexp_replace(value.cast("decimal(28,2)").cast("string"), r"(\.\d)0$", "$1")
    return F.coalesce(text, F.lit("null"))


def json_list(parts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def stable_key(prefix: str, *parts: Column) -> Column:
    """What names evidence: a hash of its parts, given in canonical JSON."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(json_list(F.array(*parts)), 256), 1, 16))


def subject_key(subject: Column) -> Column:
    return F.concat(F.lit("subj_"), F.substring(F.sha2(subject, 256), 1, 12))


def time_bucket(ts: Column) -> Column:
    return F.date_format(F.date_trunc("hour", ts), "yyyy-MM-dd HH:00")


def sanitize_url(url: Column, cfg: C.Config = C.Config()) -> Column:
    """struct(url, domain, scheme, findings): path and query by policy; user and fragment never stay."""
    pattern = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    part = lambda i: F.regexp_extract(F.trim(url), pattern, i)
    scheme, user, netloc, path, query, fragment = (part(i) for i in range(1, 7))
    host = F.lower(F.regexp_replace(netloc, r":\d*$", ""))
    shown_path = path if cfg.store_url_path else F.when(path != "", "/[redacted-path]").otherwise("")
    shown_query = F.when(query != "", F.concat(F.lit("?"), query)).otherwise("") if cfg.store_url_query else F.lit("")
    count = sum((F.when(x, 1).otherwise(0) for x in ((path != "") & F.lit(not cfg.store_url_path), (query != "") & F.lit(not cfg.store_url_query), fragment != "", user != "")), F.lit(0))
    return F.struct(F.concat(F.lower(scheme), F.lit("://"), F.when(user != "", host).otherwise(netloc), shown_path, shown_query).alias("url"), host.alias("url_domain"), F.lower(scheme).alias("url_scheme"), count.alias("findings"))
