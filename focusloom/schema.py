"""The canonical event and the adapter from the driver's ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
_WORDS = ("gateway", "retry", "ledger", "invoice", "render", "cedar", "juniper", "schema", "budget", "roadmap", "parser")
#: Event type -> domain.
_DOMAINS = {"click": "coding", "view": "browser-research", "purchase": "planning", "signup": "communication", "error": "system"}

EVENT = "id bigint, subject_id string, app string, title string, artifact string, domain string, action string, ts_start timestamp_ntz, ts_end timestamp_ntz, dwell decimal(18,2), findings map<string,int>"


def as_of_column(as_of: str = AS_OF) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def adapt(raw: DataFrame) -> DataFrame:
    """Canonical events from (event_id, ts, user_id, event_type, value, props)."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    word = lambda at: F.element_at(F.array(*map(F.lit, _WORDS)), at)
    domain = F.lit(None).cast("string")
    for kind, name in _DOMAINS.items():
        domain = F.when(F.col("event_type") == kind, name).otherwise(domain)
    artifact = F.concat(F.lit("artifact "), (k % 20).cast("string"), F.lit(" "), word(1 + k % 5), F.lit(" "), word(6 + k % 6))
    return raw.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("subject_id"), F.concat(F.lit("app"), (k % 7).cast("string")).alias("app"), artifact.alias("artifact"),
        domain.alias("domain"), F.when(F.col("event_type") == "error", "system").otherwise("focus").alias("action"), F.col("ts").alias("ts_start"),
        F.expr("ts + make_dt_interval(0, 0, 0, cast(value as decimal(18,6)))").alias("ts_end"), F.col("value").cast("decimal(18,2)").alias("dwell"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt(spark.read.parquet(f"{sf_dir}/events.parquet"))


#: The same adapter in DuckDB's SQL, as the body of a CTE.
EVENTS_SQL = """
SELECT event_id AS id, CAST(user_id AS VARCHAR) AS subject_id, 'app' || (k % 7) AS app,
       'artifact ' || (k % 20) || ' ' || w[1 + k % 5] || ' ' || w[6 + k % 6] AS artifact,
       CASE event_type WHEN 'click' THEN 'coding' WHEN 'view' THEN 'browser-research' WHEN 'purchase' THEN 'planning' WHEN 'signup' THEN 'communication' WHEN 'error' THEN 'system' END AS domain,
       CASE WHEN event_type = 'error' THEN 'system' ELSE 'focus' END AS action,
       ts AS ts_start, ts + to_microseconds(CAST(value * 1000000 AS BIGINT)) AS ts_end, CAST(value AS DECIMAL(18,2)) AS dwell
FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k,
             ['gateway','retry','ledger','invoice','render','cedar','juniper','schema','budget','roadmap','parser'] AS w FROM events)
"""
