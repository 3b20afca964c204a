"""Golden rows of the analytics operators; the registered queries against DuckDB."""

import os
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from focusloom.config import Config
from focusloom.functions import text as T
from focusloom.operators import collective, learning, resume, spheres
from focusloom.plans import catalogue, handoff, workbench  # noqa: F401, the others add their queries
from focusloom.sources import crypto, tables
from focusloom.streaming import ingest

SF = "/root/testdata/sf0.001"
BASE = datetime(2024, 1, 10, 9)


def trace(spark, rows, domain="coding"):
    """rows: (minute, artifact, dwell seconds)."""
    out = [(i, "s", "App", a, domain, "focus", BASE + timedelta(minutes=m), BASE + timedelta(minutes=m, seconds=d), float(d)) for i, (m, a, d) in enumerate(rows)]
    return spark.createDataFrame(out, "id long, subject_id string, app string, artifact string, domain string, action string, ts_start timestamp_ntz, ts_end timestamp_ntz, dwell double")


def redacted(spark, value, **cfg):
    row = T.redact(spark.createDataFrame([(value,)], "t string"), "t", Config(**cfg)).first()
    return row["t"], row["findings"]


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(0, "A", 300), (60, "slack", 300), (70, "A", 300)], [600.0]),
        ([(6 * i, "A", 300) for i in range(6)], []),
        ([(0, "A", 300), (60, "slack", 300), (70, "A", 5), (90, "A", 400)], [1800.0]),
        ([(0, "A", 300), (60, "slack", 300), (120, "email", 300)], []),
        ([(0, "A", 300), (12, "A", 300)], []),
        ([(0, "alpha", 120), (2, "beta", 1200), (22, "alpha", 120)], [1200.0]),
    ],
)
def test_resume(spark, rows, want):
    got = resume.resume_events(resume.runs(trace(spark, rows))).collect()
    assert [r["resume_seconds"] for r in got] == want


def test_distribution(spark):
    r = resume.distribution(spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40, 1000)], "v double"), "v").first()
    assert (r["median"], r["p90"], r["most"]) == (30, 1000, 1000)
    r = resume.distribution(spark.createDataFrame([], "v double"), "v").first()
    assert r["n"] == 0 and r["median"] is None


def test_redaction(spark):
    text, found = redacted(spark, "Ana wrote ana@x.org to Ana: 4111 1111 1111 1111, 123-45-6789, 10.0.0.1, +1 555 123 4567, https://Ex.com:8/a?t=1 sk-abcdefghijklmnop1234", names=("Ana",))
    for secret in ("Ana", "ana@", "4111", "6789", "10.0.0.1", "555", "t=1", "sk-abc"):
        assert secret not in text
    assert found["credit_card"] == 1 and found["email"] == 1 and found["name"] == 2 and "https://ex.com/[redacted-path]" in text
    for same in ("reference 4111 1111 1111 1112", "build 7 of 9 today", "sprint/42 ticket 118"):
        assert redacted(spark, same) == (same, {})
    assert redacted(spark, "Invoice 3 4111 1111 1111 1111")[0] == "Invoice 3 [credit-card]"
    assert redacted(spark, "draft 3 378282246310005 review")[0] == "draft 3 [credit-card] review"
    assert redacted(spark, "amex 3782 822463 10005")[0] == "amex [credit-card]"
    assert redacted(spark, text)[0] == text


def test_spheres(spark):
    rows = spheres.assign(trace(spark, [(0, "task model induction arxiv paper", 15), (1, "inbox zero", 15), (2, "task model induction arxiv paper", 15)])).orderBy("id").collect()
    assert [r["sphere_ordinal"] for r in rows] == [0, 1, 0]
    rows = spheres.assign(trace(spark, [(0, "[redacted sensitive title]", 15)] * 3)).collect()
    assert {r["sphere_ordinal"] for r in rows} == {0, 1, 2} and len({r["sphere_id"] for r in rows}) == 1


def test_streamed_spheres_equal_batch(spark, tmp_path):
    e = catalogue.events(spark, SF).where("subject_id in ('1', '2', '3')")
    features = spheres.features(e)
    features.orderBy("ts_start").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.assign_spheres(spark.readStream.schema(features.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("assigned").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("assigned").collect())) == sorted(map(tuple, spheres.assign(e).collect()))


def streamed(spark, tmp_path, df, name):
    """The rows of a stream over the files in tmp_path/in, a trigger for each."""
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
    q.awaitTermination()
    return sorted(map(tuple, spark.table(name).collect()))


def test_streamed_spheres_are_forgotten(spark, tmp_path):
    day = 24 * 60
    features = spheres.features(trace(spark, [(0, "task model induction arxiv paper", 15), (day, "task model induction arxiv paper", 15), (60 * day, "task model induction arxiv paper", 15)]))
    for i in range(3):  # one after the other: a stream takes files in order of time
        features.where(F.col("id") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(features.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    known = [r[4] > 0.52 for r in streamed(spark, tmp_path, ingest.assign_spheres(source()), "kept")]
    assert known == [False, True, True]
    known = [r[4] > 0.52 for r in streamed(spark, tmp_path, ingest.assign_spheres(source(), keep_days=14), "forgotten")]
    assert known == [False, True, False]


def test_streamed_sessions(spark, tmp_path):
    rows = trace(spark, [(0, "a", 600), (20, "b", 60), (50, "c", 60), (52, "d", 60), (10_000, "e", 60)])
    want = [("s", 0, 21, 660.0, 2), ("s", 50, 53, 120.0, 2), ("s", 10_000, 10_001, 60.0, 1)]
    minutes = lambda got: [(r[0], *((t - BASE).total_seconds() / 60 for t in r[1:3]), *r[3:]) for r in got]
    assert minutes(sorted(map(tuple, ingest.sessions(rows).collect()))) == want
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = streamed(spark, tmp_path, ingest.sessions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), "sessions")
    assert minutes(got) == want[:2]  # the last is still open


def test_streaming_ingest_redacts_before_writing(spark, tmp_path):
    spark.createDataFrame([(1, "s", "Mail", "note to ana@x.org", BASE, BASE, 15.0), (2, "s", "loginwindow", "x", BASE, BASE, 15.0)], ingest.RAW).write.parquet(str(tmp_path / "raw"))
    q = ingest.start(spark.readStream.schema(ingest.RAW).parquet(str(tmp_path / "raw")), str(tmp_path / "out"), str(tmp_path / "c"), once=True)
    q.awaitTermination()
    rows = {r["id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows[1]["title"] == "note to [email]" and rows[1]["domain"] == "communication" and rows[2]["action"] == "system"


def test_retention_and_encryption(spark, tmp_path):
    path = str(tmp_path / "events")
    tables.write_events(trace(spark, [(0, "a@b.co", 1), (60, "b", 1), (60 * 30, "c", 1)]), path)
    assert {r["artifact"] for r in spark.read.parquet(path).collect()} == {"[email]", "b", "c"}
    tables.delete_before(spark, path, str(BASE + timedelta(minutes=30)))
    assert {r["artifact"] for r in spark.read.parquet(path).collect()} == {"b", "c"}
    key = b"0123456789abcdef0123456789abcdef"
    row = spark.createDataFrame([("plain",)], "v string").select(crypto.encrypt(F.col("v"), key).alias("e")).select("e", crypto.decrypt(F.col("e"), key).alias("d")).first()
    assert row["e"].startswith(crypto.PREFIX) and row["d"] == "plain"


def test_collective(spark):
    work = spark.createDataFrame([(str(i), "coding:review", 5, 60.0) for i in range(3)], "subject_id string, theme string, events long, dwell double")
    assert collective.themes(work, 5).count() == 0 and collective.withheld(work, 5).first()["band"] == "1-2"
    with pytest.raises(ValueError):
        collective.themes(work, 1)
    masked = collective.masked(collective.contributions(work), b"k", "r")
    assert {r["theme"]: r["total"] for r in collective.secure_sum(masked).collect()}["coding:review"] == 3
    with pytest.raises(Exception, match="masks do not cancel"):
        collective.secure_sum(masked.where("subject_id <> '0'")).collect()
    assert collective.discrete_laplace(0) == 0


def test_private_feedback_without_a_sphere_blocks_all(spark):
    packs = spark.createDataFrame([("p1", "s1", "k1"), ("p2", "s2", "k2")], "pack_id string, sphere_id string, evidence_key string")
    schema = "label string, sphere_id string, pack_id string, evidence_key string, resolved_at string"
    blocked = lambda rows: {r[0] for r in learning.blocked_packs(packs, spark.createDataFrame(rows, schema)).collect()}
    assert blocked([("too_private", "s1", None, None, None)]) == {"p1"}
    assert blocked([("too_private", None, None, None, None)]) == {"p1", "p2"}
    assert blocked([("too_private", "s1", None, None, "2024")]) == set()


def test_restrictions_by_label_and_subject(spark):
    packs = spark.createDataFrame([("p1", "u", "s1", "k1"), ("p2", "u", "s2", "k2"), ("p3", "v", "s3", "k3")], "pack_id string, subject_id string, sphere_id string, evidence_key string")
    schema = "label string, subject_id string, sphere_id string, pack_id string, evidence_key string, resolved_at string"
    blocked = lambda *rows: {r[0] for r in learning.blocked_packs(packs, spark.createDataFrame(list(rows), schema)).collect()}
    assert blocked(("wrong", "u", "s1", None, None, None)) == {"p1"} == blocked(("stale", "u", None, "p1", None, None))
    assert blocked(("too_private", "u", "gone", "old", None, None)) == {"p1", "p2"}  # its sphere is lost: the objection stays
    assert blocked(("wrong", "u", "gone", None, None, None), ("useful", "u", "s1", None, None, None), ("too_broad", "u", "s1", None, None, None)) == set()
    assert blocked(("too_private", "u", "s1", None, None, None), ("stale", "v", None, None, "k3", None)) == {"p1", "p3"}
    assert blocked(("wrong", "v", "s1", None, None, None)) == set()  # another subject's
    assert blocked(("too_private", "u", "gone", None, None, "2024")) == set()


def test_masked_and_sensitive_work_is_never_counted(spark):
    schema = "subject_id string, theme string, events long, dwell double, gate_mode string, sensitivity string"
    rows = [(str(i), "coding:review", 1, 60.0, *how) for i, how in enumerate([("allowed", "low")] * 2 + [("masked", "medium"), ("generalized", "low"), ("allowed", "high")] * 4)]
    work = spark.createDataFrame(rows + [("", "coding:review", 1, 1.0, "allowed", "low"), ("0", "coding:review", 1, 1.0, None, None)], schema)
    assert [(r.subjects, r.events) for r in collective.themes(work, 2).collect()] == [(2, 3)] and collective.themes(work, 3).count() == 0
    assert collective.synthesis(work, 3).first()[:5] == ("below_floor", 14, 0, 0, "1-2")
    counted = {(r.subject_id, r.value) for r in collective.contributions(work, 5).where("theme = 'coding:review'").collect()}
    assert {("0", 2), ("1", 1), ("2", 0), ("13", 0)} <= counted and sum(v for _, v in counted) == 3
    many = spark.createDataFrame([("0", "coding:review")] * 50, "subject_id string, theme string")
    assert collective.contributions(many).agg(F.max("value")).first()[0] == 1


def same(spark, name, build, sql):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    norm = lambda v: round(float(v), 6) if type(v).__name__ in ("float", "Decimal") else str(v)
    df = build(spark, SF)
    cols = sorted(df.columns)
    ours = sorted(str([norm(r[c]) for c in cols]) for r in df.collect())
    cur = con.execute(sql)
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == cols
    assert ours == sorted(str([norm(r[theirs.index(c)]) for c in cols]) for r in cur.fetchall()), name


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    same(spark, name, catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, name):
    rows = catalogue.QUERIES[name](spark, SF).collect()
    assert rows and all(any(v is not None for v in r) for r in rows[:100])
