"""Streamed sessions against the batch form, over files in disorder; exact gaps, long events, late rows, bounded state."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from focusloom.streaming import ingest

BASE = datetime(2024, 1, 1)
ROWS = "id long, subject_id string, ts_start timestamp_ntz, ts_end timestamp_ntz, dwell double, artifact string, app string"


def at(minutes):
    return BASE + timedelta(minutes=minutes)


def told(spark, tmp_path, files, gap=15, late="2 hours"):
    """What a stream over the files, one a trigger, tells; and the rows of state kept after each trigger."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"f{i:03}"))
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = ingest.sessions(stream, gap, late).writeStream.format("memory").queryName(tmp_path.name.replace("-", "_")).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    kept = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    return sorted(map(tuple, spark.table(tmp_path.name.replace("-", "_")).collect())), kept


def batch(spark, rows, gap=15):
    return sorted(map(tuple, ingest.sessions(spark.createDataFrame(rows, ROWS), gap).collect()))


def event(i, start, length, subject="s"):
    return (i, subject, at(start), at(start + length), float(60 * length), "a", "b")


def test_streamed_sessions_equal_batch(spark, tmp_path):
    r = random.Random(4)
    rows, now = [], {"s": 0, "t": 0}
    for i in range(240):
        subject = r.choice("st")
        now[subject] += r.choice([1, 3, 14, 15, 16, 40])
        rows.append(event(i, now[subject], r.choice([0, 0, 1, 5, 90]), subject))
    rows.sort(key=lambda x: x[2])
    files = [rows[k : k + 40] for k in range(0, 240, 40)]
    for k in range(0, 5):  # neighbours trade rows within the time allowed: files come in disorder
        files[k][-8:], files[k + 1][:8] = files[k + 1][:8], files[k][-8:]
    for f in files:
        r.shuffle(f)
    end = [event(999, 10**6, 1, s) for s in "st"]  # moves the watermark past all others
    got, kept = told(spark, tmp_path, [*files, end], late="100 days")
    assert got == [s for s in batch(spark, rows + end) if s[1] < at(10**6)] and len(got) > 20
    assert kept[-1] <= 2 * 4  # but for the last rows all was forgotten: what is kept doesn't grow with the stream


def test_the_gap_itself_parts_and_a_long_event_holds_together(spark, tmp_path):
    rows = [event(1, 0, 5), event(2, 20, 1), event(3, 30, 60), event(4, 35, 1), event(5, 104, 1), event(6, 120, 1)]
    minutes = [((s[1] - BASE).seconds // 60, (s[2] - BASE).seconds // 60) for s in batch(spark, rows)]
    assert minutes == [(0, 5), (20, 105), (120, 121)]
    got, _ = told(spark, tmp_path, [rows, [event(7, 10**5, 1)]])
    assert got == batch(spark, rows)


def test_late_rows_are_left_out(spark, tmp_path):
    files = [[event(1, 0, 1), event(2, 1000, 1)], [event(3, 1001, 1)], [event(4, 5, 1), event(5, 10**5, 1)]]
    got, _ = told(spark, tmp_path, files, late="1 hour")
    assert got == batch(spark, [event(1, 0, 1), event(2, 1000, 1), event(3, 1001, 1)])
