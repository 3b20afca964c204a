"""The growing logs: every line once over restarts and pauses, in pieces of any size; settings read anew; broken lines put aside."""

import json
import random

from pyspark.sql import functions as F

from focusloom import config as C
from focusloom.streaming import collector


def sample(i, title="t"):
    return json.dumps({"id": i, "subject_id": "s", "app": "Code", "title": f"{title} {i} a@b.org", "ts_end": "2024-05-01T12:00:00Z", "dwell": 2.0}) + "\n"


def append(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("ab") as f:
        f.write(text.encode())


def test_pieces_of_any_size_hold_each_line_once(tmp_path):
    r = random.Random(2)
    log = "".join("x" * r.choice([0, 1, 5, 40]) + "\n" for _ in range(200)) + "without an end"
    append(tmp_path / "in" / "d" / "a.jsonl", log)
    append(tmp_path / "in" / "b.other", "no\n")
    want = [x for x in log.split("\n")[:-1] if x]
    for size in (1, 2, 3, 7, 64, 10**6):
        reader = collector._Reader({"path": str(tmp_path / "in"), "state": str(tmp_path / "st"), "settings": str(tmp_path / "none"), "piece_bytes": size})
        end = reader.latestOffset()
        assert end == {"d/a.jsonl": len(log) - len("without an end")}
        cut = log.index("\n", 300) + 1
        got = [row for a, b in (({}, {"d/a.jsonl": cut}), ({"d/a.jsonl": cut}, end)) for p in reader.partitions(a, b) for row in reader.read(p)]
        assert [g[2] for g in got] == want and all(log[g[1] :].startswith(g[2] + "\n") for g in got)
        assert reader.partitions(end, end) == []


def test_pause_holds_the_place_over_a_new_start(tmp_path):
    logs, cfg = tmp_path / "in", tmp_path / "c.json"
    new = lambda: collector._Reader({"path": str(logs), "state": str(tmp_path / "st"), "settings": str(cfg)})
    assert new().latestOffset() == {}  # no folder yet
    append(logs / "a.jsonl", "1\n2\n")
    first = new()
    assert first.latestOffset() == {"a.jsonl": 4}
    cfg.write_text(C.dump(C.Config(collection_paused=True)))
    append(logs / "a.jsonl", "3\n")
    assert first.latestOffset() == {"a.jsonl": 6}  # the pause begins here
    append(logs / "a.jsonl", "4\n")
    append(logs / "b.jsonl", "5\n")
    assert first.latestOffset() == new().latestOffset() == {"a.jsonl": 6}
    cfg.write_text(C.dump(C.Config()))
    assert new().latestOffset() == {"a.jsonl": 8, "b.jsonl": 2}
    cfg.write_text(C.dump(C.Config(collection_paused=True)))
    append(logs / "b.jsonl", "6\n")
    assert new().latestOffset() == {"a.jsonl": 8, "b.jsonl": 4}  # not where the pause before stood


def test_collector_restarts_reloads_and_puts_aside(spark, tmp_path):
    logs, cfg, table = tmp_path / "in", tmp_path / "c.json", str(tmp_path / "events")

    def run():
        collector.collect(spark, str(logs), str(cfg), table, str(tmp_path / "cp"), once=True, piece_bytes=100).awaitTermination()
        return [tuple(r) for r in spark.read.parquet(table).orderBy("id").select("id", "title").collect()]

    append(logs / "a.jsonl", sample(1) + sample(2) + "not json\n" + sample(3)[:40])
    assert run() == [(1, "t 1 [email]"), (2, "t 2 [email]")]
    append(logs / "a.jsonl", sample(3)[40:])
    append(logs / "b.jsonl", sample(4, "my password"))
    cfg.write_text(C.dump(C.Config(mask_pii=False)))  # taken up without a change of the code
    want = [(1, "t 1 [email]"), (2, "t 2 [email]"), (3, "t 3 a@b.org"), (4, C.REDACTED_TITLE)]
    assert run() == want
    cfg.write_text(C.dump(C.Config(collection_paused=True)))
    run()  # the pause is seen
    append(logs / "a.jsonl", sample(5))
    assert run() == want
    cfg.write_text(C.dump(C.Config()))
    assert run() == [*want, (5, "t 5 [email]")] == run()
    bad = spark.read.parquet(table + "_rejected").select("broken", F.col("log")).collect()
    assert [tuple(r) for r in bad] == [("not json", "a.jsonl")]
