"""Encryption, key changes, and tables that a crash leaves half moved."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from focusloom.config import Config
from focusloom.functions import text as T
from focusloom.sources import crypto, files, maintenance, tables
from tests.test_operators import BASE, trace

ONE, TWO = "00" * 32, "11" * 32


def test_encrypt_rekey_decrypt(spark):
    rows = spark.createDataFrame([("plain",), ("",), (None,), ("café " * 50,), (crypto.PREFIX,)], "v string")
    sealed = rows.where("v is null or v <> 'enc:v1:'").select(crypto.encrypt(F.col("v"), bytes.fromhex(ONE)).alias("v"))
    assert {r.v for r in sealed.collect() if not r.v} == {None, ""}
    again = sealed.select(crypto.encrypt(F.col("v"), ONE).alias("v"))
    assert again.select(crypto.decrypt(crypto.decrypt(F.col("v"), ONE), ONE).alias("v")).where("v = 'plain'").count() == 1
    fixed = spark.createDataFrame(sealed.collect())
    moved = spark.createDataFrame(maintenance.rekeyed(fixed, ("v",), ONE, TWO).collect(), "v string")
    assert maintenance.assert_encrypted(moved, ("v",), TWO).count() == 4
    assert sorted(r.v or "" for r in moved.select(crypto.decrypt(F.col("v"), TWO).alias("v")).collect()) == sorted(["plain", "", "", "café " * 50])
    half = moved.limit(2).union(fixed.where("v is not null and v <> ''"))  # broken off, then done again
    assert {r.v for r in maintenance.rekeyed(half, ("v",), ONE, TWO).select(crypto.decrypt(F.col("v"), TWO).alias("v")).collect()} <= {"plain", "", None, "café " * 50}
    for bad in (lambda: maintenance.rekeyed(moved, ("v",), ONE, ONE[:-2] + "22").collect(), lambda: maintenance.rekeyed(moved, ("v",), None, ONE).collect()):
        with pytest.raises(Exception, match="another key"):
            bad()
    for bad in (fixed, rows.where("v = 'plain'")):
        with pytest.raises(Exception, match="not encrypted"):
            maintenance.assert_encrypted(bad, ("v",), TWO).collect()
    with pytest.raises(ValueError):
        crypto.encrypt(F.col("v"), b"short")


@pytest.mark.parametrize("fails", [1, 2])
def test_a_failed_rename_loses_nothing(spark, tmp_path, monkeypatch, fails):
    path = str(tmp_path / "t")
    events = trace(spark, [(0, "a", 1), (1, "b", 1)])
    events.write.parquet(path)
    move, calls = files.Files.move, []

    def failing(self, source, target):
        calls.append(source)
        if len(calls) == fails:
            raise OSError("no")
        move(self, source, target)

    monkeypatch.setattr(files.Files, "move", failing)
    with pytest.raises(OSError):
        maintenance.delete_all(spark, path)
    assert spark.read.parquet(path).count() == 2
    monkeypatch.undo()
    maintenance.delete_all(spark, path)
    assert spark.read.schema(events.schema).parquet(path).count() == 0 and not os.path.exists(path + ".old")
    with pytest.raises(OSError):
        files.Files(spark, path).move(path + ".none", path)


def test_a_table_left_aside_is_found_again(spark, tmp_path):
    path = str(tmp_path / "t")
    trace(spark, [(0, "a", 1)]).write.parquet(path + ".old")  # a crash between the two renames
    maintenance.delete_all(spark, path, "another subject")
    assert spark.read.parquet(path).count() == 1
    trace(spark, [(0, "a", 1), (1, "b", 1)]).write.parquet(path + ".old")  # a crash before the last step
    maintenance.delete_all(spark, path, "another subject")
    assert spark.read.parquet(path).count() == 1 and not os.path.exists(path + ".old")


def test_retention_goes_on_after_a_crash(spark, tmp_path):
    path = str(tmp_path / "events")
    tables.write_events(trace(spark, [(0, "a", 1), (24 * 60, "b", 1), (48 * 60, "c", 1)]), path)
    day = (BASE + timedelta(days=1)).date()
    os.rename(f"{path}/event_date={day}", f"{path}/_old-{day}")
    tables.delete_before(spark, path, str(datetime.combine(day, datetime.min.time())))
    assert sorted(r.artifact for r in spark.read.parquet(path).collect()) == ["b", "c"] and not any(n.startswith("_old") for n in os.listdir(path))


def test_masking_can_be_switched_off(spark):
    rows = spark.createDataFrame([("mail a@b.co",)], "t string")
    assert T.redact(rows, "t", Config(mask_pii=False)).first()[:] == ("mail a@b.co", {})
