"""A streaming source over logs that grow, and the collector that makes events of them.

Devices append lines of JSON to files below one folder; Spark's own file source
reads a file once and misses what is added. This one keeps, as the stream's
offset, how many bytes of each log were read, always up to a line's end. A
micro-batch reads the bytes between two offsets in parallel, in pieces of
``piece_bytes``, and the same bytes again when it is repeated.

The settings file is read anew for each micro-batch. While it says
``collection_paused`` the stream stands where it stood at the first micro-batch
that saw so; that place is kept in ``state``, so that a restart in between
neither loses nor repeats a line. What arrives meanwhile is read after the pause.

Defined cases: no folder or no logs gives nothing; lines that aren't JSON are
put aside with their place; a last line without an end waits for it; a log that
shrank or was taken away isn't read again. The offset has one entry a log, so a log should be a device's
or a day's, not an event's.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from focusloom import config as C
from focusloom.operators import assembly

LINES = "log string, position bigint, line string"
_STEP = 1 << 16


def _open(uri: str):
    """The file system of a path (local, HDFS or an object store) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def settings(uri: str) -> C.Config:
    """The settings as they are now; the defaults where there is no file."""
    system, path = _open(uri)
    try:
        with system.open_input_file(path) as f:
            return C.load(f.read().decode("utf-8"))
    except FileNotFoundError:
        return C.Config()


def _last_end(f, size: int, least: int = 0) -> int:
    """The place after the last line's end below size; least if there is none after it."""
    while size > least:
        begin = max(least, size - _STEP)
        at = f.read_at(size - begin, begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        size = begin
    return least


class Piece(InputPartition):
    def __init__(self, log: str, begin: int, end: int, first: int, last: int):
        self.log, self.begin, self.end, self.first, self.last = log, begin, end, first, last


class GrowingLogs(DataSource):
    """Format ``growing_logs``; options path, state, settings, suffix (.jsonl) and piece_bytes (32 MB)."""

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.state, self.settings = options["path"], options["state"].rstrip("/"), options["settings"]
        self.suffix, self.piece = options.get("suffix", ".jsonl"), int(options.get("piece_bytes", 32 << 20))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        now = self._ends()  # before the settings, so that no pause is older than what it holds back
        system, hold = _open(f"{self.state}/held.json")
        held = system.get_file_info(hold).is_file
        if not settings(self.settings).collection_paused:
            if held:
                system.delete_file(hold)
            return now
        if held:
            with system.open_input_file(hold) as f:
                return json.loads(f.read())
        system.create_dir(hold.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(f"{hold}.new") as f:
            f.write(json.dumps(now).encode())
        system.move(f"{hold}.new", hold)
        return now

    def _ends(self) -> dict:
        """Of each log the bytes of its whole lines. Only what was added since the last look is read."""
        from pyarrow import fs

        system, path = _open(self.folder)
        for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True)):
            if not info.is_file or not info.path.endswith(self.suffix):
                continue
            log, before = info.path[len(path.rstrip("/")) + 1 :], self.known.get(info.path, 0)
            if info.size > before:
                with system.open_input_file(info.path) as f:
                    self.known[info.path] = _last_end(f, info.size, before)
        cut = len(path.rstrip("/")) + 1
        return {log[cut:]: end for log, end in sorted(self.known.items()) if end}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for log, last in sorted(end.items()):
            first = start.get(log, 0)
            out += [Piece(log, b, min(b + self.piece, last), first, last) for b in range(first, last, self.piece)]
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        """The lines that begin in a piece; the last of them may end beyond it."""
        system, path = _open(self.folder)
        with system.open_input_file(f"{path.rstrip('/')}/{partition.log}") as f:
            at = partition.begin
            if at > partition.first:  # a line belongs to the piece where it begins
                at = _next_end(f, at - 1, partition.last)
            f.seek(at)
            rest = b""
            while at < partition.end:
                chunk = f.read(min(_STEP * 16, partition.last - at - len(rest)))
                lines = (rest + chunk).split(b"\n")
                rest = lines.pop()
                for line in lines:
                    if at >= partition.end:
                        return
                    if line.strip():
                        yield partition.log, at, line.decode("utf-8", "replace")
                    at += len(line) + 1
                if not chunk:
                    return


def _next_end(f, at: int, last: int) -> int:
    """The place after the first line's end from ``at`` on."""
    while at < last:
        part = f.read_at(min(_STEP, last - at), at)
        k = part.find(b"\n")
        if k >= 0:
            return at + k + 1
        at += len(part)
    return last


def lines(spark: SparkSession, logs: str, state: str, config: str, piece_bytes: int = 32 << 20) -> DataFrame:
    """The stream of (log, position, line)."""
    spark.dataSource.register(GrowingLogs)
    return spark.readStream.format("growing_logs").option("state", state).option("settings", config).option("piece_bytes", piece_bytes).load(logs)


def parsed(rows: DataFrame) -> DataFrame:
    """Samples from lines, beside log, position and ``broken``: the line itself where it is no JSON of a sample."""
    got = F.from_json("line", f"{assembly.SAMPLE}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    df = rows.select("log", "position", "line", got.alias("s")).select("log", "position", "line", "s.*")
    return df.withColumn("broken", F.when(F.col("_corrupt").isNotNull() | F.col("ts_end").isNull(), F.col("line"))).drop("line", "_corrupt")


def collect(spark: SparkSession, logs: str, config: str, table: str, checkpoint: str, once: bool = False, every: str = "15 seconds", manifests: list | None = None, piece_bytes: int = 32 << 20):
    """Starts the collector: lines of the logs become rows of ``table``, by the settings of the moment.

    Each micro-batch has a folder of its own, which a repeated one overwrites, so
    every line counts once. Broken lines go to ``table``_rejected.
    """

    def write(batch: DataFrame, number: int) -> None:
        cfg = settings(config)
        if cfg.collection_paused:  # what was read before the pause is still to be written
            cfg = C.replace(cfg, collection_paused=False)
        rows = parsed(batch).persist()
        try:
            bad = rows.where("broken is not null").select("log", "position", "broken")
            good = assembly.assemble(rows.where("broken is null").drop("broken"), cfg, manifests)
            good.write.mode("overwrite").parquet(f"{table}/batch={number}")
            bad.write.mode("overwrite").parquet(f"{table}_rejected/batch={number}")
        finally:
            rows.unpersist()

    writer = lines(spark, logs, f"{checkpoint}/hold", config, piece_bytes).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
