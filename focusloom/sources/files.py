"""Moving tables so that a failure at any step leaves one whole version in place, or one that the next call finds again."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Files:
    """The file system below a path."""

    def __init__(self, spark: SparkSession, base: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(base).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def move(self, source: str, target: str) -> None:
        """A rename that didn't happen is an error: some file systems raise one, others only answer no."""
        try:
            done = self._fs.rename(self._path(source), self._path(target))
        except Py4JJavaError as e:
            raise OSError(f"{source} couldn't be renamed to {target}") from e
        if not done:
            raise OSError(f"{source} couldn't be renamed to {target}")

    def delete(self, path: str) -> None:
        if not self._fs.delete(self._path(path), True) and self.exists(path):
            raise OSError(f"{path} couldn't be deleted")

    def children(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(path))] if self.exists(path) else []


def recover(files: Files, place: str, aside: str) -> None:
    """After a crash between two renames the old version is aside and nothing in its place; after a later one it is only left over."""
    if files.exists(aside):
        if files.exists(place):
            files.delete(aside)
        else:
            files.move(aside, place)


def swap(files: Files, new: str | None, place: str, aside: str) -> None:
    """Puts new (or nothing) in place of what is there, which is deleted last; if that fails the old version comes back."""
    if files.exists(place):
        files.move(place, aside)
    if new is not None:
        try:
            files.move(new, place)
        except OSError:
            recover(files, place, aside)
            raise
    if files.exists(aside):
        files.delete(aside)


def replace_table(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """Writes rows beside a table and then takes its place in two renames."""
    base = path.rstrip("/")
    files = Files(rows.sparkSession, base)
    new, aside = f"{base}.new-{uuid.uuid4().hex}", f"{base}.old"
    (rows.write.partitionBy(partition) if partition else rows.write).parquet(new)
    swap(files, new, base, aside)
