"""Token-id tables: Parquet list columns with delta or dictionary encoding.

``write_token_table`` writes one row per document (id, ids as ``array<int>``)
in ascending id order, with row groups and pages of the given sizes; Parquet's
page indexes let a reader skip to some documents, and the metadata columns can
be read without the ids. ``read_digests`` reads the files back and derives
per-document figures from the stored ids.

Defined cases: a null or empty text stores only the end id; a null doc_id sorts
first; rows with equal doc_id are stored one after the other (by a hash of their
text, then in text order), and their starts follow that order; other columns, also ones named like
ours, are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from focusloom.llm.common import bounded_batches, lean_worker, shared_dir
from focusloom.llm.tokens import encoded_rows, tokenizer_path

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row, in the rows' order; one narrow pass."""

    def run(batches):
        lean_worker(keep_tokens=True)
        for batch in batches:
            ids_col = batch.column(0)
            for a, b, ids, offsets in encoded_rows(batch, "text", path):
                tokens = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.record_batch([ids_col.slice(a, b - a), tokens], names=["doc_id", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bounded_batches(source).mapInArrow(run, "doc_id long, ids array<int>")


def write_token_table(docs: DataFrame, target: str, path: str, encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Writes (part, row, doc_id, n_tokens, ids); part numbers the files in ascending order of doc_id, row the rows in each.

    Texts, not ids, are dealt out by range: they are the smaller of the two.
    encoding: "dictionary" or "delta" (DELTA_BINARY_PACKED pages).
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"no such encoding: {encoding}")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = source.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = tokenize(ordered, path).select(F.spark_partition_id().alias("part"), row.alias("row"), "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
    (
        rows.write.option("compression", "zstd")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.writer.version", "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", 1000)
        .parquet(target)
    )


def read_metadata(spark: SparkSession, source: str) -> DataFrame:
    """(part, row, doc_id, n_tokens, start) without reading any ids; start counts the ids of all documents before.

    Sums within parts and over parts, so no task gets more than a part's rows or one row for each part.
    """
    meta = spark.read.parquet(source).select("part", "row", "doc_id", "n_tokens")
    return with_starts(meta, meta)


def with_starts(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Adds start to rows(part, row, n_tokens, ...); the parts' sums come from meta(part, n_tokens), where that is cheaper to read."""
    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    parts = meta.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = parts.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    counted = rows.withColumn("_within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return counted.join(before, "part").withColumn("start", F.col("_before") + F.col("_within")).drop("_before", "_within")


def read_tokens(spark: SparkSession, source: str, first: int, last: int) -> DataFrame:
    """(doc_id, n_tokens, ids) of the documents from first to last.

    The filter on doc_id goes to the scan: row groups, and by the page indexes
    pages, of other documents aren't read, since rows are stored by doc_id.
    """
    return spark.read.parquet(source).where(F.col("doc_id").between(first, last)).select("doc_id", "n_tokens", "ids")


def read_digests(spark: SparkSession, source: str) -> DataFrame:
    """Per document, from the files' ids: part, row, doc_id, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            part, row, doc, lists = batch.columns
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False)
            raw = memoryview(np.ascontiguousarray(values, np.int32)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.record_batch([part, row, doc, pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], names=["part", "row", "doc_id", "n_tokens", "ids_crc32"])

    stored = spark.read.parquet(source).select("part", "row", "doc_id", "ids")
    return bounded_batches(stored).mapInArrow(run, "part int, row long, doc_id long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer: str | None = None, encoding: str = "dictionary") -> DataFrame:
    """Writes the token table of ``docs`` to the shared folder and returns what its files hold."""
    spark = docs.sparkSession
    target = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_table(docs, target, tokenizer or tokenizer_path(), encoding)
    return with_starts(read_digests(spark, target), spark.read.parquet(target)).select("doc_id", "start", "n_tokens", "ids_crc32")
