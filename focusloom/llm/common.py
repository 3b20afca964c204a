"""Helpers shared by the training-data operators.

``shared_dir``/``materialize`` cut lineage with a table written below
``spark.checkpoint.dir``, so that a lost executor costs a re-read and not a
recomputation. The rest are vectorised (numpy) word splitting and hashing of
whole Arrow batches.
"""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at once by the numpy code; longer documents are one chunk each, and are hashed piece by piece.
CHUNK_BYTES = 256 << 10
#: Bytes of a batch that goes to a Python worker, where the session names no bound of its own.
BATCH_BYTES = 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_PRIME = 0x9E3779B97F4A7C13  # odd, 3 modulo 8
_WORD_PRIME = 0xD6E8FEB86659FD93
#: Two tables: the hashes made with them are independent, and together name a word by 128 bits.
_BYTES = [np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (20240131, 20240607)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a local one only for a local master that names none (tests)."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/focusloom-shared"
    return base.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns what is read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded in bytes: 10,000 long texts at once would fill a worker."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def lean_worker(keep_tokens: bool = False) -> None:
    """Gives back the memory that earlier tasks left in this Python worker, which Spark uses again and again; known words' tokens too, unless they are kept."""
    tokens = sys.modules.get("focusloom.llm.tokens")
    if tokens and not keep_tokens:
        tokens._encoders.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed memory otherwise
    if trim:
        trim(0)


def discard(df: DataFrame) -> None:
    """Deletes a table written by :func:`materialize` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _power_tables(prime: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = _powers.get(prime)
    if got is None or len(got[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        make = lambda p: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, p, np.uint64))])
        got = (make(prime), make(pow(prime, -1, 1 << 64)))
        if size <= CHUNK_BYTES + 1:  # a longer one is for a single huge word
            _powers[prime] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about CHUNK_BYTES; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(off, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def split_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each document's first word index (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    sep = separators[data]
    word = ~sep
    start, end = word.copy(), word.copy()
    start[1:] &= sep[:-1]
    end[:-1] &= sep[1:]
    first = offsets[:-1][offsets[:-1] < len(data)]
    start[first] = word[first]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = word[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, by one of two tables; works through CHUNK_BYTES at once (a longer word is one piece)."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        end = max(at + 1, int(np.searchsorted(ends, low + CHUNK_BYTES, "right")))
        part = data[low : int(ends[end - 1])]
        n = len(part)
        power, inverse = _power_tables(_PRIME, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[table][part] * power[:n], out=total[1:])
        x, y = starts[at:end] - low, ends[at:end] - low
        out[at:end] = mix((total[y] - total[x]) * inverse[x] + (y - x).astype(np.uint64))
        at = end
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each position on (those that run over the end are left out), piece by overlapping piece."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    out = np.empty(n - k + 1, np.uint64)
    step = max(CHUNK_BYTES - k, k)
    for at in range(0, len(out), step):
        part = words[at : at + step + k - 1]
        m = len(part)
        power, inverse = _power_tables(_WORD_PRIME, m + 1)
        total = np.zeros(m + 1, np.uint64)
        np.cumsum(part * power[:m], out=total[1:])
        out[at : at + step] = mix((total[k:] - total[:-k]) * inverse[: m - k + 1])
    return out


def positions_of(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For documents with the word bounds given: the word positions at which k words of one document begin, and their document."""
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return bounds[:-1][doc] + inner, doc
