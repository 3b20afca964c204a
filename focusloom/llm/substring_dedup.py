"""Removal of repeated word windows, with a count-min prefilter.

Pass one hashes every window of WINDOW words of every text. Each task notes, in
DEPTH rows of cells, which cells its windows fall into once and which more
often; the tasks' sketches are merged cell block by cell block. Cells only ever
overestimate a window's count, so a window with one cell that was met once
occurs once. Pass two sends only the others on, each task one row for each
window (its earliest), so a window that all documents share is a row a task and
not a row a document; they travel as compressed columns, a bucket of hashes at a
time, and the earliest start of each is then found bucket by bucket, exactly (96
bits of hashes of whole words). The sketch has a fixed size: on much
larger inputs it lets more single windows through to pass two, and loses none.

Defined cases: a null text has no words; rows with equal doc_id are the same
document: equal starts of theirs aren't earlier than each other, and a window
that is removed at a start is removed there in each of them that has it; a null doc_id comes before all
others; other columns are ignored, also ones named like ours; an empty table
gives an empty one.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from focusloom.llm.common import bounded_batches, gram_hashes, lean_worker, mix, positions_of, split_words, text_chunks, word_hashes

WINDOW = 20
#: The sketch: DEPTH rows of 2**CELLS cells (a bit each once merged: 64 MB in all), in blocks of 2**BLOCK cells.
DEPTH, CELLS, BLOCK = 2, 28, 20
#: Windows held by a task before it notes their cells, and before it sends off what it has.
HELD, SENT = 2_000_000, 800_000
#: Buckets of hashes for each shuffle partition; one is held at a time.
BUCKETS = 8

_NULL_ID = -(1 << 63)


def _windows(batch: pa.RecordBatch, window: int):
    """Of a batch (doc_id, text), chunk by chunk: each window's hash, its row, document id and first word, and a function that gives chosen windows 32 more bits."""
    ids = batch.column(0).fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
    for a, b, data, offsets in text_chunks(batch.column(1)):
        starts, ends, bounds = split_words(data, offsets)
        at, doc = positions_of(bounds, window)
        if len(at):
            more = lambda chosen: (gram_hashes(word_hashes(data, starts, ends, 1), window)[at[chosen]] >> np.uint64(32)).astype(np.uint32).view(np.int32)  # noqa: B023, E731
            yield gram_hashes(word_hashes(data, starts, ends), window)[at], a + doc, ids[a:b][doc], (at - bounds[:-1][doc]).astype(np.int32), more


def _cells(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(hashes + np.uint64(0x632BE59BD9B4E019 * (row + 1) % 2**64)) >> np.uint64(64 - cells)).astype(np.uint32)


def sketch(docs: DataFrame, window: int = WINDOW, depth: int = DEPTH, cells: int = CELLS, block: int = BLOCK) -> np.ndarray:
    """For each row and cell (packed bits): do two or more windows fall into it?"""

    def note(batches):
        lean_worker()
        held: list[np.ndarray] = []
        count = 0

        def flush():
            hashes = np.concatenate(held)
            for row in range(depth):
                mine = np.sort(_cells(hashes, row, cells))
                new = np.concatenate([[True], mine[1:] != mine[:-1]])
                first = np.flatnonzero(new)
                unique = mine[first]
                more = np.diff(np.append(first, len(mine))) > 1
                blocks = unique >> np.uint32(block)
                cuts = np.searchsorted(blocks, np.arange((1 << (cells - block)) + 1))
                keys, blobs = [], []
                pack = zstandard.ZstdCompressor(level=1)
                for k in range(1 << (cells - block)):
                    x, y = cuts[k], cuts[k + 1]
                    if x < y:
                        low = unique[x:y] & np.uint32((1 << block) - 1)
                        gaps = np.diff(low, prepend=np.uint32(0)).astype(np.uint32)
                        wide = np.flatnonzero(gaps >= 255)
                        raw = np.minimum(gaps, 255).astype(np.uint8).tobytes() + gaps[wide].tobytes() + np.packbits(more[x:y]).tobytes()
                        keys.append((row << (cells - block)) + k)
                        blobs.append(np.array([y - x, len(wide)], np.uint32).tobytes() + pack.compress(raw))
                yield pa.record_batch([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=["block", "cells"])

        for batch in batches:
            for hashes, *_ in _windows(batch, window):
                held.append(hashes)
                count += len(hashes)
                if count >= HELD:
                    yield from flush()
                    held, count = [], 0
        if held:
            yield from flush()

    def merge(batches):
        """Over rows sorted by block: one block is held at a time."""
        lean_worker()
        unpack = zstandard.ZstdDecompressor()
        now, once, more = None, np.zeros(1 << block, bool), np.zeros(1 << block, bool)
        done = lambda: pa.record_batch([pa.array([now], pa.int32()), pa.array([np.packbits(more).tobytes()], pa.binary())], names=["block", "cells"])
        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != now:
                    if now is not None:
                        yield done()
                    now = key
                    once.fill(False)
                    more.fill(False)
                n, wide = np.frombuffer(blob[:8], np.uint32).tolist()
                raw = unpack.decompress(blob[8:], max_output_size=n + 4 * wide + n // 8 + 1)
                gaps = np.frombuffer(raw, np.uint8, n).astype(np.uint32)
                gaps[gaps == 255] = np.frombuffer(raw[n : n + 4 * wide], np.uint32)
                at = np.cumsum(gaps)
                again = np.unpackbits(np.frombuffer(raw[n + 4 * wide :], np.uint8), count=n).astype(bool)
                more[at] |= again | once[at]
                once[at] = True
        if now is not None:
            yield done()

    noted = bounded_batches(docs).mapInArrow(note, "block int, cells binary")
    merged = noted.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, cells binary")
    out = np.zeros((depth << (cells - block), (1 << block) // 8), np.uint8)
    for key, blob in merged.toLocalIterator():  # a fixed size, one partition at a time
        out[key] = np.frombuffer(blob, np.uint8)
    return out


def repeated_runs(docs: DataFrame, window: int = WINDOW, depth: int = DEPTH, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """(doc_id, place, sum): runs of window starts whose words also start earlier. A run may come in parts.

    place: start << 32 | length; sum: of the windows' hashes, by which a run is told to be of one row and not of another with its doc_id.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # compressed, as most of it is zeros until it fills
    shared = spark.sparkContext.broadcast(zstandard.ZstdCompressor(level=1).compress(sketch(source, window, depth, cells, block).tobytes()))
    opened: list[np.ndarray] = []

    def estimated(hashes: np.ndarray) -> np.ndarray:
        if not opened:
            opened.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(shared.value), np.uint8).reshape(depth, -1))
        bits, often = opened[0], np.ones(len(hashes), bool)
        for row in range(depth):
            cell = _cells(hashes, row, cells)
            often &= (bits[row][cell >> np.uint32(3)] >> (np.uint8(7) - (cell & np.uint32(7)).astype(np.uint8))) & 1 != 0
        return often

    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64)

    def packed(h, c, d, p, n):
        """Rows (hash, more of it, document, start, length of a run or 0) by bucket of their hash; h is sorted."""
        pack = zstandard.ZstdCompressor(level=1)
        cuts = np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])
        full = np.flatnonzero(np.diff(cuts))
        blobs = []
        for k in full.tolist():
            x, y = cuts[k], cuts[k + 1]
            # byte by byte: the bytes that are alike in all rows of a bucket take no room
            planes = b"".join(col[x:y].view(np.uint8).reshape(y - x, -1).T.tobytes() for col in (h, c, d, p, n))
            blobs.append(int(y - x).to_bytes(4, "little") + pack.compress(planes))
        return pa.record_batch([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "rows"])

    kinds = (np.uint64, np.int32, np.int64, np.int32, np.int32)

    def unpacked(blob: bytes) -> list[np.ndarray]:
        m = int.from_bytes(blob[:4], "little")
        raw, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:]), np.uint8), [], 0
        for kind in kinds:
            wide = np.dtype(kind).itemsize
            out.append(np.ascontiguousarray(raw[at : at + m * wide].reshape(wide, m).T).view(kind).ravel())
            at += m * wide
        return out

    def send(batches):
        lean_worker()
        held: list[tuple] = []
        count = base = 0

        def flush():
            h, c, r, d, p = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((p, d, c, h))
            h, c, r, d, p = h[order], c[order], r[order], d[order], p[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
            head = np.flatnonzero(new)
            mine = np.repeat(head, np.diff(np.append(head, len(h))))
            later = (d != d[mine]) | (p != p[mine])
            yield packed(h[head], c[head], d[head], p[head], np.zeros(len(head), np.int32))
            h, r, d, p = h[later], r[later], d[later], p[later]
            order = np.lexsort((p, r))
            h, r, d, p = h[order], r[order], d[order], p[order]
            if len(d):
                cut = np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] > p[:-1] + 1)])
                first = np.flatnonzero(cut)
                sizes = np.diff(np.append(first, len(d))).astype(np.int32)
                sums = np.add.reduceat(h, first)  # a run goes by the sum of its hashes
                order = np.argsort(sums, kind="stable")
                yield packed(sums[order], np.zeros(len(first), np.int32), d[first][order], p[first][order], sizes[order])

        for batch in batches:
            for h, r, d, p, more in _windows(batch, window):
                keep = np.flatnonzero(estimated(h))
                if len(keep):
                    held.append((h[keep], more(keep), base + r[keep], d[keep], p[keep]))
                    count += len(keep)
                if count >= SENT:
                    yield from flush()
                    held, count = [], 0
            base += batch.num_rows
        if count:
            yield from flush()

    def earliest(batches):
        """Over rows sorted by bucket: passes runs on, drops each window's first start."""
        lean_worker()
        held: list[list[np.ndarray]] = []
        now = None

        def done():
            h, c, d, p, n = (np.concatenate(x) for x in zip(*held))
            run = n > 0
            rest = [(d[run], p[run], n[run], h[run])]
            h, c, d, p = h[~run], c[~run], d[~run], p[~run]
            if len(h):
                order = np.lexsort((p, d, c, h))
                h, c, d, p = h[order], c[order], d[order], p[order]
                head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]))
                mine = np.repeat(head, np.diff(np.append(head, len(h))))
                later = (d != d[mine]) | (p != p[mine])
                rest.append((d[later], p[later], np.ones(int(later.sum()), np.int32), h[later]))
            d, p, n, h = (np.concatenate(x) for x in zip(*rest))
            # 32 bits tell the rows of one document apart
            return pa.record_batch([pa.array(d), pa.array(p.astype(np.int64) << 32 | n), pa.array(h.astype(np.uint32).view(np.int32))], names=["doc_id", "place", "sum"])

        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != now and held:
                    yield done()
                    held = []
                now = bucket
                held.append(unpacked(blob))
        if held:
            yield done()

    sent = bounded_batches(source).mapInArrow(send, "bucket int, rows binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(earliest, "doc_id long, place long, sum int")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, **sizes: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row; kept: the words that stay, joined by one space."""
    runs = repeated_runs(docs, window, **sizes)
    by_doc = runs.groupBy("doc_id").agg(F.collect_list(F.struct("place", "sum")).alias("runs"))
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))

    def remove(batches):
        lean_worker()
        for batch in batches:
            ids, texts, runs_of = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            out = []
            for a, b, data, offsets in text_chunks(texts):
                starts, ends, bounds = split_words(data, offsets)
                gone = np.zeros(len(starts) + 1, np.int64)
                if any(runs_of[a:b]):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(gram_hashes(word_hashes(data, starts, ends), window), dtype=np.uint64)]).view(np.int64)
                for i in range(a, b):
                    first, end = int(bounds[i - a]), int(bounds[i - a + 1])
                    for r in runs_of[i] or ():
                        x = first + (r["place"] >> 32)
                        y = x + (r["place"] & 0xFFFFFFFF)
                        if y + window - 1 <= end and (int(sums[y]) - int(sums[x]) - r["sum"]) % 2**32 == 0:  # else it is of another row with this doc_id
                            gone[x] += 1
                            gone[y + window - 1] -= 1
                stay = np.cumsum(gone)[:-1] <= 0
                raw = data.tobytes()
                for i in range(a, b):
                    x, y = bounds[i - a], bounds[i - a + 1]
                    keep = stay[x:y]
                    words = [raw[s:e] for s, e in zip(starts[x:y][keep].tolist(), ends[x:y][keep].tolist())]
                    out.append((None if ids[i] == _NULL_ID else ids[i], int(y - x), int(y - x - keep.sum()), b" ".join(words).decode("utf-8", "surrogateescape")))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return bounded_batches(source).join(by_doc.hint("merge"), "doc_id", "left").select("doc_id", "text", "runs").mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")
