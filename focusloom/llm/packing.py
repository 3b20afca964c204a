"""Bounded-space packing of documents into sequences of at most 4096 tokens.

Each partition keeps a fixed number of open windows. A document's whole
sequences leave at once; what remains goes to the window where it fits best. If
it fits in none and all are open, the fullest window is emitted, filled up with
the document's head in place of padding. At a partition's end its windows are merged
the same way, and the one that is left (under 4096 tokens, ids included) goes on
to a merge with those of MERGE other partitions. What is left there is cut into
powers of two, which need no padding.

Defined cases: a null or empty text is the end id alone; repeated rows are
packed one by one; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from focusloom.llm.common import bounded_batches, lean_worker, materialize
from focusloom.llm.tokens import encoded_rows, tokenizer_path

SEQUENCE = 4096
OPEN_WINDOWS = 32
#: Leftover windows merged by one task: 4 MB of ids at most.
MERGE = 256

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass
class Piece:
    doc: int | None
    start: int
    total: int
    ids: np.ndarray

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return Piece(self.doc, self.start, self.total, self.ids[:n]), Piece(self.doc, self.start + n, self.total, self.ids[n:])


@dataclass
class Packer:
    """State of one partition."""

    base: int
    windows: int = OPEN_WINDOWS
    size: int = SEQUENCE
    open: list[list] = field(default_factory=list)  # [tokens, pieces]
    rows: list[tuple] = field(default_factory=list)
    made: int = 0

    def emit(self, pieces: list[Piece]) -> None:
        at = 0
        for p in pieces:
            self.rows.append((p.doc, p.start, len(p.ids), zlib.crc32(np.ascontiguousarray(p.ids, np.uint32)), p.total, self.base + self.made, at))
            at += len(p.ids)
        self.made += 1

    def add(self, piece: Piece) -> None:
        while len(piece.ids) >= self.size:
            whole, piece = piece.cut(self.size)
            self.emit([whole])
        while len(piece.ids):
            n = len(piece.ids)
            best = max((w for w in self.open if w[0] + n <= self.size), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.windows:
                best = [0, []]
                self.open.append(best)
            if best is None:
                best = max(self.open, key=lambda w: w[0])
                head, piece = piece.cut(self.size - best[0])
            else:
                head, piece = piece, piece.cut(n)[1]
            best[0] += len(head.ids)
            head.ids = head.ids.copy()  # not a view that keeps a whole batch
            best[1].append(head)
            if best[0] == self.size:
                self.emit(best[1])
                self.open.remove(best)

    def merge(self) -> list[Piece]:
        """Tops up the fuller windows with the emptier ones' pieces; returns those of the one that is left."""
        windows = sorted(self.open, key=lambda w: -w[0])
        self.open = []
        rest: list[Piece] = []
        have = 0
        for p in (p for w in windows for p in w[1]):
            while have + len(p.ids) >= self.size:
                head, p = p.cut(self.size - have)
                self.emit([*rest, head])
                rest, have = [], 0
            if len(p.ids):
                rest.append(p)
                have += len(p.ids)
        return rest

    def close(self, pieces: list[Piece]) -> None:
        """Cuts what is left into powers of two, largest first."""
        left = sum(len(p.ids) for p in pieces)
        while left:
            size = 1 << (left.bit_length() - 1)
            mine, have = [], 0
            while have < size:
                head, tail = pieces[0].cut(min(size - have, len(pieces[0].ids)))
                mine.append(head)
                have += len(head.ids)
                pieces = [tail, *pieces[1:]] if len(tail.ids) else pieces[1:]
            self.emit(mine)
            left -= size


def _frame(rows: list[tuple], ids: list | None = None) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))]
    if ids is None:
        return pa.record_batch(columns, names=names)
    return pa.record_batch([*columns, pa.array(ids, pa.list_(pa.int32()))], names=[*names, "ids"])


def pack(docs: DataFrame, tokenizer: str | None = None, windows: int = OPEN_WINDOWS, size: int = SEQUENCE) -> DataFrame:
    """One row per piece of each document; see the module for how sequences form.

    The texts are read in one narrow pass, without a shuffle; only the leftovers
    (one window for each partition) are dealt out again.
    """
    path = tokenizer or tokenizer_path()

    def first(batches):
        lean_worker(keep_tokens=True)
        partition = TaskContext.get().partitionId()
        packer = Packer(partition << 32, windows, size)
        for batch in batches:
            docs_in = batch.column(0).to_pylist()
            for a, b, ids, offsets in encoded_rows(batch, "text", path):
                for i in range(b - a):
                    mine = ids[offsets[i] : offsets[i + 1]]
                    packer.add(Piece(docs_in[a + i], 0, len(mine), mine))
                if packer.rows:
                    yield _frame(packer.rows, [None] * len(packer.rows))
                    packer.rows = []
        rest = packer.merge()
        if packer.rows:
            yield _frame(packer.rows, [None] * len(packer.rows))
        if rest:
            yield _frame([(p.doc, p.start, len(p.ids), 0, p.total, partition, i) for i, p in enumerate(rest)], [p.ids.view(np.int32) for p in rest])

    def second(batches):
        group, packer = None, None
        for batch in batches:
            doc, start, total, groups = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "start", "doc_tokens", "group"))
            lists = batch.column(batch.schema.get_field_index("ids"))
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint32)
            for i, g in enumerate(groups):
                if g != group:
                    if packer:
                        packer.close(packer.merge())
                        yield _frame(packer.rows)
                    group, packer = g, Packer((1 << 62) + (g << 32), 1, size)
                mine = values[ends[i] : ends[i + 1]].copy()
                packer.open.append([len(mine), [Piece(doc[i], start[i], total[i], mine)]])
        if packer:
            packer.close(packer.merge())
            yield _frame(packer.rows)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = materialize(bounded_batches(source).mapInArrow(first, f"{PIECE}, ids array<int>"), "packed")
    left = made.where("ids is not null").withColumn("group", F.floor(F.col("sequence_id") / MERGE))
    merged = left.repartition("group").sortWithinPartitions("group", "sequence_id", "offset").mapInArrow(second, PIECE)
    return made.where("ids is null").drop("ids").unionByName(merged)
