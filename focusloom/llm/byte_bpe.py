"""Byte-level BPE encoding and decoding as tree reductions over pieces of text.

A text's tokens are a monoid: two neighbouring spans, encoded apart, join by
encoding anew a window around their border. Texts are halved until they are LEAF
code points or fewer, leaves are encoded by the tiktoken library, and neighbours
are joined up the tree. Texts over SPAN code points are dealt to tasks span by
span, and their spans are joined FAN at a time by shuffles of spans alone. What
lies outside a window is proved to stay:

* A white-space sign after any other sign always begins a match of the splitting
  pattern: no match holds the two, and matches look ahead but not back. Windows
  reach from the last such cut of the left span to the first of the right one.
* Where the cuts are far apart (long runs without white space), the window lies
  within one match. A sequence of tokens is the encoding of its bytes if and only
  if each two neighbours are the encoding of theirs: the first merge over a border
  would also happen with the two neighbours alone. So the window takes more tokens
  on a side until its outer token and the next one outside stand side by side.

Decoding maps ids to bytes; spans of ids are decoded apart and their bytes
concatenated up the same tree.

Defined cases: null texts are empty and have no ids; null ids decode to null, ids
outside the vocabulary end the job; rows that share a key stay apart; other
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import functools
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from focusloom.llm.common import bounded_batches, lean_worker

#: Code points (of a match: bytes) that are encoded in one go.
LEAF = 4096
#: Code points that are dealt to tasks at once; ids that are decoded at once.
SPAN = 1 << 16
#: Neighbours joined by one shuffle. FAN ** LEVELS spans are more than a string can hold (2 GB).
FAN, LEVELS = 16, 4
#: Tokens on each side of a border that are encoded anew at first, within a match.
WINDOW = 4
DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
_CUT = re.compile(r"(?<=\S)[ \n]")
_coders: dict[str, "Coder"] = {}


class Span(NamedTuple):
    """The ids of a span of text; first and last: ids before its first and its last cut, -1 if it has none."""

    ids: np.ndarray
    first: int
    last: int


EMPTY = Span(np.zeros(0, np.int32), -1, -1)


class Coder:
    """The tiktoken library over one file of ranks, and the joining of neighbouring spans."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in open(path, "rb") if line.strip())}
        self.library = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.matches = regex.compile(public_tokenizers.PATTERN)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.stands = functools.lru_cache(1 << 16)(lambda a, b: self.match(self.bytes_of[a] + self.bytes_of[b]) == [a, b])

    def text(self, text: str) -> np.ndarray:
        return self.library.encode_to_numpy(text).astype(np.int32)

    def match(self, data: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        return self.library._encode_single_piece(data)

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def span(self, text: str) -> Span:
        """The tree over one span: halves, down to leaves."""
        if len(text) > LEAF:
            middle = len(text) // 2
            return self.join(self.span(text[:middle]), self.span(text[middle:]))
        first = _CUT.search(text)
        if not first:
            return Span(self.text(text), -1, -1)
        a = b = first.start()
        for m in _CUT.finditer(text, max(b, len(text) - 64)):
            b = m.start()
        head, body, tail = self.text(text[:a]), self.text(text[a:b]), self.text(text[b:])
        return Span(np.concatenate([head, body, tail]), len(head), len(head) + len(body))

    def join(self, a: Span, b: Span) -> Span:
        left, right = max(a.last, 0), len(b.ids) if b.first < 0 else b.first
        window = self.window(a.ids[left:].tolist(), b.ids[:right].tolist())
        ids = np.concatenate([a.ids[:left], np.array(window, np.int32), b.ids[right:]])
        moved = left + len(window) - right  # by how many ids what follows the window moves
        first = a.first if a.first >= 0 else b.first + moved if b.first >= 0 else -1
        return Span(ids, first, b.last + moved if b.last >= 0 else a.last)

    def window(self, a: list[int], b: list[int]) -> list[int]:
        """The ids of the text between two cuts, from the ids of its two parts."""
        if not a or not b:
            return a or b
        left, right = self.decode(a), self.decode(b)
        text = (left + right).decode()
        if len(text) <= LEAF:
            return self.text(text).tolist()
        begin = len(left) - len(self.matches.findall(left.decode())[-1].encode())
        end = len(left) + len(self.matches.match(right.decode()).group().encode())
        out, at = [], 0
        for m in self.matches.finditer(text):
            data = m.group().encode()
            if len(data) > LEAF and at == begin and at + len(data) == end:  # the last match of one part and the first of the other are one
                out += self.grow(self._after(a, begin), self._before(b, end - len(left)))
            else:
                out += self.long_match(data)
            at += len(data)
        return out

    def _before(self, ids: list[int], size: int) -> list[int]:
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids])
        return ids[: int(np.searchsorted(ends, size)) + 1]

    def _after(self, ids: list[int], size: int) -> list[int]:
        starts = np.cumsum([0] + [len(self.bytes_of[i]) for i in ids])
        return ids[int(np.searchsorted(starts, size)) :]

    def long_match(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.match(data)
        middle = len(data) // 2
        return self.grow(self.long_match(data[:middle]), self.long_match(data[middle:]))

    def grow(self, a: list[int], b: list[int]) -> list[int]:
        """The ids of one match from those of its two parts, by a window that grows until what is outside stands."""
        i = j = WINDOW
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            new = self.match(self.decode(a[len(a) - i :]) + self.decode(b[:j]))
            left = i == len(a) or self.stands(a[-i - 1], new[0])
            right = j == len(b) or self.stands(new[-1], b[j])
            if left and right:
                return a[: len(a) - i] + new + b[j:]
            i, j = i if left else 2 * i, j if right else 2 * j


def reduced(parts: list, join, empty):
    """Joins neighbours, and the results' neighbours, until one is left."""
    while len(parts) > 1:
        parts = [join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else empty


def ranks_path(name: str = DEFAULT_RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0] + [len(a) for a in arrays], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32), pa.int32()))


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", size: int = SPAN) -> DataFrame:
    """(key, ids array<int>): the ids of each row's whole text, without special tokens; spans of size code points are one task's work."""
    path = path or ranks_path()
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def whole(batches):
        lean_worker()
        for batch in batches:
            ids = _lists([coder(path).span(t).ids for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["key", "ids"])

    def sliced(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                for k, at in enumerate(range(0, len(text), size)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([k], pa.int32()), pa.array([text[at : at + size]])], ["row", "k", "span"])

    def spans_batch(row, k, spans):
        ends = [pa.array([s[c] for s in spans], pa.int32()) for c in (1, 2)]
        return pa.RecordBatch.from_arrays([row, k, _lists([s.ids for s in spans]), *ends], ["row", "k", "ids", "first", "last"])

    def leaves(batches):
        lean_worker()
        for batch in batches:
            yield spans_batch(batch.column(0), batch.column(1), [coder(path).span(t) for t in batch.column(2).to_pylist()])

    def joined(batches):
        for batch in batches:
            outs = []
            for i in range(batch.num_rows):
                ids, first, last = (batch.column(2)[i].values.field(c) for c in ("ids", "first", "last"))
                spans = [Span(ids[k].values.to_numpy(), first[k].as_py(), last[k].as_py()) for k in range(len(ids))]
                outs.append(reduced(spans, coder(path).join, EMPTY))
            yield spans_batch(batch.column(0), batch.column(1), outs)

    short = bounded_batches(rows.where(F.length("text") <= size)).mapInArrow(whole, f"key {kind}, ids array<int>")
    long = rows.where(F.length("text") > size).select(F.struct(F.monotonically_increasing_id().alias("row"), "key").alias("row"), "text")
    place = f"row struct<row: bigint, key: {kind}>, k int"
    spans = bounded_batches(long).mapInArrow(sliced, f"{place}, span string").repartition("row", "k")
    spans = bounded_batches(spans).mapInArrow(leaves, f"{place}, ids array<int>, first int, last int")
    for _ in range(LEVELS):
        near = spans.select("row", F.expr(f"k div {FAN}").cast("int").alias("up"), F.struct("k", "ids", "first", "last").alias("part"))
        runs = near.groupBy("row", "up").agg(F.array_sort(F.collect_list("part")).alias("parts"))
        spans = bounded_batches(runs).mapInArrow(joined, f"{place}, ids array<int>, first int, last int")
    return short.union(spans.select("row.key", "ids")).toDF(key, "ids")


def decode(encoded: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, bytes, *keep): the bytes of each row's ids, decoded SPAN ids at a time and concatenated up the tree."""
    path = path or ranks_path()
    rows = encoded.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").cast("array<int>").alias("ids"), *(F.col(f"`{c}`").alias(f"keep{k}") for k, c in enumerate(keep)))
    others = rows.columns[2:]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select("key", *others).schema)

    def back(ids):
        return None if ids is None else reduced([coder(path).decode(ids[at : at + SPAN]) for at in range(0, len(ids), SPAN)], bytes.__add__, b"")

    def decoded(batches):
        lean_worker()
        for batch in batches:
            data = pa.array([back(i) for i in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], data], ["key", *others, "bytes"])

    out = bounded_batches(rows).mapInArrow(decoded, f"{schema}, bytes binary")
    return out.select(F.col("key").alias(key), "bytes", *(F.col(o).alias(c) for o, c in zip(others, keep)))


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: of each whole text's ids and of the bytes that they decode to."""
    back = decode(encode(docs, path), path, keep=("ids",))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
