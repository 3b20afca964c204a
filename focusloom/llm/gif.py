"""GIF media columns: a codec with vectorised LZW decoding, and operators over it.

``decode`` takes any GIF: it reads global and local palettes, code streams with
changing code widths, interlacing, transparency and disposal, and gives the
timed frames as they show. ``encode_bytes`` stores bytes losslessly as 8-bit
samples of frames under a grey palette.

LZW decoding without a loop over codes: between clear codes the width of the
n-th code depends on n alone, so all codes of a segment are cut out at once. The
string of a table entry is a copy of earlier output, so output positions are
resolved to literals by repeated pointer jumps.

Defined cases: null bytes give no frames and null media; broken streams raise
``GifError`` in ``decode`` and give an error text in ``decode_media``; empty
payloads are padded as others; repeated rows give repeated results; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from focusloom.llm.common import bounded_batches, lean_worker

#: Payloads are padded with 255 to a positive multiple of this (one row of samples).
UNIT = 576
#: Rows of samples in a frame at most.
ROWS = 64
#: A frame's time in hundredths of a second.
DELAY = 10
#: Bins of the colour histogram, for each of red, green and blue.
BINS = 4
#: Samples at a segment's start that the encoder writes one by one.
LEAD = 256

_WIDTHS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class GifError(ValueError):
    pass


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    transparent: int | None
    samples: np.ndarray  # palette indices, height x width
    palette: np.ndarray  # 256 x 3
    shown: np.ndarray  # the canvas while it shows, height x width x 4


def _widths(start: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the first n codes after a clear code, for literals of start bits: widths and bit offsets (one more)."""
    got = _WIDTHS.get(start)
    if got is None or len(got[0]) < n:
        following = (1 << start) + 2 + np.maximum(np.arange(max(n, 8192)) - 1, 0)
        width = np.minimum(12, np.floor(np.log2(following)).astype(np.int64) + 1)
        got = _WIDTHS[start] = (width, np.concatenate([[0], np.cumsum(width)]))
    return got[0][:n], got[1][: n + 1]


def lzw_decode(stream: bytes, start: int) -> np.ndarray:
    """The samples of a code stream whose literals have ``start`` bits."""
    clear, end = 1 << start, (1 << start) + 1
    data = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    total, bit, out = 8 * len(stream), 0, []
    while True:
        n = 4096
        while True:  # up to the next clear or end code
            width, offset = _widths(start, n)
            n_in = int(np.searchsorted(offset, total - bit, "right")) - 1
            n_in = min(n_in, n)
            at = bit + offset[:n_in]
            byte = at >> 3
            codes = ((data[byte] | data[byte + 1] << np.uint32(8) | data[byte + 2] << np.uint32(16)) >> (at & 7).astype(np.uint32)) & ((1 << width[:n_in]) - 1).astype(np.uint32)
            stops = np.flatnonzero((codes == clear) | (codes == end))
            if len(stops) or n_in < n:
                break
            n *= 2
        stop = int(stops[0]) if len(stops) else n_in
        if stop:
            out.append(_expand(codes[:stop].astype(np.int64), clear))
        if not len(stops) or codes[stop] == end:
            break
        bit += int(offset[stop + 1])
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """Samples of the codes between two clear codes."""
    n, low = len(codes), clear + 2
    entry = codes - low  # the code whose string, with one sample more, is the entry
    literal = codes < clear
    if not literal[0] or (entry >= np.minimum(np.arange(n), 4096 - low)).any() or ((codes >= clear) & (codes < low)).any():
        raise GifError("a code that the table doesn't have")
    if literal.all():
        return codes.astype(np.uint8)
    jump = np.where(literal, np.arange(n), entry)
    size = (~literal).astype(np.int64)
    while True:
        more = size[jump]
        if not more.any():
            break
        size = size + more
        jump = jump[jump]
    size += 1
    first = np.cumsum(size) - size
    total = int(first[-1] + size[-1])
    source = np.arange(total, dtype=np.int32)
    copied = np.flatnonzero(~literal)
    spans = size[copied]
    ends = np.cumsum(spans)
    if len(copied):
        inner = np.arange(ends[-1]) - np.repeat(ends - spans, spans)
        source[np.repeat(first[copied], spans) + inner] = np.repeat(first[entry[copied]], spans) + inner
    values = np.zeros(total, np.uint8)
    values[first[literal]] = codes[literal]
    while True:
        further = source[source]
        if (further == source).all():
            return values[source]
        source = further


def lzw_encode(samples: bytes, lead: int = LEAD) -> bytes:
    """A code stream for 8-bit samples, made without a loop over samples.

    Each segment first writes ``lead`` samples as they are, by which the table
    gets their pairs; the samples after them go out in pairs where the table has
    them. The table is cleared when it is full. That stores text in some nine
    tenths of its size, in a small part of the time of a longest-match search.
    """
    x = np.frombuffer(samples, np.uint8).astype(np.int32)
    pairs = np.empty(1 << 16, np.int32)
    parts, widths, at = [], [], 0
    while True:
        head = x[at : at + lead]
        at += len(head)
        if len(head) > 1:
            pairs.fill(-1)
            pairs[(head[:-1] << 8 | head[1:])[::-1]] = 258 + np.arange(len(head) - 1)[::-1]
        rest = x[at : at + 2 * (3838 - len(head))]
        a, b = rest[: len(rest) // 2 * 2 : 2], rest[1::2]
        both = pairs[a << 8 | b] if len(a) else a
        known = both >= 0
        ends = np.cumsum(2 - known)
        m = int(np.searchsorted(ends, 3838 - len(head), "right"))
        codes = np.empty(int(ends[m - 1]) if m else 0, np.int32)
        known, ends = known[:m], ends[:m]
        codes[ends - 1] = np.where(known, both[:m], b[:m])
        codes[ends[~known] - 2] = a[:m][~known]
        at += 2 * m
        odd = x[at:] if len(x) - at == 1 and len(head) + len(codes) < 3838 else x[:0]
        at += len(odd)
        last = at >= len(x)
        codes = np.concatenate([head, codes, odd, [257 if last else 256]])
        parts.append(codes)
        widths.append(_widths(8, len(codes))[0])
        if last:
            break
    values = np.concatenate([[256], *parts]).astype("<u2")
    width = np.concatenate([[9], *widths])
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")[:, :12]
    return np.packbits(bits[np.arange(12) < width[:, None]], bitorder="little").tobytes()


def _blocks(stream: bytes) -> bytes:
    return b"".join(bytes([len(stream[i : i + 255])]) + stream[i : i + 255] for i in range(0, len(stream), 255)) + b"\0"


def encode_bytes(payload: bytes, width: int = UNIT, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF whose frames' samples are the payload (a multiple of width)."""
    if not payload or len(payload) % width:
        raise GifError(f"the payload must be a positive multiple of {width} bytes")
    height = min(rows, len(payload) // width)
    grey = bytes(v for i in range(256) for v in (i, i, i))
    out = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), bytes([0xF7, 0, 0]), grey]
    for at in range(0, len(payload), width * height):
        part = payload[at : at + width * height]
        out.append(b"\x21\xf9\x04\x04" + delay.to_bytes(2, "little") + b"\0\0")
        out.append(b"\x2c\0\0\0\0" + width.to_bytes(2, "little") + (len(part) // width).to_bytes(2, "little") + b"\0\x08")
        out.append(_blocks(lzw_encode(part)))
    out.append(b"\x3b")
    return b"".join(out)


def decode(data: bytes) -> list[Frame]:
    """All frames of a GIF, composed."""
    return list(frames_of(data))


def frames_of(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF one by one, so that only the canvases of the one that shows are held."""
    try:
        yield from _decode(data)
    except (IndexError, KeyError) as e:
        raise GifError(f"the file ends early: {e}") from None


def _decode(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise GifError("not a GIF")
    width, height = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    at = 13

    def palette(flags: int, at: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        colours = np.zeros((256, 3), np.uint8)
        colours[:n] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        return colours, at + 3 * n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    shared = None
    if data[10] & 0x80:
        shared, at = palette(data[10], at)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, transparent = 0, 0, None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            body, at = blocks(at + 2)
            if kind == 0xF9:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little")
                transparent = body[3] if body[0] & 1 else None
            continue
        if data[at] != 0x2C:
            raise GifError(f"unknown block {data[at]:#x}")
        left, top, w, h = (int.from_bytes(data[at + i : at + i + 2], "little") for i in (1, 3, 5, 7))
        flags = data[at + 9]
        at += 10
        colours = shared
        if flags & 0x80:
            colours, at = palette(flags, at)
        if colours is None:
            raise GifError("a frame has no palette")
        start = data[at]
        stream, at = blocks(at + 1)
        samples = lzw_decode(stream, start)
        if len(samples) < w * h:
            raise GifError(f"{len(samples)} samples for a frame of {w} x {h}")
        samples = samples[: w * h].reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(first, h, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(samples)
            straight[order] = samples
            samples = straight
        before = canvas
        canvas = canvas.copy()
        y, x = min(h, max(0, height - top)), min(w, max(0, width - left))
        part = samples[:y, :x]
        target = canvas[top : top + y, left : left + x]
        opaque = np.concatenate([colours, np.full((256, 1), 255, np.uint8)], axis=1).view(np.uint32).ravel()
        pixels = opaque[part].view(np.uint8).reshape(*part.shape, 4)
        if transparent is None:
            target[:] = pixels
        else:
            visible = part != transparent
            target[visible] = pixels[visible]
        yield Frame(left, top, w, h, delay, disposal, transparent, samples, colours, canvas)
        if disposal == 2:
            canvas = canvas.copy()
            canvas[top : top + y, left : left + x] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, None


def histogram(frame: Frame) -> list[int]:
    """Counts of the frame's visible colours: BINS bins each of red, green and blue in a row."""
    seen = frame.shown[: frame.top + frame.height][frame.top :, frame.left : frame.left + frame.width]
    if frame.transparent is None:  # then all show, and counting samples is enough
        counts = np.bincount(frame.samples[: seen.shape[0], : seen.shape[1]].ravel(), minlength=256)
        return [int(c) for k in range(3) for c in np.bincount(frame.palette[:, k] // (256 // BINS), counts, BINS)]
    seen = seen[seen[..., 3] > 0]
    return [int(c) for k in range(3) for c in np.bincount(seen[:, k] // (256 // BINS), minlength=BINS)]


FRAMES = "array<struct<frame:int, start_cs:int, delay_cs:int, width:int, height:int, histogram:array<long>>>"


def encode_media(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, n_bytes, media): binary or text payloads, padded to UNIT and stored as GIFs."""

    def run(batches):
        lean_worker()
        for batch in batches:
            sizes, media = [], []
            for b in batch.column(1).to_pylist():
                sizes.append(None if b is None else len(b))
                media.append(None if b is None else encode_bytes(b + b"\xff" * (-len(b) % UNIT if b else UNIT)))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    return bounded_batches(df).select(F.col(key).cast("long").alias(key), F.col(payload).cast("binary").alias("payload")).mapInArrow(run, f"{key} long, n_bytes long, media binary")


def decode_media(df: DataFrame, key: str, media: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep..., media_bytes, media_sha256, payload_bytes, payload_sha256, tail_crc32, frames, error).

    The payload is what the frames show, read back from the stored bytes: the
    red samples of each frame's place on the canvas.
    """
    schema = df.select(F.col(key).cast("long").alias(key), *keep).schema.simpleString()[7:-1].replace(":", " ", 1 + len(keep))
    schema += f", media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, frames {FRAMES}, error string"

    def one(b: bytes | None) -> dict:
        row = dict.fromkeys(("media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "frames", "error"))
        if b is None:
            return row
        row |= {"media_bytes": len(b), "media_sha256": hashlib.sha256(b).hexdigest()}
        digest, tail, size, clock, out = hashlib.sha256(), b"", 0, 0, []
        try:
            for i, f in enumerate(frames_of(b)):
                part = f.shown[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes()
                digest.update(part)
                tail, size = (tail + part[-32:])[-32:], size + len(part)
                out.append({"frame": i, "start_cs": clock, "delay_cs": f.delay, "width": f.width, "height": f.height, "histogram": histogram(f)})
                clock += f.delay
        except GifError as e:
            return row | {"error": str(e)}
        return row | {"payload_bytes": size, "payload_sha256": digest.hexdigest(), "tail_crc32": zlib.crc32(tail), "frames": out}

    def run(batches):
        lean_worker()
        names = None
        for batch in batches:
            n = batch.num_columns - 1
            rows = [one(b) for b in batch.column(n).to_pylist()]
            if not rows:
                continue
            names = list(rows[0])
            kinds = {"media_sha256": pa.string(), "payload_sha256": pa.string(), "error": pa.string(), "frames": pa.list_(pa.struct([("frame", pa.int32()), ("start_cs", pa.int32()), ("delay_cs", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64()))]))}
            yield pa.record_batch([*batch.columns[:n], *(pa.array([r[k] for r in rows], kinds.get(k, pa.int64())) for k in names)], names=[*batch.schema.names[:n], *names])

    return bounded_batches(df).select(F.col(key).cast("long").alias(key), *keep, F.col(media).alias("media")).mapInArrow(run, schema)


def feature_text(frames: str = "frames"):
    """A Column: number of frames, duration and the summed colour histogram."""
    grey = [F.aggregate(F.expr(f"transform({frames}, f -> f.histogram[{k}])"), F.lit(0).cast("long"), lambda a, x: a + x) for k in range(BINS)]
    return F.concat_ws(";", F.concat(F.lit("frames="), F.size(frames)), F.concat(F.lit("cs="), F.aggregate(F.col(frames), F.lit(0), lambda a, f: a + f["delay_cs"])), F.concat(F.lit("grey="), F.concat_ws(",", *grey)))
