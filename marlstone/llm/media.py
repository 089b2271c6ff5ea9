"""GIF media columns: LZW coding, palettes, disposal and transparency, timed frames with histograms.

`encode` writes a GIF89a animation; `decode` reads any GIF and returns each frame composed on
the canvas (RGB), the colour indices, its delay and its colour histogram.

Defined cases: a null text is empty and becomes one frame of padding; a long text becomes more
frames; equal texts give equal bytes; an empty table gives no rows; other columns are ignored.
The payload is read back from the composed canvas, so palettes, disposal and transparency all
have to be right for it to come back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marlstone.llm._text import result, slices

SIDE = 24
SQUARE = SIDE * SIDE
#: Squares to a frame at most.
BLOCKS = 8
GREYS = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
#: Table entries, and bits of a code, at most.
ENTRIES, MOST_BITS = 4096, 12
#: Hundredths of a second for each square of a frame.
DELAY = 4
#: Frames stay, are put back to what was before them, and are cleared to the background, in turn.
DISPOSALS = (1, 3, 2)


@dataclass
class Frame:
    indices: np.ndarray  # height x width of the frame's own rectangle
    canvas: np.ndarray  # height x width x 3 of the whole picture after this frame
    delay_ms: int
    start_ms: int
    histogram: np.ndarray  # of the canvas: 64 bins, two bits of each of red, green and blue


@cache
def _widths(code_size: int) -> np.ndarray:
    """Bits of the first ENTRIES codes after a clear code; every code but the first adds a table entry."""
    size = np.arange(ENTRIES) + (1 << code_size) + 1
    return np.minimum(np.maximum(np.frexp(size.astype(np.float64))[1], code_size + 1), MOST_BITS)


def lzw_codes(samples: bytes) -> tuple[list[int], list[int]]:
    """The codes of 8-bit samples by a growing table, cleared whenever it is full, and where the clear codes stand."""
    codes, clears = [256], [0]
    put, left = codes.append, iter(samples)
    word = next(left, None)
    while word is not None:
        find, following = dict[int, int]().setdefault, 258
        for sample in left:
            longer = find(word << 8 | sample, following)
            if longer != following:
                word = longer
                continue
            put(word)
            word = sample
            following += 1
            if following == ENTRIES:  # the word just begun starts the next table
                clears.append(len(codes))
                put(256)
                break
        else:
            put(word)
            word = None
    return codes, clears


def lzw_pack(samples: bytes) -> bytes:
    """An LZW stream of 8-bit samples with codes of 9 to 12 bits."""
    codes, clears = lzw_codes(samples)
    codes.append(257)
    runs = np.diff(np.append(clears, len(codes)))
    # a clear code is as wide as the codes of the table that it ends
    since = np.arange(len(codes)) - np.repeat(np.array(clears), runs) - 1
    since[clears[1:]] = runs[:-1] - 1
    since[0] = 0
    width = _widths(8)[since]
    end = np.cumsum(width)
    start = end - width
    shifted = np.array(codes, dtype=np.int64) << (start & 7)
    out = np.zeros((int(end[-1]) + 7 >> 3) + 2, dtype=np.uint8)
    for k in range(3):  # a code touches three bytes at most; with over eight bits to a code, no two begin in one byte
        out[(start >> 3) + k] |= (shifted >> 8 * k & 255).astype(np.uint8)
    return out[:-2].tobytes()


def lzw_unpack(stream: bytes, code_size: int, n: int) -> np.ndarray:
    """The first n samples of an LZW code stream.

    Codes are cut out of the stream a run at a time, for their widths follow from their number
    since the last clear code. A table entry is a piece of what was already put out: that of the
    code which added it, and the sample after it. So the table is an array of places in the
    output, and samples are fetched from there by following such places to their literals.
    """
    clear = 1 << code_size
    held = np.frombuffer(stream + bytes(4), dtype=np.uint8).astype(np.uint32)
    bit, most, out, size = 0, len(stream) * 8, [], 0
    run: list[np.ndarray] = []  # codes since the last clear code
    while bit < most and size < n:
        since = sum(map(len, run))
        fit = (most - bit) // (code_size + 1) + 1
        width = _widths(code_size)[:fit] if not since else np.full(min(fit, ENTRIES), MOST_BITS)
        ends = bit + np.cumsum(width)
        width = width[ends <= most]
        if not len(width):
            break
        starts = ends[: len(width)] - width
        byte = starts >> 3
        codes = ((held[byte] | held[byte + 1] << 8 | held[byte + 2] << 16) >> (starts & 7).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        taken = int(stop[0]) if len(stop) else len(codes)
        run.append(codes[:taken])
        bit = int(ends[min(taken, len(codes) - 1)])
        if len(stop) or bit + code_size >= most:
            out.append(_samples(np.concatenate(run).astype(np.int64), clear))
            size += len(out[-1])
            run = []
        if len(stop) and codes[taken] == clear + 1:
            break
    if run:
        out.append(_samples(np.concatenate(run).astype(np.int64), clear))
    return np.concatenate([*out, np.zeros(0, dtype=np.uint8)])[:n].astype(np.uint8)


def _samples(codes: np.ndarray, clear: int) -> np.ndarray:
    """What codes between two clear codes stand for."""
    number = np.arange(len(codes))
    literal = codes < clear
    entry = np.where(literal, -1, codes - clear - 2)  # the code that added the entry
    if (entry >= number).any():
        raise ValueError("LZW code outside the table")
    length, above = np.ones(len(codes), dtype=np.int64), entry.copy()
    while True:  # a code is one sample longer than the one that its entry comes from
        deeper = np.flatnonzero(above >= 0)
        if not len(deeper):
            break
        length[deeper], above[deeper] = length[deeper] + length[above[deeper]], above[above[deeper]]
    first = np.cumsum(length) - length
    total = int(length.sum())
    place = np.arange(total)
    source = np.repeat(np.where(literal, first, first[entry]) - first, length) + place
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    out = np.zeros(total, dtype=np.uint8)
    out[first[literal]] = codes[literal]
    return out[source]


def _image(samples: np.ndarray, disposal: int, transparent: int | None) -> bytes:
    """A graphic control block, an image descriptor and the code stream in blocks of up to 255 bytes."""
    rows = len(samples) // SIDE
    stream = lzw_pack(samples.tobytes())
    head = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (transparent is not None), DELAY * (rows // SIDE), transparent or 0, 0)
    parts = [head, struct.pack("<BHHHHBB", 0x2C, 0, 0, SIDE, rows, 0, 8)]
    for s in range(0, len(stream), 255):
        block = stream[s : s + 255]
        parts += [bytes([len(block)]), block]
    return b"".join(parts) + b"\0"


def encode(payload: bytes) -> bytes:
    """A grey animation that shows the payload's bytes in order, SIDE wide and up to BLOCKS squares high.

    Frames are kept, put back and cleared in turn (DISPOSALS). In a frame that has a value to
    spare, samples equal to what the canvas shows already are written as that transparent index.
    Each square counts DELAY hundredths of a second.
    """
    samples = np.frombuffer(payload, dtype=np.uint8)
    most = min(len(samples), BLOCKS * SQUARE)
    canvas = np.zeros(most, dtype=np.uint8)
    parts = [b"GIF89a" + struct.pack("<HHBBB", SIDE, most // SIDE, 0xF7, 0, 0) + GREYS]
    for k, first in enumerate(range(0, len(samples), most)):
        part, disposal = samples[first : first + most], DISPOSALS[k % len(DISPOSALS)]
        spare = np.flatnonzero(np.bincount(part, minlength=256) == 0)
        transparent = int(spare[-1]) if len(spare) else None
        indices = part if transparent is None else np.where(part == canvas[: len(part)], np.uint8(transparent), part)
        parts.append(_image(indices, disposal, transparent))
        if disposal == 1:
            canvas[: len(part)] = part
        elif disposal == 2:
            canvas[: len(part)] = 0
    return b"".join(parts) + b"\x3b"


def decode(media: bytes) -> Iterator[Frame]:
    """Frames in order, under the rules of the GIF89a text for palettes, disposal and transparency."""
    if media[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", media, 6)
    at, palette = 13, None
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        palette = np.frombuffer(media, np.uint8, size, at).reshape(-1, 3)
        at += size
    blank = palette[background] if palette is not None and background < len(palette) else np.zeros(3, np.uint8)
    canvas = np.broadcast_to(blank, (height, width, 3)).copy()
    delay = disposal = clock = 0
    transparent = None
    while at < len(media) and media[at] != 0x3B:
        if media[at] == 0x21:
            label, at = media[at + 1], at + 2
            if label == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", media, at + 1)
                disposal, transparent = (packed >> 2) & 7, index if packed & 1 else None
            while media[at]:
                at += media[at] + 1
            at += 1
            continue
        if media[at] != 0x2C:
            raise ValueError("unknown GIF block")
        left, top, w, h, own = struct.unpack_from("<HHHHB", media, at + 1)
        at, colours = at + 10, palette
        if own & 0x80:
            size = 3 << ((own & 7) + 1)
            colours = np.frombuffer(media, np.uint8, size, at).reshape(-1, 3)
            at += size
        code_size, at = media[at], at + 1
        parts = []
        while media[at]:
            parts.append(media[at + 1 : at + 1 + media[at]])
            at += media[at] + 1
        at += 1
        indices = lzw_unpack(b"".join(parts), code_size, w * h)
        if len(indices) < w * h:
            raise ValueError("GIF frame is cut short")
        indices = indices.reshape(h, w)
        if own & 0x40:  # interlaced: rows 0, 8, ..; 4, 12, ..; 2, 6, ..; 1, 3, ..
            rows = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
            straight = np.empty_like(indices)
            straight[rows] = indices
            indices = straight
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        shown = colours[indices if len(colours) == 256 else np.minimum(indices, len(colours) - 1)][: area.shape[0], : area.shape[1]]
        if transparent is None:
            area[:] = shown
        else:
            seen = (indices != transparent)[: area.shape[0], : area.shape[1]]
            area[seen] = shown[seen]
        view = canvas.copy()
        top_bits = view >> 6
        bins = (top_bits[..., 0] << 4) | (top_bits[..., 1] << 2) | top_bits[..., 2]
        yield Frame(indices, view, delay * 10, clock, np.bincount(bins.ravel(), minlength=64))
        clock += delay * 10
        if disposal == 2:
            area[:] = blank
        elif disposal == 3:
            canvas = before
        delay = disposal = 0
        transparent = None


MEDIA = pa.schema([
    ("doc_id", pa.int64()), ("media", pa.binary()),
    ("frames", pa.list_(pa.struct([("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("histogram", pa.list_(pa.int32()))]))),
])
MEDIA_DDL = "doc_id long, media binary, frames array<struct<start_ms:long,delay_ms:long,histogram:array<int>>>"


def _padded(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % SQUARE or (0 if text else SQUARE))


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, the stored GIF and its timed frames with their colour histograms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in slices(batch, "text", 1 << 19):
                stored = [encode(_padded(data[a:b].tobytes())) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                frames = [[{"start_ms": f.start_ms, "delay_ms": f.delay_ms, "histogram": f.histogram} for f in decode(m)] for m in stored]
                yield result(MEDIA, {"doc_id": rows.column("doc_id"), "media": stored, "frames": frames})

    return docs.select("doc_id", "text").mapInArrow(run, MEDIA_DDL)


DIGEST = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
    ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
])
DIGEST_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(text: bytes) -> tuple:
    media = encode(_padded(text))
    payload, histogram, end = [], np.zeros(64, dtype=np.int64), 0
    for frame in decode(media):
        payload.append(frame.canvas[: len(frame.indices), :, 0].tobytes())
        histogram += frame.histogram
        end = frame.start_ms + frame.delay_ms
    back = b"".join(payload)
    feature = f"{len(payload)}x{SIDE}:{end}ms:" + ",".join(f"{i}={histogram[i]}" for i in np.flatnonzero(histogram))
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def digest(docs: DataFrame) -> DataFrame:
    """Store each text as a GIF, read it back and describe what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                found = [_digest(data[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                columns = dict(zip(DIGEST.names[1:], zip(*found, strict=True), strict=True))
                yield result(DIGEST, {"doc_id": rows.column("doc_id").cast(pa.int64())} | {k: list(v) for k, v in columns.items()})

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST_DDL)
