"""GIF media columns: write bytes as pictures without loss, read any GIF into timed frames.

Writing: bytes are palette indices of an image 192 pixels wide, at most 65,535 rows a frame,
compressed by LZW. Reading follows the format as published: logical screen, global and local
palettes, interlacing, graphic control (delay, transparency, disposal to background or to
the previous picture), sub-blocks, LZW code streams with growing widths and clear codes.
A frame has its indices, the composed RGB canvas, its start and duration in milliseconds
and a colour histogram of two bits a channel.

Nulls: null bytes are empty; no bytes are padded to one row. Equal bytes give equal files.
A stream that is no GIF, or ends early, raises ValueError in decode(); the frames operator
returns it with its error text and no frames.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, texts

WIDTH = 192
MOST_ROWS = 65_535
GREY = bytes(v for i in range(256) for v in (i, i, i))
#: More codes than fill a table between two clear codes.
WINDOW = 4200


@functools.cache
def _widths(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Code widths by position since the last clear code, by the decoder's count, and the bits before each."""
    next_code = np.minimum((1 << size) + 2 + np.maximum(np.arange(n) - 1, 0) + 1, 4096)
    widths = np.minimum(np.maximum(np.frexp((next_code - 0.5).astype(float))[1], size + 1), 12)
    return widths, np.cumsum(widths) - widths


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    bits = np.unpackbits(codes.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < widths[:, None]], bitorder="little").tobytes()


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """The code stream of indices below 2**size, without sub-block lengths."""
    clear, last = 1 << size, 4095 << 8  # codes are held shifted, so that one and a byte make a key
    codes: list[int] = []
    segments: list[int] = []  # places of clear codes
    put = codes.append
    at, n = 0, len(data)
    while True:
        segments.append(len(codes))
        put(clear << 8)
        if at >= n:
            break
        table: dict[int, int] = {}
        known, code, w = table.setdefault, clear + 2 << 8, data[at] << 8
        at += 1
        while at < n and code <= last:
            part = data[at : at + (last - code >> 8) + 1]  # a byte gives one code at most, so these fit
            at += len(part)
            for c in part:
                x = known(w | c, code)
                if x is code:  # a new string
                    put(w)
                    w = c << 8
                    code += 256
                else:
                    w = x
        if code <= last:
            put(w)
            break
        at -= 1  # the table is full; the byte in w begins the next
    put(clear + 1 << 8)
    sizes = np.diff([*segments, len(codes)])
    widths, _ = _widths(WINDOW, size)
    # A clear code has the width of the code that would have stood in its place.
    every = np.concatenate(([size + 1], *(widths[:s] for s in sizes)))[:-1]
    return _pack(np.array(codes) >> 8, every)


def lzw_decode(stream: bytes, size: int, expected: int) -> bytes:
    """The indices of a code stream; ValueError if it is broken or ends early."""
    clear, end = 1 << size, (1 << size) + 1
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    bits, at, length, window = len(stream) * 8, 0, 0, WINDOW
    out: list[bytes] = []
    widths, offsets = _widths(window, size)
    while length < expected:
        places = at + offsets[: int(np.searchsorted(offsets + widths, bits - at, "right"))]
        if not len(places):
            break
        byte = places >> 3
        word = raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16
        codes = (word >> (places & 7).astype(np.uint32)) & ((1 << widths[: len(places)]) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stops) and len(places) == window:  # the table is full and stays in use
            window *= 2
            widths, offsets = _widths(window, size)
            continue
        stop = int(stops[0]) if len(stops) else len(codes)
        length += _expand(codes[:stop].tolist(), size, out)
        if stop == len(codes) or codes[stop] == end:
            break
        at += int(offsets[stop] + widths[stop])
    data = b"".join(out)
    if len(data) < expected:
        raise ValueError("the image data ends early")
    return data[:expected]


@functools.cache
def _singles(size: int) -> list[bytes]:
    """The strings of a cleared table; those of the clear and end codes are empty."""
    return [bytes([i]) for i in range(1 << size)] + [b"", b""]


def _expand(codes: list[int], size: int, out: list[bytes]) -> int:
    """Appends the strings of the codes between two clear codes; their length."""
    if not codes:
        return 0
    table = _singles(size).copy()
    if codes[0] >= len(table) - 2:
        raise ValueError("a stream begins with an unknown code")
    before = table[codes[0]]
    own, grow = [before], table.append
    put, growing = own.append, 4097 - len(table)  # codes until the table is full
    for code in codes[1:growing]:
        try:
            entry = table[code]
        except IndexError:
            if code != len(table):
                raise ValueError("a stream has an unknown code") from None
            entry = before + before[:1]
        put(entry)
        grow(before + entry[:1])
        before = entry
    own += [table[code] for code in codes[growing:]]
    joined = b"".join(own)
    out.append(joined)
    return len(joined)


def _blocks(data: bytes) -> bytes:
    whole = len(data) // 255 * 255
    parts = np.frombuffer(data[:whole], np.uint8).reshape(-1, 255)
    led = np.hstack((np.full((len(parts), 1), 255, np.uint8), parts)).tobytes()
    rest = data[whole:]
    return led + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode(payload: bytes, width: int = WIDTH, delay: int = 10) -> bytes:
    """A GIF whose frames, in order, hold the payload as indices into a grey palette; width divides its length."""
    rows = len(payload) // width
    if len(payload) % width or not rows:
        raise ValueError("the payload must be a positive multiple of the width")
    first = min(rows, MOST_ROWS)
    out = [b"GIF89a", struct.pack("<HHBBB", width, first, 0xF7, 0, 0), GREY]
    for at in range(0, rows, MOST_ROWS):
        part = payload[at * width : (at + MOST_ROWS) * width]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 0, delay, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    left: int
    top: int
    indices: np.ndarray  # height x width
    canvas: np.ndarray  # the whole screen after this frame, RGB
    start_ms: int
    duration_ms: int

    def histogram(self) -> np.ndarray:
        """Pixels of the canvas in each of 64 colours, two bits a channel."""
        return histogram(self.canvas.reshape(-1, 3))


def histogram(rgb: np.ndarray) -> np.ndarray:
    top = rgb & 0xC0
    return np.bincount(top[:, 0] >> 2 | top[:, 1] >> 4 | top[:, 2] >> 6, minlength=64)


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("the file ends early")
        self.at += n
        return out

    def numbers(self, form: str) -> tuple:
        return struct.unpack(form, self.take(struct.calcsize(form)))

    def blocks(self) -> bytes:
        out = []
        while n := self.take(1)[0]:
            out.append(self.take(n))
        return b"".join(out)


def _interlaced(rows: int) -> np.ndarray:
    return np.concatenate([np.arange(start, rows, step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes) -> list[Frame]:
    """All frames of a GIF, each composed onto the screen by the rules of the one before it."""
    r = _Reader(data)
    if r.take(6) not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, packed, background, _ = r.numbers("<HHBBB")
    shared = _palette(r, packed)
    back = shared[background] if shared is not None and background < len(shared) else np.zeros(3, np.uint8)
    canvas = np.broadcast_to(back, (height, width, 3))
    frames: list[Frame] = []
    clock, delay, disposal, clear_index = 0, 0, 0, None
    while (kind := r.take(1)) != b"\x3b":
        if kind == b"\x21":
            label = r.take(1)
            body = r.blocks()
            if label == b"\xf9" and len(body) >= 4:
                flags, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear_index = flags >> 2 & 7, index if flags & 1 else None
            continue
        if kind != b"\x2c":
            raise ValueError("an unknown block")
        left, top, w, h, packed = r.numbers("<HHHHB")
        own = _palette(r, packed)
        palette = own if own is not None else shared
        size = r.take(1)[0]
        if not 1 <= size <= 11:
            raise ValueError("a code size out of range")
        pixels = np.frombuffer(lzw_decode(r.blocks(), size, w * h), np.uint8).reshape(h, w)
        if packed & 0x40:
            straight = np.empty_like(pixels)
            straight[_interlaced(h)] = pixels
            pixels = straight
        if palette is None:
            raise ValueError("no palette")
        if len(palette) < 256 and pixels.size and pixels.max() >= len(palette):
            palette = np.vstack((palette, np.zeros((256 - len(palette), 3), np.uint8)))
        seen = pixels[: max(0, height - top), : max(0, width - left)]
        if clear_index is None and seen.shape == canvas.shape[:2]:  # it covers the screen
            drawn = np.take(palette, seen, axis=0)
        else:
            drawn = canvas.copy()
            if clear_index is None:
                drawn[top : top + h, left : left + w] = palette[seen]
            else:
                held = seen != clear_index
                drawn[top : top + h, left : left + w][held] = palette[seen[held]]
        frames.append(Frame(left, top, pixels, drawn, clock, delay * 10))
        clock += delay * 10
        if disposal == 2:
            canvas = drawn.copy()
            canvas[top : top + h, left : left + w] = back
        elif disposal != 3:
            canvas = drawn
        delay, disposal, clear_index = 0, 0, None
    return frames


def _palette(r: _Reader, packed: int) -> np.ndarray | None:
    if not packed & 0x80:
        return None
    n = 2 << (packed & 7)
    return np.frombuffer(r.take(3 * n), np.uint8).reshape(n, 3)


def payload(text: str) -> bytes:
    """UTF-8, filled with spaces up to a positive multiple of WIDTH."""
    data = text.encode()
    return data + b" " * (-len(data) % WIDTH if data else WIDTH)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a GIF."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = texts(batch)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in own], pa.int64()), pa.array([encode(payload(t)) for t in own], pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, media binary")


def frames(media: DataFrame, column: str = "media", pixels: bool = False) -> DataFrame:
    """media's columns but that one, then frames and error.

    frames: array of left, top, width, height, start_ms, duration_ms, histogram (64 counts
    of the composed canvas) and, if asked for, the frame's indices as bytes.
    """
    names = [c for c in media.columns if c != column]
    fields = "left: int, top: int, width: int, height: int, start_ms: long, duration_ms: long, histogram: array<long>, pixels: binary"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, errors = [], []
        for data in batch.column(batch.num_columns - 1).to_pylist():
            try:
                own = decode(data or b"")
                found.append([{"left": f.left, "top": f.top, "width": f.indices.shape[1], "height": f.indices.shape[0], "start_ms": f.start_ms, "duration_ms": f.duration_ms, "histogram": f.histogram().tolist(), "pixels": f.indices.tobytes() if pixels else None} for f in own])
                errors.append(None)
            except ValueError as e:
                found.append([])
                errors.append(str(e))
        kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("left", "top", "width", "height")] + [("start_ms", pa.int64()), ("duration_ms", pa.int64()), ("histogram", pa.list_(pa.int64())), ("pixels", pa.binary())]))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind), pa.array(errors, pa.string())], [*names, "frames", "error"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != column)
    return map_texts(media.select(*names, column), run, f"{kept}, frames array<struct<{fields}>>, error string")


def digests(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what is computed from each stored GIF after reading it back."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = decode(data)
            back = b"".join(f.indices.tobytes() for f in own)
            feature = ";".join(f"{f.start_ms}+{f.duration_ms}:" + ",".join(f"{i}={c}" for i, c in enumerate(f.histogram().tolist()) if c) for f in own)
            rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return map_texts(media.select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
