import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from duelframe.llm import gif as G


@pytest.mark.parametrize("size", [2, 4, 8])
def test_lzw_round_trip(size):
    r = random.Random(size)
    for n in (0, 1, 2, 3, 1000, 60_000):
        data = bytes(r.randrange(1 << size) for _ in range(n))
        assert G.lzw_decode(G.lzw_encode(data, size), size, n) == data
    assert G.lzw_decode(G.lzw_encode(b"\1" * 50_000, 2), 2, 50_000) == b"\1" * 50_000


def naive_decode(stream, size, n):
    """Bit by bit, as the format is published."""
    bits, at, out = int.from_bytes(stream, "little"), 0, b""
    clear, end, width, table, before = 1 << size, (1 << size) + 1, size + 1, {}, None
    while len(out) < n:
        code, at = bits >> at & ((1 << width) - 1), at + width
        if code == clear:
            table, width, before = {i: bytes([i]) for i in range(clear)} | {clear: b"", end: b""}, size + 1, None
            continue
        if code == end:
            break
        if before is None:
            entry = table[code]
        else:
            entry = table[code] if code in table else before + before[:1]
            if len(table) < 4096:
                table[len(table)] = before + entry[:1]
                if len(table) == 1 << width and width < 12:
                    width += 1
        out, before = out + entry, entry
    return out


def test_streams_follow_the_format():
    r = random.Random(9)
    for n in (1, 300, 9000):
        data = bytes(r.choice(b"abcd  e") for _ in range(n))
        assert naive_decode(G.lzw_encode(data), 8, n) == data


def test_a_full_table_may_stay_in_use():
    """Codes of twelve bits after the table is full, without a clear code."""
    r = random.Random(4)
    data = bytes(r.randrange(256) for _ in range(9000))
    codes = [256, *data, 257]
    widths, known = [], 258
    for i in range(len(codes)):
        widths.append(9 if i < 1 else min(12, max(9, known.bit_length())))
        if i >= 2 and known < 4096:
            known += 1
    widths[1] = 9
    width, out, at = [9], 0, 0
    for i, c in enumerate(codes):
        count = 258 + max(0, i - 2)
        w = 9 if i == 0 else min(12, max(9, count.bit_length()))
        out |= c << at
        at += w
    assert G.lzw_decode(out.to_bytes((at + 7) // 8, "little"), 8, len(data)) == data and width and widths


def block(data):
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def frame(x, y, w, h, pixels, disposal=0, clear=None, delay=5, local=None, interlaced=False):
    control = b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0"
    flags = (0x80 | 0 if local else 0) | 0x40 * interlaced
    return control + b"\x2c" + struct.pack("<HHHHB", x, y, w, h, flags) + (local or b"") + b"\2" + block(G.lzw_encode(pixels, 2))


def test_disposal_transparency_palettes_and_interlacing():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + palette
    data = head + b"\x21\xfe" + block(b"a comment") + frame(0, 0, 2, 2, b"\1\1\1\1") + frame(0, 0, 1, 2, b"\2\3", disposal=2, clear=3) + frame(1, 1, 1, 1, b"\3", disposal=3, delay=7) + frame(0, 0, 1, 1, b"\1", local=bytes([9, 9, 9, 200, 200, 200])) + b"\x3b"
    red, green, blue, black, light = [255, 0, 0], [0, 255, 0], [0, 0, 255], [0, 0, 0], [200, 200, 200]
    out = G.decode(data)
    assert [f.canvas.tolist() for f in out] == [[[red, red], [red, red]], [[green, red], [red, red]], [[black, red], [black, blue]], [[light, red], [black, red]]]
    assert [(f.start_ms, f.duration_ms) for f in out] == [(0, 50), (50, 50), (100, 70), (170, 50)]
    assert out[0].histogram()[48] == 4 and out[0].histogram().sum() == 4
    rows = bytes(range(4)) * 2
    tall = b"GIF87a" + struct.pack("<HHBBB", 1, 8, 0x81, 0, 0) + palette + frame(0, 0, 1, 8, bytes(rows[i] for i in (0, 4, 2, 6, 1, 3, 5, 7)), interlaced=True) + b"\x3b"
    assert G.decode(tall)[0].indices.ravel().tolist() == list(rows)


def test_broken_files_are_errors_not_crashes(spark):
    good = G.encode(b"x" * 192)
    bad = [None, b"", b"GIF89a", good[:-20], b"PNG" + good, good[:800] + b"\x99" + good[801:]]
    df = spark.createDataFrame([(i, b) for i, b in enumerate([good, *bad])], "k long, media binary")
    out = {r.k: r for r in G.frames(df, pixels=True).collect()}
    assert out[0].error is None and bytes(out[0].frames[0].pixels) == b"x" * 192 and sum(out[0].frames[0].histogram) == 192
    assert all(out[i].error and not out[i].frames for i in range(1, 6))


def test_query_values(odd, clashing, rows, nothing):
    for docs in (odd, clashing):
        out = G.digests(G.store(docs)).collect()
        want = []
        for d, t, *_ in rows:
            b = (t or "").encode()
            p = b + b" " * (192 - len(b) if not b else -len(b) % 192)
            want.append((d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
        assert sorted((tuple(r)[:5] for r in out), key=str) == sorted(want, key=str)
    assert G.digests(G.store(nothing)).collect() == []


def test_many_rows_take_several_frames(monkeypatch):
    monkeypatch.setattr(G, "MOST_ROWS", 3)
    data = np.random.default_rng(1).integers(0, 256, 192 * 8).astype(np.uint8).tobytes()
    out = G.decode(G.encode(data))
    assert [f.indices.shape[0] for f in out] == [3, 3, 2] and b"".join(f.indices.tobytes() for f in out) == data


def test_layouts_are_worked_out_once_and_codes_are_the_longest_known(monkeypatch):
    calls, frexp = [], np.frexp
    monkeypatch.setattr(np, "frexp", lambda x: calls.append(len(x)) or frexp(x))
    r = random.Random(6)
    for n in (1, 2, 700, 3839, 3840, 3841, 30_000):
        data = bytes(r.choice(b"abcd  e") for _ in range(n))
        stream = G.lzw_encode(data)
        assert G.lzw_decode(stream, 8, n) == data
        bits, at, count, known, left = int.from_bytes(stream, "little"), 0, 0, {}, data
        while left:  # plain LZW: each code is that of the longest string known
            code, width = bits >> at & 4095, min(12, max(9, (258 + max(0, count - 1)).bit_length()))
            code, at = code & ((1 << width) - 1), at + width
            if code == 256:
                known, count = {bytes([i]): i for i in range(256)}, 0
            else:
                k = next(k for k in range(1, len(left) + 1) if k == len(left) or left[: k + 1] not in known)
                assert code == known[left[:k]]
                known[left[: k + 1]], left, count = 258 + count, left[k:], count + 1
    assert len(calls) <= 1
