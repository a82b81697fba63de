"""GIF: LZW code streams, palettes, disposal, transparency and timed frames."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

CLEAR, END, FULL = 256, 257, 4096
MAX_ROWS = 256
MOST_PIXELS = 1 << 26  # of a canvas; its colours take four bytes each
#: Bits of the n-th code after a clear code (n from 1); a decoder adds no entry for the first one.
_next = 258 + np.maximum(0, np.arange(1 << 13) - 2)
WIDTH = np.clip(np.floor(np.log2(_next)).astype(np.int64) + 1, 9, 12)


@dataclass
class Frame:
    indices: np.ndarray  # rows x columns, as stored
    canvas: np.ndarray  # rows x columns x RGBA, as shown
    delay_ms: int
    histogram: np.ndarray  # pixels shown per colour octant, transparent ones left out


def palette332() -> np.ndarray:
    """256 colours: three bits of red, three of green, two of blue."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85], 1).astype(np.uint8)


def lzw_codes(data: bytes) -> list[int]:
    """Eight-bit samples to codes, from a clear code to the end code."""
    out = [CLEAR]
    emit = out.append
    table: dict[int, int] = {}
    look = table.get
    free, samples = 258, iter(data)
    have = next(samples, None)
    if have is None:
        return [CLEAR, END]
    for sample in samples:
        key = have << 8 | sample
        code = look(key)
        if code is not None:
            have = code
            continue
        emit(have)
        if free == FULL:
            emit(CLEAR)
            table.clear()
            free = 258
        else:
            table[key] = free
            free += 1
        have = sample
    emit(have)
    emit(END)
    return out


def pack_codes(codes: list[int]) -> bytes:
    c = np.array(codes, np.uint16)
    clear = np.flatnonzero(c == CLEAR)
    since = np.arange(len(c)) - clear[np.searchsorted(clear, np.arange(len(c)), "left") - 1]
    since[0] = 1
    width = WIDTH[since]
    bits = np.unpackbits(c.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < width[:, None]], bitorder="little").tobytes()


@lru_cache(16)
def _layout(min_bits: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Widths and ends, in bits, of the codes after a clear code, and of further ones while the table stays full."""
    free = (1 << min_bits) + 2 + np.maximum(0, np.arange(1, 1 << 13) - 2)
    grown = np.clip(np.floor(np.log2(free)).astype(np.int64) + 1, min_bits + 1, 12)
    full = np.full(1 << 12, 12)
    return (grown, np.cumsum(grown)), (full, np.cumsum(full))


def unpack_codes(data: bytes, min_bits: int = 8) -> list[np.ndarray]:
    """The codes between clear codes, up to the end code or the end of the data."""
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    bits, at, parts = len(data) * 8, 0, []
    after_clear, later = _layout(min_bits)
    while True:
        run: list[np.ndarray] = []
        (width, ends), stop = after_clear, False
        while True:
            n = int(np.searchsorted(ends, bits - at, "right"))
            start = at + ends[:n] - width[:n]
            byte = start >> 3
            code = raw[byte] | raw[byte + 1].astype(np.uint32) << 8 | raw[byte + 2].astype(np.uint32) << 16
            code = code >> (start & 7).astype(np.uint32) & ((1 << width[:n]) - 1).astype(np.uint32)
            marks = np.flatnonzero((code == clear) | (code == end))
            if len(marks):
                run.append(code[: marks[0]])
                at, stop = at + int(ends[marks[0]]), code[marks[0]] == end
                break
            run.append(code)
            if n < len(width):
                stop = True
                break
            at += int(ends[-1])
            width, ends = later  # no clear code yet
        parts.append(np.concatenate(run))
        if stop:
            return parts


def lzw_samples(data: bytes, min_bits: int = 8) -> bytes:
    """Codes to samples. A code beyond the table is an error."""
    out: list[bytes] = []
    emit = out.append
    for codes in unpack_codes(data, min_bits):
        table = [bytes((i,)) for i in range(1 << min_bits)] + [b"", b""]
        add, room = table.append, FULL - len(table)
        listed = codes.tolist()
        if not listed:
            continue
        if listed[0] >= 1 << min_bits:
            raise ValueError("LZW code beyond the table")
        emit(before := table[listed[0]])
        for code in listed[1 : room + 1]:
            try:
                now = table[code]
            except IndexError:
                if code != len(table):
                    raise ValueError("LZW code beyond the table") from None
                now = before + before[:1]  # the entry that this very code completes
            emit(now)
            add(before + now[:1])
            before = now
        out += [table[code] for code in listed[room + 1 :]]
    return b"".join(out)


def encode(frames: list[np.ndarray], palette: np.ndarray, delay_ms: int = 40) -> bytes:
    """Frames of 8-bit samples, drawn at the top left one after the other."""
    wide, high = max(f.shape[1] for f in frames), max(f.shape[0] for f in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", wide, high, 0xF7, 0, 0), palette.tobytes()]
    for f in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay_ms // 10, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, f.shape[1], f.shape[0], 0) + b"\x08")
        packed = pack_codes(lzw_codes(f.tobytes()))
        out += [bytes((min(255, len(packed) - i),)) + packed[i : i + 255] for i in range(0, len(packed), 255)]
        out.append(b"\0")
    return b"".join(out) + b"\x3b"


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n  # data[at] raises where the file breaks off
    return b"".join(parts), at + 1


def _deinterlaced(rows: np.ndarray) -> np.ndarray:
    order = np.concatenate([np.arange(len(rows))[first::step] for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
    out = np.empty_like(rows)
    out[order] = rows
    return out


def octants(canvas: np.ndarray) -> np.ndarray:
    """Shown pixels per octant of the colour cube: red 4, green 2, blue 1."""
    high = canvas >> 7
    bins = high[..., 0] * 4 + high[..., 1] * 2 + high[..., 2] + 8 * (canvas[..., 3] == 0)
    return np.bincount(bins.ravel(), minlength=9)[:8]


def decode(data: bytes) -> list[Frame]:
    """All frames as stored and as shown, by the rules of disposal and transparency."""
    return [Frame(f.indices, f.canvas.copy(), f.delay_ms, f.histogram) for f in frames(data)]


def frames(data: bytes) -> Iterator[Frame]:
    """The frames one at a time; a canvas is good until the next frame is asked for.

    Files that break off, break the format or have more than MOST_PIXELS on their
    canvas raise ValueError, also after frames that are whole.
    """
    try:
        yield from _frames(data)
    except (IndexError, struct.error) as e:
        raise ValueError("the file breaks off") from e


def _frames(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    wide, high, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    if wide * high > MOST_PIXELS:
        raise ValueError("the canvas is too large")
    at, common = 13, None
    colours = lambda at, flags: np.frombuffer(data, np.uint8, 3 << (flags & 7) + 1, at).reshape(-1, 3)
    if flags & 0x80:
        common = colours(at, flags)
        at += common.size
    canvas = np.zeros((high, wide, 4), np.uint8)
    delay, dispose, clear_index = 0, 0, None
    while data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            block, at = _blocks(data, at + 2)
            if label == 0xF9:
                packed, ticks, index = struct.unpack("<BHB", block[:4])
                delay, dispose, clear_index = ticks * 10, packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("unknown block")
        x, y, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        palette = common
        if flags & 0x80:
            palette = colours(at, flags)
            at += palette.size
        if palette is None:
            raise ValueError("no palette")
        min_bits = data[at]
        if not 1 <= min_bits <= 8:
            raise ValueError("unknown code size")
        packed, at = _blocks(data, at + 1)
        stored = lzw_samples(packed, min_bits)
        if len(stored) < w * h:
            raise ValueError("too few samples")
        samples = np.frombuffer(stored[: w * h], np.uint8).reshape(h, w)
        if flags & 0x40:
            samples = _deinterlaced(samples)
        saved = canvas.copy() if dispose == 3 else None
        rgba = np.zeros((256, 4), np.uint8)
        rgba[: len(palette), :3], rgba[: len(palette), 3] = palette, 255
        area = canvas[y : y + h, x : x + w]
        part = samples[: area.shape[0], : area.shape[1]]
        drawn = rgba[part]
        area[...] = drawn if clear_index is None else np.where((part == clear_index)[..., None], area, drawn)
        yield Frame(samples, canvas, delay, octants(canvas))
        if dispose == 2:
            canvas[y : y + h, x : x + w] = 0
        elif dispose == 3:
            canvas = saved
        delay, dispose, clear_index = 0, 0, None
