"""Media columns: AVI files with motion-JPEG frames, written and read with numpy.

Payloads are stored as JPEG images of the lossless process (SOF3, 8-bit samples, one component, prediction from the
left), so bytes come back as they were. Every line is a restart interval: the lines of all frames of many files are
therefore decoded side by side, one sample of each at a time, by a table over the next 17 bits.

``read_media`` reads AVI files in general: RIFF chunks, ``rec`` lists, the idx1 index or, without a sound one, the movi
list in order; frames of the lossless process as above, and of the baseline process with their own quantisation and
Huffman tables (the usual ones where a frame leaves them out, as motion-JPEG may), restarts and any sampling. What is
damaged gets a status, and frames that cannot be decoded are left out.

``clips`` cuts media into shots where the histogram difference of neighbouring frames stands out from those around it,
a row with its times for each.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.cluster import ship, then_give_back

WIDTH, LINES, FRAMES_A_SECOND = 192, 16, 25
#: Fixed values (JPEG standard, table K.3): how many Huffman codes of 1..16 bits there are; the symbols are 0..11.
CODE_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
BINS, AROUND, DEVIATIONS, LEAST_CUT = 16, 8, 3.0, 0.25
#: Fixed values (JPEG standard, tables K.3 to K.6): numbers of codes of 1..16 bits and their symbols; of the tables for
#: AC coefficients the symbols up to 15 bits, the others follow by value. And the zigzag order of coefficients.
USUAL_CODES = {
    (0, 0): ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), ()),
    (0, 1): ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), ()),
    (1, 0): ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), (0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82)),
    (1, 1): ((0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119), (0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22, 0x32, 0x81, 0x08, 0x14, 0x42, 0x91, 0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1)),
}
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
#: Frames of more samples than this are taken for damage.
MOST_SAMPLES = 1 << 28


def _codes() -> list[tuple[int, int]]:
    """(code, length) of each symbol, in canonical order."""
    out, code = [], 0
    for length, count in enumerate(CODE_COUNTS, 1):
        for _ in range(count):
            out.append((code, length))
            code += 1
        code <<= 1
    return out


def _encoder_table() -> tuple[np.ndarray, np.ndarray]:
    """For a difference plus 255: its bits (symbol, then the value in as many bits), and their number."""
    bits, lengths, codes = np.zeros(511, np.uint64), np.zeros(511, np.int64), _codes()
    for difference in range(-255, 256):
        size = abs(difference).bit_length()
        code, length = codes[size]
        value = difference if difference >= 0 else difference + (1 << size) - 1
        bits[difference + 255] = code << size | value
        lengths[difference + 255] = length + size
    return bits, lengths


def _decoder_table() -> tuple[np.ndarray, np.ndarray]:
    """For the next 17 bits: the difference and the bits used (0: no code)."""
    difference, used = np.zeros(1 << 17, np.int16), np.zeros(1 << 17, np.int64)
    for size, (code, length) in enumerate(_codes()[:9]):
        rest = 17 - length - size
        for value in range(1 << size):
            low = (code << size | value) << rest
            real = value if size == 0 or value >> (size - 1) else value - (1 << size) + 1
            difference[low : low + (1 << rest)] = real
            used[low : low + (1 << rest)] = length + size
    return difference, used


_TABLES: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _table(name: str) -> tuple[np.ndarray, np.ndarray]:
    if name not in _TABLES:
        _TABLES[name] = _encoder_table() if name == "in" else _decoder_table()
    return _TABLES[name]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head(lines: int) -> bytes:
    huffman = bytes([0, *CODE_COUNTS, *range(sum(CODE_COUNTS))])
    frame = struct.pack(">BHHBBBB", 8, lines, WIDTH, 1, 1, 0x11, 0)
    return b"\xff\xd8" + _segment(0xC4, huffman) + _segment(0xDD, struct.pack(">H", WIDTH)) + _segment(0xC3, frame) + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def _entropy(lines: np.ndarray) -> list[bytes]:
    """The coded bytes of each line (a row of samples): padded with ones, FF bytes stuffed."""
    table, lengths = _table("in")
    before = np.concatenate((np.full((len(lines), 1), 128, np.int16), lines[:, :-1].astype(np.int16)), axis=1)
    which = lines.astype(np.int16) - before + 255
    sizes = lengths[which]
    ends = np.cumsum(sizes, axis=1)
    n_bytes = (ends[:, -1] + 7) // 8
    starts = np.concatenate(([0], np.cumsum(n_bytes)))
    pad = n_bytes * 8 - ends[:, -1]
    first = (starts[:-1, None] * 8 + ends - sizes).reshape(-1)
    bits, sizes = table[which].reshape(-1), sizes.reshape(-1)
    # each code lies in at most two 32-bit words; codes do not overlap, so sums are unions
    word, shift = first >> 5, 64 - (first & 31) - sizes
    wide = bits << shift.astype(np.uint64)
    high, low = wide >> np.uint64(32), wide & np.uint64(0xFFFFFFFF)
    count = int(starts[-1]) // 4 + 2
    words = np.bincount(word, weights=high, minlength=count) + np.bincount(word + 1, weights=low, minlength=count)
    data = words.astype(np.uint32).astype(">u4").view(np.uint8)[: starts[-1]].copy()
    data[starts[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    full = np.flatnonzero(data == 0xFF)
    moved = starts + np.searchsorted(full, starts)
    stuffed = np.insert(data, full + 1, 0).tobytes()
    return [stuffed[a:b] for a, b in zip(moved[:-1].tolist(), moved[1:].tolist(), strict=True)]


_RESTART = [bytes([0xFF, 0xD0 + i]) for i in range(8)]


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _avi(frames: list[bytes], lines: int) -> bytes:
    most = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FRAMES_A_SECOND, most * FRAMES_A_SECOND, 0, 0x10, len(frames), 0, 1, most, WIDTH, lines, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, FRAMES_A_SECOND, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, WIDTH, lines)
    image = struct.pack("<IiiHH4sIiiII", 40, WIDTH, lines, 1, 8, b"MJPG", WIDTH * lines, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", image)))
    parts, index, at = [b"movi"], [], 4
    for frame in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(frame)))
        parts.append(_chunk(b"00dc", frame))
        at += len(parts[-1])
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"".join(parts)) + _chunk(b"idx1", b"".join(index)))


def encode_files(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload, whose length must be a positive multiple of WIDTH: a sample for each byte."""
    if not payloads:
        return []
    lines = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH)
    coded: list[bytes] = []
    for start in range(0, len(lines), 4096):
        coded += _entropy(lines[start : start + 4096])
    out, at = [], 0
    for payload in payloads:
        count, frames = len(payload) // WIDTH, []
        for first in range(0, count, LINES):
            own = coded[at + first : at + min(first + LINES, count)]
            body = [x for i, line in enumerate(own) for x in ((_RESTART[(i - 1) % 8], line) if i else (line,))]
            frames.append(_jpeg_head(len(own)) + b"".join(body) + b"\xff\xd9")
        at += count
        out.append(_avi(frames, min(LINES, count)))
    return out


class Damaged(ValueError):
    """Media that cannot be read as they are."""


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the chunks between two places; the last one may be cut off. Lists of records are entered."""
    while at + 8 <= end:
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        stop = min(at + 8 + size, end)
        if kind == b"LIST" and data[at + 8 : at + 12] == b"rec ":
            yield from _chunks(data, at + 12, stop)
        else:
            yield kind, at + 8, stop
        at += 8 + size + size % 2


def _is_frame(kind: bytes) -> bool:
    return kind[2:] in (b"dc", b"db")


def _layout(data: bytes) -> tuple[list[tuple[int, int]], list[tuple[bytes, int, int]], float]:
    """(movi lists, index entries, frames a second) of an AVI file, from all of its RIFF parts."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise Damaged("not an AVI file")
    movi, index, rate, at = [], [], float(FRAMES_A_SECOND), 0
    while data[at : at + 4] == b"RIFF":
        size = struct.unpack_from("<I", data, at + 4)[0] if at + 8 <= len(data) else 0
        end = min(len(data), at + 8 + size)
        for kind, start, stop in _chunks(data, at + 12, end):
            if kind == b"LIST" and data[start : start + 4] == b"movi":
                movi.append((start, stop))
            elif kind == b"LIST" and data[start : start + 4] == b"hdrl":
                for inner, low, high in _chunks(data, start + 4, stop):
                    if inner == b"avih" and high - low >= 4 and (micro := struct.unpack_from("<I", data, low)[0]):
                        rate = 1e6 / micro
            elif kind == b"idx1":
                index += [struct.unpack_from("<4sIII", data, i) for i in range(start, stop - 15, 16)]
        at += 8 + size + size % 2
    if not movi:
        raise Damaged("no movi list")
    return movi, [(kind, where, size) for kind, _, where, size in index], rate


def _indexed(data: bytes, start: int, index: list[tuple[bytes, int, int]]) -> list[bytes] | None:
    """The frames that an index names, by places from the movi list or from the file's start; None if it is not sound."""
    wanted = [e for e in index if _is_frame(e[0])]
    for base in (start, 0):
        places = [base + where for _, where, _ in wanted]
        if wanted and all(data[p : p + 8] == kind + struct.pack("<I", size) and p + 8 + size <= len(data) for p, (kind, _, size) in zip(places, wanted, strict=True)):
            return [data[p + 8 : p + 8 + size] for p, (_, _, size) in zip(places, wanted, strict=True)]
    return None


def riff_frames(data: bytes) -> list[bytes]:
    """The frames of an AVI file, by its index; without a sound one, in the order of the movi lists."""
    movi, index, _ = _layout(data)
    found = _indexed(data, movi[0][0], index)
    return found if found is not None else [data[a:b] for start, stop in movi for kind, a, b in _chunks(data, start + 4, stop) if _is_frame(kind)]


_SCANS: dict[bytes, tuple[int, int, int]] = {}


def _scan(frame: bytes) -> tuple[int, int, int]:
    """(lines, width, start of the coded data) of a frame, from its segments; equal heads are read once."""
    end = frame.find(b"\xff\xda")
    head = frame[: end + 10]
    if head in _SCANS:
        return _SCANS[head]
    at, lines, width, interval, table = 2, 0, 0, 0, b""
    while at < len(frame):
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xC3:
            bits, lines, width, parts = struct.unpack_from(">BHHB", body)
            if bits != 8 or parts != 1:
                raise Damaged("only 8-bit frames of one component are read")
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise Damaged("only lossless frames are read")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xC4:
            table = body
        elif marker == 0xDA:
            break
        at += 2 + size
    if interval != width or table != bytes([0, *CODE_COUNTS, *range(sum(CODE_COUNTS))]) or body[3:] != bytes([1, 0, 0]):
        raise Damaged("only frames with a restart at each line, the usual code table and prediction from the left are read")
    if len(_SCANS) < 4096:
        _SCANS[head] = lines, width, at + 2 + size
    return lines, width, at + 2 + size


def _decode_lines(coded: list[bytes], width: int) -> np.ndarray:
    """Samples of coded lines (unstuffed), all lines at once and one sample of each at a time."""
    difference, used = _table("out")
    data = np.frombuffer(b"".join(coded) + b"\xff" * 8, np.uint8).astype(np.uint32)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    at = np.concatenate(([0], np.cumsum([len(x) for x in coded])))[:-1] * 8
    stop = at + np.array([len(x) for x in coded]) * 8
    found = np.empty((width, len(coded)), np.int16)
    for i in range(width):
        key = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(15)
        found[i] = difference[key]
        at += used[key]
    if (at > stop).any() or (stop - at >= 8).any():
        raise Damaged("damaged frame")
    return ((np.cumsum(found, axis=0, dtype=np.int32) + 128) & 0xFF).astype(np.uint8).T


def _lines_of(frame: bytes) -> tuple[list[bytes], int, int]:
    """(coded lines, lines, width) of a lossless frame."""
    lines, width, start = _scan(frame)
    end = frame.rfind(b"\xff\xd9")
    if end < start:
        raise Damaged("a frame without an end")
    # after this a marker is FF D0..D7 and a stuffed FF is FF 00 00: cut at the markers, then unstuff
    own = [frame[start:end].replace(b"\xff\x00", b"\xff\x00\x00")]
    for mark in _RESTART[: min(8, lines - 1)]:
        own = [x for part in own for x in part.split(mark)]
    if len(own) != lines:
        raise Damaged("a frame with another number of restarts than lines")
    return [x.replace(b"\xff\x00\x00", b"\xff") for x in own], lines, width


def _decode_frame(frame: bytes) -> np.ndarray:
    coded, _, width = _lines_of(frame)
    return _decode_lines(coded, width)


def decode_files(files: list[bytes]) -> list[list[np.ndarray]]:
    """The frames of files of the lossless process as arrays of lines by samples, all lines side by side."""
    places, coded, shapes = [], [], []
    for i, data in enumerate(files):
        for frame in riff_frames(data):
            own, lines, width = _lines_of(frame)
            coded += own
            places.append(i)
            shapes.append((lines, width))
    out: list[list[np.ndarray]] = [[] for _ in files]
    if not coded:
        return out
    width = shapes[0][1]
    if any(w != width for _, w in shapes):
        raise Damaged("frames of one width are read at a time")
    parts = [_decode_lines(coded[a : a + 8192], width) for a in range(0, len(coded), 8192)]
    samples, at = np.concatenate(parts), 0
    for i, (lines, _) in zip(places, shapes, strict=True):
        out[i].append(samples[at : at + lines])
        at += lines
    return out


def _prefix_table(counts: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """For the next 16 bits: length of the code * 256 + its symbol; 0 where there is no code."""
    out, code, at = np.zeros(1 << 16, np.int32), 0, 0
    for length, count in enumerate(counts, 1):
        for symbol in symbols[at : at + count]:
            low = code << (16 - length)
            if low >= 1 << 16:
                raise Damaged("a code table with too many codes")
            out[low : low + (1 << (16 - length))] = length * 256 + symbol
            code += 1
        at += count
        code <<= 1
    return out


def _usual(kind: int, which: int) -> np.ndarray:
    counts, head = USUAL_CODES[kind, min(which, 1)]
    every = [r << 4 | n for r in range(16) for n in range(1, 11)] + [0x00, 0xF0] if kind else range(sum(counts))
    return _prefix_table(counts, (*head, *sorted(set(every) - set(head))))


class _Bits:
    """The coded bits between two restarts."""

    def __init__(self, data: bytes):
        self.size, self.at = len(data) * 8, 0
        self.data = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + b"\xff" * 8, np.uint8).astype(np.uint64)
        self.size = (len(self.data) - 8) * 8
        d = self.data
        self.words = (d[:-4] << np.uint64(32) | d[1:-3] << np.uint64(24) | d[2:-2] << np.uint64(16) | d[3:-1] << np.uint64(8) | d[4:]).tolist()

    def peek(self, count: int) -> int:
        if self.at > self.size:
            raise Damaged("a scan that ends too early")
        return self.words[self.at >> 3] >> (40 - count - (self.at & 7)) & ((1 << count) - 1)

    def symbol(self, table: np.ndarray) -> int:
        found = int(table[self.peek(16)])
        if not found:
            raise Damaged("bits that are no code")
        self.at += found >> 8
        return found & 255

    def value(self, size: int) -> int:
        """A signed number of so many bits."""
        if not size:
            return 0
        bits = self.peek(size)
        self.at += size
        return bits if bits >> (size - 1) else bits - (1 << size) + 1


def _waves() -> np.ndarray:
    """The inverse cosine transform of one dimension."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)


def baseline_planes(frame: bytes) -> list[np.ndarray]:
    """The component planes of a baseline JPEG frame, each in its own resolution, cut to the image's size."""
    at, quant, codes, parts, lines, width, interval = 2, {}, {}, [], 0, 0, 0
    if frame[:2] != b"\xff\xd8":
        raise Damaged("no JPEG frame")
    while True:
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise Damaged("a frame without a scan")
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body, at = frame[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            place = 0
            while place < len(body):
                wide, number = divmod(body[place], 16)
                kind = ">u2" if wide else "u1"
                quant[number] = np.frombuffer(body, kind, 64, place + 1).astype(np.float64)
                place += 1 + 64 * (2 if wide else 1)
        elif marker == 0xC4:
            place = 0
            while place + 17 <= len(body):
                counts = tuple(body[place + 1 : place + 17])
                codes[divmod(body[place], 16)] = _prefix_table(counts, tuple(body[place + 17 : place + 17 + sum(counts)]))
                place += 17 + sum(counts)
        elif marker in (0xC0, 0xC1):
            depth, lines, width, count = struct.unpack_from(">BHHB", body)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
            if depth != 8 or not parts or not 0 < lines * width * max(h * v for _, h, v, _ in parts) <= MOST_SAMPLES:
                raise Damaged("a frame header of another kind")
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise Damaged("a frame of another process")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            break
    if not parts or body[0] != len(parts):
        raise Damaged("a scan without its components")
    tables = {body[1 + 2 * i]: divmod(body[2 + 2 * i], 16) for i in range(body[0])}
    across, down = max(h for _, h, _, _ in parts), max(v for _, _, v, _ in parts)
    wide, high = -(-width // (8 * across)), -(-lines // (8 * down))
    blocks = [np.zeros((high * v, wide * h, 64)) for _, h, v, _ in parts]
    end = frame.rfind(b"\xff\xd9")
    # markers are FF D0..D7 here, all other FF bytes are stuffed
    runs = [_Bits(part) for part in re.split(rb"\xff[\xd0-\xd7]", frame[at : end if end >= at else len(frame)])]
    per = interval or wide * high
    for number in range(wide * high):
        if number % per == 0:
            if number // per >= len(runs):
                raise Damaged("too few restarts")
            bits, before = runs[number // per], [0] * len(parts)
        y, x = divmod(number, wide)
        for k, (name, h, v, _) in enumerate(parts):
            dc, ac = tables[name]
            first, rest = codes.get((0, dc)), codes.get((1, ac))
            if first is None or rest is None:
                codes[0, dc], codes[1, ac] = first, rest = (first if first is not None else _usual(0, dc)), (rest if rest is not None else _usual(1, ac))
            for j in range(v):
                for i in range(h):
                    own = blocks[k][y * v + j, x * h + i]
                    before[k] += bits.value(min(bits.symbol(first), 16))
                    own[0], place = before[k], 1
                    while place < 64:
                        run, size = divmod(bits.symbol(rest), 16)
                        if not size:
                            if run != 15:
                                break
                            place += 16
                            continue
                        place += run
                        if place > 63:
                            raise Damaged("a block with too many coefficients")
                        own[ZIGZAG[place]] = bits.value(size)
                        place += 1
    order, waves, out = np.argsort(ZIGZAG), _waves(), []
    for grid, (_, h, v, number) in zip(blocks, parts, strict=True):
        if number not in quant:
            raise Damaged("a frame without its quantisation table")
        square = (grid * quant[number][order]).reshape(*grid.shape[:2], 8, 8)
        plane = (waves.T @ square @ waves).swapaxes(1, 2).reshape(grid.shape[0] * 8, -1)
        rows, columns = -(-lines * v // down), -(-width * h // across)
        out.append(np.clip(np.rint(plane + 128), 0, 255).astype(np.uint8)[:rows, :columns])
    return out


def _process(frame: bytes) -> int:
    """The marker of a frame's coding process; 0 if there is none."""
    at = 2
    while at + 4 <= len(frame) and frame[at] == 0xFF and frame[at + 1] != 0xDA:
        if 0xC0 <= frame[at + 1] <= 0xCF and frame[at + 1] not in (0xC4, 0xC8, 0xCC):
            return frame[at + 1]
        at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
    return 0


def read_media(data: bytes) -> tuple[list[np.ndarray], float, str]:
    """(frames, frames a second, status) of any media: luminance planes of the frames that can be decoded.

    The status is "ok", or says that the file is no AVI file, or how many frames could not be decoded and why the first.
    """
    try:
        coded, rate = riff_frames(data), _layout(data)[2]
    except (Damaged, struct.error) as error:
        return [], float(FRAMES_A_SECOND), f"damaged: {error}"
    frames, lost, why = [], 0, ""
    for frame in coded:
        try:
            frames.append(_decode_frame(frame) if _process(frame) == 0xC3 else baseline_planes(frame)[0])
        except (Damaged, struct.error, IndexError, KeyError, ValueError) as error:
            lost, why = lost + 1, why or str(error)
    return frames, rate, f"damaged: {lost} of {len(coded)} frames, {why}" if lost else "ok"


def shots(frames: list[np.ndarray]) -> list[tuple[int, int]]:
    """(first, last) frame of each shot.

    A cut stands between two frames whose histograms (BINS bins, as shares) differ by more than LEAST_CUT and by more
    than mean plus DEVIATIONS standard deviations of the other differences at most AROUND frames away.
    """
    if not frames:
        return []
    rows = np.stack([np.bincount(f.reshape(-1) >> 4, minlength=BINS) / f.size for f in frames])
    step = np.abs(np.diff(rows, axis=0)).sum(1) / 2
    cuts = []
    for i, own in enumerate(step):
        near = np.concatenate((step[max(0, i - AROUND) : i], step[i + 1 : i + 1 + AROUND]))
        level = near.mean() + DEVIATIONS * near.std() if len(near) else 0.0
        if own > max(LEAST_CUT, level):
            cuts.append(i + 1)
    return list(zip([0, *cuts], [c - 1 for c in [*cuts, len(frames)]], strict=True))


def payload_of(text: bytes) -> bytes:
    """The text, filled with spaces up to a positive multiple of WIDTH bytes."""
    return text + b" " * (WIDTH - len(text) if not text else -len(text) % WIDTH)


def _runs(values: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for value in values:
        held.append(value)
        size += len(value)
        if size >= 1 << 20:
            yield held
            held, size = [], 0
    if held:
        yield held


def to_media(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, media): the AVI file of each whole text; a null text counts as empty."""
    ship(documents.sparkSession)
    chosen = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _runs(batch.column(1).cast(pa.binary()).to_pylist()):
                files = encode_files([payload_of(t) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(files, pa.binary())], ["doc_id", "media"])
                at += len(texts)

    return chosen.mapInArrow(then_give_back(encode), "doc_id long, media binary")


def clip_times(frames: list[np.ndarray], rate: float) -> list[tuple[int, int, float, float]]:
    """(first frame, last frame, start, end) of each shot, in seconds."""
    return [(a, b, a / rate, (b + 1) / rate) for a, b in shots(frames)]


def clips(media: DataFrame, *, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """(doc_id, clip, first_frame, last_frame, start_s, end_s, status), a row for each shot of each file.

    Files are read whole. Null media have no rows. Media without a frame that can be decoded have one row whose clip is
    null; ``status`` says what is wrong, or "ok". Times follow the file's own frame rate. Repeated rows are read again.
    """
    ship(media.sparkSession)
    chosen = media.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{media_column}`").alias("media")).filter("media IS NOT NULL")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string()]
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                frames, rate, status = read_media(data.as_py())
                rows = [(key, n, *times, status) for n, times in enumerate(clip_times(frames, rate))] or [(key, None, None, None, None, None, status)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "clip", "first_frame", "last_frame", "start_s", "end_s", "status"])

    return chosen.mapInArrow(then_give_back(cut), "doc_id long, clip int, first_frame int, last_frame int, start_s double, end_s double, status string")


def media_round_trip(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A digest of each text stored as media and read back, in one pass: no file leaves the worker.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (number of
    frames, then the clips as first-last@start-end in seconds). Texts are stored whole, however long. A null text counts as empty (a payload of 192 spaces). Equal texts get equal
    values, repeated rows stay, an empty table gives an empty result, other columns play no part.
    """
    ship(documents.sparkSession)
    chosen = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _runs(batch.column(1).cast(pa.binary()).to_pylist()):
                files = encode_files([payload_of(t) for t in texts])
                columns: list[list] = [[] for _ in names[1:]]
                for text, data, frames in zip(texts, files, decode_files(files), strict=True):
                    back = b"".join(f.tobytes() for f in frames)
                    feature = f"frames={len(frames)};clips={','.join(f'{a}-{b}@{x:.2f}-{y:.2f}' for a, b, x, y in clip_times(frames, FRAMES_A_SECOND))}"
                    for column, value in zip(columns, (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *(pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in columns)], names)
                at += len(texts)

    return chosen.mapInArrow(then_give_back(run), schema)
