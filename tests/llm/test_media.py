"""Motion-JPEG in AVI: frames of the baseline process, indexes, lists of records and damage."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import avi


class Writer:
    """Bits of a scan, with stuffed FF bytes."""

    def __init__(self):
        self.bits = ""

    def put(self, code, length):
        self.bits += format(code, f"0{length}b") if length else ""

    def data(self):
        whole = self.bits + "1" * (-len(self.bits) % 8)
        return int(whole, 2).to_bytes(len(whole) // 8, "big").replace(b"\xff", b"\xff\x00") if whole else b""


def code_of(table):
    """symbol -> (code, length) of a table over 16 bits."""
    out = {}
    for at, entry in enumerate(table.tolist()):
        if entry and entry & 255 not in out:
            out[entry & 255] = (at >> (16 - (entry >> 8)), entry >> 8)
    return out


def baseline(planes, sampling, quant=2, tables=True, interval=0):
    """A baseline frame of planes (one for each component, in full blocks of its sampling), by a plain encoder."""
    lines, width = planes[0].shape
    waves = np.array([[np.cos((2 * x + 1) * k * np.pi / 16) * (np.sqrt(0.125) if k == 0 else 0.5) for x in range(8)] for k in range(8)])
    dcs, acs = code_of(avi._usual(0, 0)), code_of(avi._usual(1, 0))
    across, down = max(h for h, _ in sampling), max(v for _, v in sampling)
    wide, high = -(-width // (8 * across)), -(-lines // (8 * down))
    grids = []
    for plane, (h, v) in zip(planes, sampling, strict=True):
        full = np.pad(plane, ((0, high * v * 8 - plane.shape[0]), (0, wide * h * 8 - plane.shape[1])), mode="edge").astype(float) - 128
        blocks = full.reshape(high * v, 8, wide * h, 8).swapaxes(1, 2)
        grids.append(np.rint(waves @ blocks @ waves.T / quant).astype(int))
    scans, bits, before = [], Writer(), [0] * len(planes)
    number = lambda v: (abs(v).bit_length(), v if v > 0 else v + (1 << abs(v).bit_length()) - 1)
    for n in range(wide * high):
        if interval and n and n % interval == 0:
            scans.append(bits.data())
            bits, before = Writer(), [0] * len(planes)
        y, x = divmod(n, wide)
        for k, (h, v) in enumerate(sampling):
            for j in range(v):
                for i in range(h):
                    flat = grids[k][y * v + j, x * h + i].reshape(64)[avi.ZIGZAG].tolist()
                    size, value = number(flat[0] - before[k])
                    before[k] = flat[0]
                    bits.put(*dcs[size])
                    bits.put(value if size else 0, size)
                    run = 0
                    last = max((p for p in range(1, 64) if flat[p]), default=0)
                    for c in flat[1 : last + 1]:
                        if not c:
                            run += 1
                            continue
                        while run > 15:
                            bits.put(*acs[0xF0])
                            run -= 16
                        size, value = number(c)
                        bits.put(*acs[run << 4 | size])
                        bits.put(value, size)
                        run = 0
                    if last < 63:
                        bits.put(*acs[0])
    scans.append(bits.data())
    body = b"".join(s + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(scans) else b"") for i, s in enumerate(scans))
    head = b"\xff\xd8" + avi._segment(0xDB, bytes([0]) + bytes([quant] * 64))
    if tables:
        for kind in (0, 1):
            counts, first = avi.USUAL_CODES[kind, 0]
            every = [r << 4 | n for r in range(16) for n in range(1, 11)] + [0, 0xF0] if kind else range(12)
            head += avi._segment(0xC4, bytes([kind << 4, *counts, *first, *sorted(set(every) - set(first))]))
    if interval:
        head += avi._segment(0xDD, struct.pack(">H", interval))
    parts = b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))
    head += avi._segment(0xC0, struct.pack(">BHHB", 8, lines, width, len(planes)) + parts)
    head += avi._segment(0xDA, bytes([len(planes), *(x for i in range(len(planes)) for x in (i + 1, 0)), 0, 63, 0]))
    return head + body + b"\xff\xd9"


def picture(lines, width, shift=0):
    y, x = np.mgrid[0:lines, 0:width]
    return np.clip(128 + 60 * np.sin(x / 7 + shift) + 50 * np.cos(y / 5) + shift * 9, 0, 255).astype(np.uint8)


@pytest.mark.parametrize(("lines", "width", "sampling", "tables", "interval"), [(16, 24, [(1, 1)], True, 0), (21, 30, [(1, 1)], False, 2), (32, 48, [(2, 2), (1, 1), (1, 1)], True, 3), (20, 36, [(2, 1), (1, 1), (1, 1)], False, 0)])
def test_baseline_frames(lines, width, sampling, tables, interval):
    across, down = max(h for h, _ in sampling), max(v for _, v in sampling)
    planes = [picture(-(-lines * v // down), -(-width * h // across), k) for k, (h, v) in enumerate(sampling)]
    got = avi.baseline_planes(baseline(planes, sampling, tables=tables, interval=interval))
    assert [g.shape for g in got] == [p.shape for p in planes]
    assert max(np.abs(g.astype(int) - p).max() for g, p in zip(got, planes, strict=True)) <= 6


def movie(frames, lines=16, width=24, index=True, records=False):
    parts, entries, at = [], [], 4
    for frame in frames:
        chunk = avi._chunk(b"00dc", frame)
        entries.append(b"00dc" + struct.pack("<III", 0x10, at, len(frame)))
        parts.append(avi._chunk(b"LIST", b"rec " + chunk) if records else chunk)
        at += len(parts[-1])
    head = avi._chunk(b"LIST", b"hdrl" + avi._chunk(b"avih", struct.pack("<14I", 100_000, *[0] * 13)))
    return avi._chunk(b"RIFF", b"AVI " + head + avi._chunk(b"LIST", b"movi" + b"".join(parts)) + (avi._chunk(b"idx1", b"".join(entries)) if index else b""))


def test_clips_of_baseline_media_follow_the_file_s_rate(spark):
    dark, light = (baseline([np.full((16, 24), v, np.uint8)], [(1, 1)]) for v in (20, 220))
    whole = movie([dark] * 4 + [light] * 6)
    media = [
        (1, whole), (2, movie([dark] * 3, records=True, index=False)), (3, movie([dark, b"\xff\xd8junk", light])), (4, b"no media"), (5, None), (6, whole[: len(whole) // 2]), (7, movie([b"x"])), (8, b""),
        (9, avi.encode_files([b"a" * 192 * 40])[0]), (1, whole)]
    rows = avi.clips(spark.createDataFrame(media, "doc_id long, media binary").withColumn("status", F.lit("clash"))).collect()
    of = lambda key: [(r["first_frame"], r["last_frame"], r["start_s"], r["end_s"]) for r in rows if r["doc_id"] == key]
    assert of(1) == [(0, 3, 0.0, pytest.approx(0.4)), (4, 9, pytest.approx(0.4), pytest.approx(1.0))] * 2
    assert of(2) == [(0, 2, 0.0, pytest.approx(0.3))] and len(of(3)) >= 1 and of(4) == of(7) == of(8) == [(None,) * 4] and of(5) == []
    status = {r["doc_id"]: r["status"] for r in rows}
    assert status[1] == status[2] == status[9] == "ok" and status[3].startswith("damaged: 1 of 3 frames") and status[4] == "damaged: not an AVI file"
    assert of(9) == [(0, 2, 0.0, 0.12)] and of(6) and avi.clips(spark.createDataFrame([], "doc_id long, media binary")).collect() == []


def test_no_bytes_crash_the_reader():
    rnd = np.random.default_rng(2)
    whole = bytearray(movie([baseline([picture(16, 24)], [(1, 1)]), *avi.riff_frames(avi.encode_files([bytes(range(192)) * 3])[0])]))
    for _ in range(300):
        broken = bytearray(whole)
        for at in rnd.integers(0, len(broken), 4):
            broken[at] = rnd.integers(0, 256)
        frames, rate, status = avi.read_media(bytes(broken[: rnd.integers(1, len(broken) + 1)]))
        assert isinstance(status, str) and rate > 0 and all(f.ndim == 2 for f in frames)


def test_equal_texts_and_very_long_ones(spark):
    long = "lang ü " * 200_000
    rows = avi.media_round_trip(spark.createDataFrame([(1, long), (2, long), (None, "")], "doc_id long, text string").withColumn("feature", F.lit(1))).collect()
    assert tuple(rows[0])[1:] == tuple(rows[1])[1:] and rows[0]["n_bytes"] == len(long.encode()) and rows[2]["payload_bytes"] == 192
    assert rows[2]["feature"] == "frames=1;clips=0-0@0.00-0.04"
