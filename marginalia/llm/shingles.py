"""Word shingles of whole texts as 64-bit numbers, computed with numpy over the bytes of many texts at once.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, after A-Z became a-z. A word's number is a polynomial
over a random table of bytes, taken as a difference of running sums; a shingle's number mixes those of its words in
order. Two different shingles agree by chance with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**64 - 1, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x5851F42D4C957F2D)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
#: Odd, one for each place of a word in a shingle.
_PLACE = _RANDOM.integers(1, 2**64 - 1, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes hashed at once; also the size of the tables of powers.
_STRIDE = 1 << 16
_TABLES: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            out = np.full(_STRIDE + 1, base, np.uint64)
            out[0] = 1
            _TABLES[name] = np.multiply.accumulate(out)
    return _TABLES["up"], _TABLES["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xCA5A826395121157)
    return x ^ (x >> np.uint64(32))


def _words_in(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of at most _STRIDE bytes."""
    up, down = _powers()
    is_word = ~_SPACE[data]
    edges = np.diff(np.concatenate(([False], is_word, [False])).view(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of a text of more than _STRIDE bytes: in strides that end between words.

    A single word of more than a stride is hashed as a chain over its pieces.
    """
    found, at = [], 0
    while at < len(data):
        end = min(at + _STRIDE, len(data))
        chain = None
        while end < len(data) and not _SPACE[data[end]] and not _SPACE[data[end - 1]]:
            spaces = np.flatnonzero(_SPACE[data[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
                break
            piece = _words_in(data[at:end])[0]  # one piece of a longer word
            chain = piece if chain is None else _mix(chain * _PLACE[0] + piece)
            at, end = end, min(end + _STRIDE, len(data))
        words = _words_in(data[at:end])[0]
        if chain is not None and len(words) and not _SPACE[data[at]]:
            words[0] = _mix(chain * _PLACE[0] + words[:1])[0]
        elif chain is not None:
            words = np.concatenate((chain, words))
        found.append(words)
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _groups(texts: Iterable[bytes | None]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        text = text or b""
        if held and size + len(text) + 1 > _STRIDE:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield held


def shingle_rows(texts: Iterable[bytes | None], words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For groups of texts: the shingles of all of them, in order and with repeats, and the offsets of each text.

    With fewer than ``words`` words, all words make one shingle; a text without words has none.
    """
    for group in _groups(texts):
        if len(group) == 1 and len(group[0]) > _STRIDE - 1:
            hashes = _long_words(np.frombuffer(group[0], np.uint8))
            counts = np.array([len(hashes)])
        else:
            hashes, starts = _words_in(np.frombuffer(b" ".join(group) + b" ", np.uint8))
            ends = np.cumsum([len(t) + 1 for t in group])
            counts = np.diff(np.concatenate(([0], np.searchsorted(starts, ends))))
        sizes = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        firsts = np.concatenate(([0], np.cumsum(counts)))[:-1]
        at = np.repeat(firsts - offsets[:-1], sizes) + np.arange(offsets[-1])
        length = np.repeat(np.minimum(counts, words), sizes)
        padded = np.concatenate((hashes, np.zeros(words, np.uint64)))
        out = length.astype(np.uint64)
        for place in range(words):
            out += np.where(length > place, padded[at + place] * _PLACE[place], np.uint64(0))
        yield _mix(out), offsets
