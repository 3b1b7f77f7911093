"""Safe pieces of texts, and a bounded memory of what a tokenizer makes of them.

For byte-level BPE with the usual pattern (contractions, letters, numbers, other signs, each with at most one leading
space, then runs of white space), no match goes on from a character that is no white space to one that is: a text may
be cut before any white space that follows another character. Texts are cut at all single spaces between other
characters; each distinct piece of a run of texts goes through the library once, and short ones are remembered. A piece
that is still long is cut further: before other white space, and between letters or digits and common punctuation, which
no match spans either. What remains, a run of letters without any sign, is one match and cannot be cut.

Calls of the library are bounded by bytes (but for such a run), because it needs hundreds of bytes for each character.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space beside other white space, or at an end of the text: the text needs the slower cut.
_AWKWARD = re.compile(r"\s | \s|^ | $")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Further places where no match goes on. Letters and signs of which every version of Unicode says the same.
_FURTHER = re.compile(r"(?<=\S)(?=[ \t\n\r])|(?<=[A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])(?=[0-9,.!?;:\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")
#: Characters of a piece that is remembered, and of one that is cut further; pieces in memory; bytes in one call of the
#: library, and of the texts that are cut at once.
SHORT, LONG, REMEMBERED, CALL_BYTES, RUN_BYTES = 48, 4_096, 150_000, 1 << 16, 1 << 19


def runs(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts of a column (null: empty) in runs of about RUN_BYTES bytes of UTF-8, with the place of the first."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0), np.int64)
    start = 0
    while start < len(sizes):
        end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start : start + 8192]), RUN_BYTES)))
        yield start, [t or "" for t in column.slice(start, end - start).to_pylist()]
        start = end


def pieces(text: str) -> list[str]:
    """The pieces of a text; all but the first lack their leading space."""
    plain = "  " not in text and "\n " not in text and " \n" not in text and text[:1] != " " and text[-1:] != " "
    if plain and (text.isascii() and not any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f") or not _AWKWARD.search(text)):
        return text.split(" ")
    return _CUT.split(text)


def further(piece: str, least: int = LONG // 4) -> list[str]:
    """A long piece in parts of at least ``least`` characters (but for the last), as far as it may be cut."""
    cuts, last = [0], 0
    for found in _FURTHER.finditer(piece):
        if found.start() - last >= least:
            last = found.start()
            cuts.append(last)
    return [piece[a:b] for a, b in zip(cuts, [*cuts[1:], len(piece)], strict=True)]


#: Stands before a piece that has no space before it: it is white space, which no other piece starts with.
_BARE = "\n"


def _cut_further(part: str) -> list[str]:
    first, *rest = further(part)
    return [first, *(_BARE + x for x in rest)]


class Memory:
    """What a library makes of pieces: ``value`` of the ids of each, with one entry for each distinct piece.

    Pieces without white space at their ends or inside go through the library many at a time, joined as they stand in
    texts: the ids of each begin where a token begins with a space, and nowhere else (``opens`` by id). Where a
    library's tokens do not fall so, the pieces go through it one by one.
    """

    def __init__(self, library, opens: np.ndarray, value: Callable[[np.ndarray], object]):
        self.library, self.opens, self.value, self.known = library, opens, value, {}

    def of(self, texts: list[str]) -> list[list]:
        """The values of the pieces of each text, in order."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        rows, new = [], set()
        for text in texts:
            parts = pieces(text)
            parts[0] = _BARE + parts[0]
            if len(text) > LONG and max(map(len, parts)) > LONG:
                parts = [x for part in parts for x in (_cut_further(part) if len(part) > LONG else (part,))]
            rows.append(parts)
            new.update(parts)
        new.difference_update(self.known)
        call, alone, size = [], [], 0
        for part in new:
            if part[:1] == _BARE or not part or part[-1].isspace() or " " in part or "<|" in part:
                alone.append(part)
                continue
            call.append(part)
            size += len(part.encode()) if not part.isascii() else len(part)
            if size >= CALL_BYTES:
                self._joined(call)
                call, size = [], 0
        self._joined(call)
        self._each(alone)
        out = [list(map(self.known.__getitem__, parts)) for parts in rows]
        for part in new:
            if len(part) > SHORT or part[:1] == _BARE:
                del self.known[part]
        return out

    def _each(self, parts: list[str]) -> None:
        """Pieces one by one, in calls of a bounded number of bytes."""
        call, size = [], 0
        for i, part in enumerate(parts):
            call.append(part)
            size += len(part.encode())
            if size >= CALL_BYTES or i == len(parts) - 1:
                found = self.library.encode_batch_fast([p[1:] if p[:1] == _BARE else f" {p}" for p in call], add_special_tokens=False)
                self.known.update((p, self.value(np.array(e.ids, "<u4"))) for p, e in zip(call, found, strict=True))
                call, size = [], 0

    def _joined(self, call: list[str]) -> None:
        if not call:
            return
        ids = np.array(self.library.encode_batch_fast([f" {' '.join(call)}"], add_special_tokens=False)[0].ids, "<u4")
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(call):
            self._each(call)
            return
        self.known.update(zip(call, self.value_parts(ids, starts), strict=True))

    def value_parts(self, ids: np.ndarray, starts: np.ndarray) -> list:
        ends = np.append(starts[1:], len(ids)).tolist()
        return [self.value(ids[a:b]) for a, b in zip(starts.tolist(), ends, strict=True)]


class Lengths(Memory):
    """Numbers of ids only."""

    def __init__(self, library, opens: np.ndarray):
        super().__init__(library, opens, len)

    def value_parts(self, ids: np.ndarray, starts: np.ndarray) -> list:
        return np.diff(np.append(starts, len(ids))).tolist()


class Ids(Memory):
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, library, opens: np.ndarray):
        super().__init__(library, opens, bytes)

    def value_parts(self, ids: np.ndarray, starts: np.ndarray) -> list:
        data, ends = ids.tobytes(), np.append(starts[1:], len(ids)) * 4
        return [data[a:b] for a, b in zip((starts * 4).tolist(), ends.tolist(), strict=True)]


def opening(library) -> np.ndarray:
    """By id: whether the token begins with a space (byte-level character U+0120)."""
    out = np.zeros(library.get_vocab_size(with_added_tokens=True) + 1, bool)
    for token, number in library.get_vocab(with_added_tokens=True).items():
        out[number] = token[:1] == "\u0120"
    return out
