"""Byte-level BPE over Arrow batches: encoding with the tokenizers library, decoding through the byte table.

A rank file gives byte strings and ranks. The library works on characters, so each of the 256 bytes has a character of
its own (the byte table); printable bytes keep theirs. The merges are recovered from the ranks: a token's last merge
joins the two parts that the tokens of smaller rank make of it. Characters of several bytes may be split between
tokens; decoding therefore joins bytes first and only then reads UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

from marginalia.cluster import ship, then_give_back
from marginalia.llm.pieces import Ids, opening, runs
from marginalia.llm.worker import kept


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The character of each byte: itself if printable in Latin-1 (not a space), else the next free one from U+0100."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(moved)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    parts, limit = [bytes([b]) for b in token], ranks[token]
    while len(parts) > 2:
        at, least = None, limit
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1], limit)
            if rank < least:
                at, least = i, rank
        if at is None:
            raise ValueError(f"token {token!r} cannot be made by merges of smaller rank")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def library_text(path: str, pattern: str) -> str:
    """The tokenizers library's own form of a rank file and a split pattern, as JSON: built once, on the driver."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, table = read_ranks(path), byte_characters()
    as_text = lambda token: "".join(table[b] for b in token)
    merges = [tuple(map(as_text, _last_merge(t, ranks))) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
    library = Tokenizer(models.BPE(vocab={as_text(t): r for t, r in ranks.items()}, merges=merges))
    library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return library.to_str()


class ByteBpe:
    """An encoder and decoder over the library's form of a vocabulary."""

    def __init__(self, text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(text)
        back, vocabulary = {c: b for b, c in enumerate(byte_characters())}, self.library.get_vocab()
        self.bytes_of: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():  # decoding reverses the byte table
            self.bytes_of[number] = bytes(back[c] for c in token)
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.memory = Ids(self.library, opening(self.library))

    @classmethod
    def of(cls, path: str, pattern: str) -> ByteBpe:
        return cls(library_text(path, pattern))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return [b"".join(parts) for parts in self.memory.of(texts)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> list[tuple[int, int]]:
        """The span of each token in the UTF-8 bytes of the text."""
        ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
        return list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)) if len(ends) else []


def encode_documents(documents: DataFrame, *, path: str, pattern: str, text_column: str = "text", keep: list[str] | None = None, ids: bool = True, spans: bool = False) -> DataFrame:
    """The columns ``keep`` (default: all but the text), then n_tokens, ids_sha256, decoded_sha256, and on request
    ``token_ids`` (array<int>) and ``token_spans`` (array of byte offsets, one more than tokens).

    Each text is encoded whole and decoded from its ids. A null text counts as empty: no ids, the digests of nothing.
    Special strings are ordinary text. Long texts go through the library in safe pieces. Rows, repeated ones too, stay as many as they are; an empty table stays empty.
    Output columns replace columns of the input that have their names.
    """
    ship(documents.sparkSession)
    made = ["n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * ids, *["token_spans"] * spans]
    keep = [c for c in (documents.columns if keep is None else keep) if c not in made and (keep is not None or c != text_column)]
    integers = ArrayType(IntegerType())
    kinds = {"n_tokens": LongType(), "ids_sha256": StringType(), "decoded_sha256": StringType(), "token_ids": integers, "token_spans": integers}
    chosen = documents.select(*(F.col(f"`{c}`") for c in keep), F.col(text_column).cast("string").alias("__text"))
    schema = chosen.drop("__text").schema
    for name in made:
        schema = schema.add(name, kinds[name])

    held = documents.sparkSession.sparkContext.broadcast(library_text(path, pattern))  # as large as the vocabulary
    key = f"bpe {path} {pattern}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept(key, lambda: ByteBpe(held.value))
        for batch in batches:
            for start, texts in runs(batch.column(len(keep))):
                found = coder.encode(texts)
                columns: dict[str, pa.Array] = {
                    "n_tokens": pa.array([len(x) // 4 for x in found], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in found], pa.string()),
                }
                if ids:
                    ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
                    columns["token_ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
                if spans:
                    columns["token_spans"] = pa.array([[0, *np.cumsum(coder.lengths[np.frombuffer(x, "<u4")]).tolist()] for x in found], pa.list_(pa.int32()))
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *columns.values()], [*keep, *columns])
        coder.memory.known = {}  # the worker may wait beside other stages

    return chosen.mapInArrow(then_give_back(encode), schema)
