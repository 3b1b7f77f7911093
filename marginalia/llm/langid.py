"""Language identification by prediction by partial matching (PPM).

For each language a context tree over all 256 bytes is learned: how often each byte followed each context of up to
three bytes. Escape method C: in a context seen ``n`` times with ``t`` different successors, a successor seen ``c``
times costs -log2(c / (n + t)) bits, and the escape to the next shorter context costs -log2(t / (n + t)); a context
that was never seen escapes for nothing, and below the empty context every byte costs eight bits. The statistics are
frozen, so a text's code length is a sum over its positions.

The trees are sparse: for each length of context, sorted numbers of the byte strings that occurred, with their costs.
They grow with what a language's sample holds, not with the alphabet. A run of texts is scored through its distinct
strings of four bytes: each is priced once for a language, and the prices are summed over the positions of each text.

A-Z count as a-z. The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.cluster import ship, then_give_back
from marginalia.llm.worker import kept

#: Bytes before the one that is predicted.
ORDER = 3
#: The bound of the labelled sample: rows for each language.
ROWS_PER_LANGUAGE = 1500
UNDETERMINED = "und"
#: Bits of a byte that no statistics tell anything about.
RAW_BITS = 8.0
#: Stands before a text; UTF-8 has no such byte.
_HEAD = b"\xff" * ORDER
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_COUNTED = "lang string, gram long, n long"
#: Bytes of texts that are counted or priced at once.
_RUN = 1 << 20


def _strings(data: np.ndarray) -> np.ndarray:
    """For each position after the first three: it and the three bytes before it, as one number."""
    s = data.astype(np.uint32)
    return s[:-3] << 24 | s[1:-2] << 16 | s[2:-1] << 8 | s[3:]


def _summed(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys, numbers = keys[order], numbers[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(numbers, first) if len(first) else numbers


class Tree:
    """The frozen context tree of a language: sorted strings and their costs, for contexts of 3, 2, 1 and no bytes."""

    def __init__(self, grams: np.ndarray, numbers: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        keys, counts = _summed(grams.astype(np.uint32), numbers.astype(np.float64))
        for order in range(ORDER, -1, -1):
            if order < ORDER:
                keys, counts = _summed(keys & np.uint32((1 << 8 * (order + 1)) - 1), counts)
            contexts, place = np.unique(keys >> np.uint32(8), return_inverse=True)
            n, t = np.bincount(place, weights=counts, minlength=len(contexts)), np.bincount(place, minlength=len(contexts))
            self.levels.append((keys, -np.log2(counts / (n + t)[place]), contexts, -np.log2(t / (n + t))))

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each string after the three before it."""
        out, left = np.zeros(len(grams)), np.arange(len(grams))
        for level, (keys, known, contexts, escapes) in enumerate(self.levels):
            own = grams[left] & np.uint32((1 << 8 * (ORDER + 1 - level)) - 1)
            at, found = _find(keys, own)
            out[left[found]] += known[at[found]]
            left, own = left[~found], own[~found] >> np.uint32(8)
            at, seen = _find(contexts, own)
            out[left[seen]] += escapes[at[seen]]
        out[left] += RAW_BITS
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Model:
    """The counted strings of four bytes of each language; ``trees`` lays them out."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages, self.counts = sorted(counts), counts

    def trees(self) -> list[Tree]:
        return [Tree(*self.counts[language]) for language in self.languages]


def fit(labelled: DataFrame, *, text_column: str = "text", label_column: str = "lang", key_column: str = "doc_id", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn from at most ``rows_per_language`` rows of each non-null language, chosen by a hash of key and text.

    Rows with null or empty text are not chosen; those chosen are read whole. The model holds the distinct strings of
    four bytes of that sample; without a labelled row it has no languages.
    """
    spark = labelled.sparkSession
    ship(spark)
    text, lang = F.col(text_column).cast("string"), F.col(label_column).cast("string")
    usable = labelled.select(lang.alias("lang"), text.alias("text"), F.xxhash64(F.col(key_column), text).alias("h")).filter("lang IS NOT NULL AND length(text) > 0")
    # a little more than is needed by the hash alone, so that no text is moved for nothing
    sizes = usable.groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))
    share = F.least(F.lit(1.0), F.lit(rows_per_language + 5 * rows_per_language**0.5) / F.col("_n"))
    some = usable.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, F.col("lang") == F.col("_lang")).filter(F.shiftrightunsigned("h", 4) <= share * 2.0**60)
    first = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 4), "text")
    sample = some.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= rows_per_language).select("lang", "text").repartition(spark.sparkContext.defaultParallelism)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for language, parts in held.items():
                values, numbers = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(numbers.astype(np.int64))], ["lang", "gram", "n"])

        held, size = {}, 0
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                data = text.as_py()
                for start in range(0, len(data), _RUN):  # a long text in parts that overlap by a context
                    part = data[start - ORDER : start + _RUN] if start else _HEAD + data[:_RUN]
                    held.setdefault(language, []).append(_strings(_FOLD[np.frombuffer(part, np.uint8)]))
                    size += len(part)
                    if size >= 4 * _RUN:
                        yield from told(held)
                        held, size = {}, 0
        yield from told(held)

    # No more numbers than the sample has bytes.
    table = sample.mapInArrow(then_give_back(count), _COUNTED).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = table.column("lang").combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    code, grams, numbers = np.asarray(names.indices), table.column("gram").to_numpy().astype(np.uint32), table.column("n").to_numpy()
    return Model({str(name): (grams[code == i], numbers[code == i]) for i, name in enumerate(names.dictionary.to_pylist())})


def _runs(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text) + ORDER
        if size >= _RUN or i == len(texts) - 1:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0


def _long_text(text: bytes, trees: list[Tree]) -> np.ndarray:
    """Bits of one text of any length, in parts that overlap by a context."""
    total = np.zeros(len(trees))
    for start in range(0, len(text), _RUN):
        part = text[start - ORDER : start + _RUN] if start else _HEAD + text[:_RUN]
        values, numbers = np.unique(_strings(_FOLD[np.frombuffer(part, np.uint8)]), return_counts=True)
        total += [tree.costs(values) @ numbers for tree in trees]
    return total


def code_lengths(texts: list[bytes], trees: list[Tree]) -> np.ndarray:
    """Bits of each text (rows) under each language (columns)."""
    out = np.zeros((len(texts), len(trees)))
    for start, run in _runs(texts):
        if len(run) == 1 and len(run[0]) > _RUN:
            out[start] = _long_text(run[0], trees)
            continue
        used = np.array([i for i, text in enumerate(run) if text], np.int64)
        if not len(used):
            continue
        grams = _strings(_FOLD[np.frombuffer(b"".join(_HEAD + run[i] for i in used), np.uint8)])
        sizes = np.array([len(run[i]) for i in used])
        ends = np.cumsum(sizes + ORDER)[:-1]
        inside = np.ones(len(grams), bool)
        for shift in range(ORDER):  # grams[i] ends at i + 3; those that end inside the head of a later text belong to none
            inside[ends + shift - ORDER] = False
        kinds = pa.array(grams[inside]).dictionary_encode()
        values, where = kinds.dictionary.to_numpy(), kinds.indices.to_numpy()
        firsts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        for k, tree in enumerate(trees):
            out[start + used, k] = np.add.reduceat(tree.costs(values)[where], firsts)
    return out


def has_letter(text: str | None) -> bool:
    """Whether a text holds a letter: a character of one of the Unicode categories L."""
    return bool(text) and any(map(str.isalpha, text))


def _judged(batch: pa.RecordBatch, column: int, trees: list[Tree]) -> Iterator[tuple[int, list[str | None], list[int], np.ndarray, np.ndarray]]:
    """For slices of a batch: start, texts, the places of texts with letters, their code lengths, and their bytes."""
    for start in range(0, batch.num_rows, 500):
        texts = batch.column(column).slice(start, 500).to_pylist()
        rows = [i for i, t in enumerate(texts) if has_letter(t)]
        coded = [texts[i].encode() for i in rows]
        yield start, texts, rows, code_lengths(coded, trees) if trees else np.zeros((len(rows), 0)), np.array([len(c) for c in coded], np.int64)


def identify(documents: DataFrame, model: Model, *, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all), then lang_pred and score, which replace columns of these names.

    ``score`` is the probability of the chosen language if all are equally likely before: 2**-bits over the sum.
    A null text, one without a letter (Unicode categories L), and any text if nothing was learned are ``und`` with
    score 0. Between equal code lengths the first language by code point wins. Texts are read whole, however long, in
    parts of a megabyte. Repeated rows get equal results; an empty table stays empty.
    """
    spark = documents.sparkSession
    ship(spark)
    keep = [c for c in (documents.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    held, key = _spread(documents, model)
    chosen = documents.select(*(F.col(f"`{c}`") for c in keep), F.col(text_column).cast("string").alias("__text"))
    schema = chosen.drop("__text").schema.add("lang_pred", "string").add("score", "double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        trees = kept(key, known.trees)
        for batch in batches:
            for start, texts, rows, bits, _ in _judged(batch, len(keep), trees):
                langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                for i, b, own in zip(rows, bits.argmin(1), bits, strict=True) if trees else ():
                    langs[i] = known.languages[b]
                    scores[i] = float(1 / np.exp2(np.maximum(own[b] - own, -1000)).sum())
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return chosen.mapInArrow(then_give_back(predict), schema)


def determined(documents: DataFrame, model: Model, *, text_column: str = "text", most_bits: float = RAW_BITS) -> DataFrame:
    """The rows of ``documents``, all columns as they are, whose text is in a language of the model.

    A text must hold a letter, and under its best language a byte must cost at most ``most_bits`` bits on average: above
    eight, the statistics of every language tell less than none at all. With nothing learned only the letter counts.
    """
    spark = documents.sparkSession
    ship(spark)
    held, key = _spread(documents, model)
    column = documents.columns.index(text_column)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = kept(key, lambda: held.value.trees())
        for batch in batches:
            for start, texts, rows, bits, sizes in _judged(batch, column, trees):
                good = np.zeros(len(texts), bool)
                good[rows] = bits.min(1) <= most_bits * sizes if trees and len(rows) else True
                yield batch.slice(start, len(texts)).filter(pa.array(good))

    return documents.mapInArrow(then_give_back(choose), documents.schema)


def _spread(documents: DataFrame, model: Model):
    """The model as a broadcast (it is no larger than the bounded sample), and a key for its trees in a worker."""
    context = documents.sparkSession.sparkContext
    held = context.broadcast(model)
    return held, f"ppm-{context.applicationId}-{getattr(held, '_jbroadcast').id()}"


def held_out(key: Column) -> Column:
    """Whether crc32 of the key's text is 1 modulo 3; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learned(documents: DataFrame, *, id_column: str = "doc_id") -> DataFrame:
    """The rows that may be learned from: those not held out."""
    return documents.filter(~held_out(F.col(id_column)))
