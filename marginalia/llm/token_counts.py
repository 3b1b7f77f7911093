"""Token counts by the tokenizers library, over Arrow batches; only lengths leave the worker.

The library sees each distinct safe piece of the texts once (``pieces``), in calls balanced by bytes, so that neither a
very long text nor a batch of long texts grows a call. Lengths of pieces add up to the length of the text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.cluster import ship, then_give_back
from marginalia.llm.pieces import Lengths, opening, runs
from marginalia.llm.worker import kept

def _counter(path: str) -> Lengths:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return Lengths(library, opening(library))


def token_counts(documents: DataFrame, *, path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row, from the whole text.

    ``path`` is a byte-level tokenizer.json; strings of its special tokens inside texts count as the library's default
    has it (one token). A null text counts as empty: 0 bytes, 0 tokens. Ids are passed on as they are, null or
    repeated; an empty table gives an empty result; other columns play no part. Long texts are split at safe boundaries
    (``pieces``), and counts of the parts add up.
    """
    ship(documents.sparkSession)
    chosen = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = kept(f"lengths {path}", lambda: _counter(path))
        for batch in batches:
            for start, texts in runs(batch.column(1)):
                counts = [sum(parts) for parts in memory.of(texts)]
                sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        memory.known = {}  # the worker may wait beside other stages

    return chosen.mapInArrow(then_give_back(count), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
