"""A training corpus from ``documents`` in four stages.

Each stage reads what the stage before it wrote (Parquet below the shared folder) and works on all of it:

1. ``language_id``: PPM language identification; texts without a language (null, empty, no letter, in none of those
   learned) go.
2. ``near_dedup``: MinHash near-duplicates on five-word shingles at a similarity of 0.8; one document of each group stays.
3. ``mix``: sources are mixed to target weights; shards draw blocks of the documents, and rows follow shard by shard.
4. ``encode``: byte-level BPE; each row gets its token ids, their number and digests.

All but the last return the columns of ``documents``. Null ids and null sources are kept; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.cluster import Scratch
from marginalia.llm import langid
from marginalia.llm.bpe import encode_documents
from marginalia.llm.dedup import without_near_duplicates
from marginalia.llm.mixing import mixed_documents
from marginalia.llm.worker import short_batches


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be determined: without a letter, or coded with more than eight bits a byte
    under every language, which is worse than without any statistics. The model is learned from the stage's own labelled
    rows; where there are none, only the letter counts."""
    short_batches(spark)
    return langid.determined(docs, langid.fit(langid.learned(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: the one with the smallest id, null last."""
    short_batches(spark)
    return without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their target weights."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256 and token_ids of each row."""
    import public_tokenizers

    short_batches(spark)
    return encode_documents(docs, path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"], ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("encode", encode),
]

#: The length of a PPM code and the confirmed near-duplicates have no SQL form; tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = scratch.table(docs, name)
            if number:
                scratch.drop(STAGES[number - 1][0])
    return docs
