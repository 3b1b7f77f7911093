"""The registered queries of this subpackage: thin forms of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import langid, mixing, warc
from marginalia.llm.ann import nearest_neighbours
from marginalia.llm.avi import media_round_trip
from marginalia.llm.bpe import encode_documents
from marginalia.llm.dedup import near_duplicates
from marginalia.llm.html_text import extract_main_text, fit_weights
from marginalia.llm.sharding import shard_documents
from marginalia.llm.token_counts import token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op2_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op4_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op5_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_round_trip(_table(spark, sf_dir, "documents"))


def op6_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_captures(_table(spark, sf_dir, "pages"))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return extract_main_text(pages, fit_weights(pages))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = _vocabulary("byte_bpe_50k.tiktoken")
    return encode_documents(_table(spark, sf_dir, "documents"), path=path, pattern=pattern, keep=["doc_id"], ids=False)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(langid.learned(documents))
    found = langid.identify(documents.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), path=_vocabulary("byte_bpe_50k.json")[0])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_inverted_multi_index": op2_inverted_multi_index,
    "op3_source_mix": op3_source_mix,
    "op4_balanced_shards": op4_balanced_shards,
    "op5_avi_media": op5_avi_media,
    "op6_warc_captures": op6_warc_captures,
    "op7_html_main_text": op7_html_main_text,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_language_id": op9_language_id,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op3_source_mix": mixing.ORACLE_SQL,
    "op6_warc_captures": warc.ORACLE_SQL,
}
