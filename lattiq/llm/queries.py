"""Queries and SQL of the training-data operators, one opN_<name> for each."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import embed_dedup, langid, media, mixing, quality, sentencepiece_codec, sharding, simhash, suffix_dedup, token_store
from .common import modest_batches, table


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file; the folder is a parameter."""
    folder = os.environ.get("LATTIQ_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(operator, tokenizer: str | None = None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        modest_batches(spark)
        return operator(table(spark, sf_dir, "documents"), *([tokenizer_file(tokenizer)] if tokenizer else []))

    return query


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return quality.quality_of_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return embed_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {
        "op1_language_id": _documents(langid.language_of_documents),
        "op2_sharding": _documents(sharding.shards_of_documents),
        "op3_suffix_dedup": _documents(suffix_dedup.deduplicated_documents),
        "op4_quality": _quality,
        "op5_simhash": _documents(simhash.components_of_documents),
        "op6_token_store": _documents(token_store.tokens_of_documents, "word_bpe_49k.json"),
        "op7_mixing": _documents(mixing.mixture_of_documents),
        "op8_media": _documents(media.media_of_documents),
        "op9_embedding_dedup": _embeddings,
        "op10_sentencepiece": _documents(sentencepiece_codec.pieces_of_documents, "piece_bpe_32k.model"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": mixing.ORACLE, "op9_embedding_dedup": embed_dedup.ORACLE}
