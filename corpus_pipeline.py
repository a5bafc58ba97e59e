"""A training-data pipeline over ``documents``, a stage for each of five operators.

``run`` writes each stage's documents as Parquet in the shared folder and reads
them back for the next; what a stage wrote on the way, and the documents that it
was given, then go.  All stages but the last return the columns of documents,
whatever further columns these have; a stage that is given an empty table returns
an empty one.  Nulls, ties and repeated rows: see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm import langid, mixing, sentencepiece_codec, simhash, suffix_dedup
from lattiq.llm.common import Workspace, modest_batches, open_spaces, sweep, table
from lattiq.llm.queries import tokenizer_file


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told.

    A text that is null, empty or without a letter goes; null lang, source and
    doc_id do not matter; repeated rows share their fate.
    """
    modest_batches(spark)
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near copies.

    Null texts and texts without a word are copies of one another; rows with a
    null doc_id stay; of rows with one doc_id one stays, chosen by digests.
    """
    modest_batches(spark)
    return simhash.keep_representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document, or the document itself earlier, has already.

    Documents of which nothing is left go; null and empty texts stay as they are;
    a null doc_id comes before all others; rows equal in doc_id and text are one.
    """
    modest_batches(spark)
    return suffix_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents to meet the sources' targets, in training order.

    Documents without a word go; a null source is a source like any other, the
    last; copies at one position are in order of doc_id, null first.
    """
    return mixing.training_order(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids and n_tokens of each document of the mix; null and empty texts have no ids."""
    modest_batches(spark)
    out = sentencepiece_codec.encode(docs, tokenizer_file("piece_bpe_32k.model"), ["doc_id", "source", "lang"])
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("mixture", mix_sources),
    ("pieces", encode_pieces),
]
#: Naive Bayes, SimHash and merges are not expressible in SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, space, given = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        before = open_spaces()
        docs = space.write(stage(spark, docs, sf_dir), name)
        sweep(before)
        if given:
            space.drop(given)
        given = name
    return STAGES[-1][1](spark, docs, sf_dir)
