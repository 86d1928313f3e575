"""A training corpus from `documents`, in stages: each gets what its predecessor kept, written as Parquet and read again.

Defined results of all stages: an empty table gives an empty one; further columns stay as they are, whatever their names, up
to the last stage; texts count whole, however long; rows with a null identifier are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import bpe, exact_dedup, minhash_dedup, mixing, toxicity
from lakeloom.llm.common import materialize, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the labels teach, as far as they mark documents of this stage.

    Null and empty texts are scored by their features, all zero; rows that repeat are scored alike; a score of 0.5 goes; without
    labels of both kinds every document's score is the share of label 1.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts, the one with the largest doc_id.

    A null text counts as empty; null identifiers sort below all others; of rows that repeat identifier and text one stays.
    """
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near copies, the one with the smallest doc_id.

    Null, empty and white-space texts link with nothing and stay, as do rows with a null identifier; rows that share an
    identifier are documents of their own, of which unlike ones stay and of like ones the same one on each run.
    """
    return minhash_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources reach their target weights, in a global random order.

    Null sources are one source; null texts have no characters; rows that repeat an identifier are repeated alike.
    """
    return mixing.mixed_corpus(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests that a reader can check.

    A null text counts as empty, and has no tokens; rows that repeat are encoded alike.
    """
    return bpe.tokenize(docs)


STAGES = [(name, small_batches(stage)) for name, stage in [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("MinHash near-dedup", drop_near_copies), ("mixing sources to target weights", mix_sources), ("BPE encoding and decoding", tokenize)]]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = materialize(docs, name.split()[0])
    return docs


#: SQL can't express the trained first stage; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None
