"""The corpus pipeline: each stage works on all rows that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vitalgauge.llm import exact_dedup, language, minhash, packing, toxicity
from vitalgauge.llm.common import fresh, kept, prepare, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the factorization machine scores 0.5 or more."""
    prepare(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the network, learned from all labelled rows but the held-out
    fifth, finds likelier of no language than nearly all of that fifth, and those without a letter."""
    prepare(spark)
    net = language.train_whole(docs)
    return language.keep_known(docs, net, language.limit(docs, net))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for the case of A-Z, the one with the largest doc_id."""
    prepare(spark)
    return exact_dedup.kept_rows(docs, exact_dedup.DigestIndex(spark, fresh(spark, "digest-index")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near likeness (five words, 0.8), the one with the smallest doc_id.
    A row without a doc_id stays."""
    prepare(spark)
    gone = minhash.near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in sequences of 1024."""
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("packing", pack),
]

#: The learned stages and the packing are no SQL; tests hold the pipeline against its parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
