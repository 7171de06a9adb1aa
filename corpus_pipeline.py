"""The corpus pipeline: documents through five operators of ``hopline.llm``, stage by stage.

Each stage gets what the one before kept, written and read again; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hopline.llm import bpe, credentials, mixing, simhash, toxicity
from hopline.llm.common import table
from hopline.llm.queries import TOKENIZER
from hopline.session import cut_lineage

#: Neither the machine of the first stage nor the encoding can be written in SQL: the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the machine learns from the labelled rows of ``docs`` that are not held out."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: 4-word shingles, 4 differing bits at most."""
    return simhash.keep_one(docs, shingle=4, radius=4)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported span gives way to its kind in angle brackets."""
    return credentials.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources' blocks at their target weights, as documents: one row for each copy of a document that the mix takes."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text: doc_id, lang, source, n_tokens and the ids as little-endian unsigned 32-bit integers, decoded again and compared."""
    return bpe.encoded(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
