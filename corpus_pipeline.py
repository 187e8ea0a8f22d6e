"""A training corpus from raw documents, stage by stage; each stage works on the table that the one before it wrote.

Null, empty and very long texts, repeated rows, empty tables and extra columns have at each stage the result that its
operator's docstring states.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwake.llm import byte_bpe, jaccard_join, mixing, pii, quality_classifier
from ledgerwake.llm.common import table, written

BPE_FILE = "byte_bpe_50k.tiktoken"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that more likely than not have the highest grade, learned from the ratings in labels."""
    ratings = table(spark, sf_dir, "labels").select("doc_id", quality_classifier.grade_column().alias("grade"))
    return quality_classifier.select_good(docs, ratings)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8."""
    return jaccard_join.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, with the kind's name in place of personal data."""
    return pii.redact(docs)


def evenly_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated until their sources have about as many characters each, in a new order."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and digests of the ids and of the text decoded from them."""
    digests = byte_bpe.round_trip(spark, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN, with_ids=True)
    return docs.select("doc_id", "lang", "source", digests(F.col("text")).alias("t")).select("doc_id", "lang", "source", "t.*")


STAGES = [
    ("quality_classifier", good_documents),
    ("jaccard_join", without_near_duplicates),
    ("pii", without_personal_data),
    ("mixing", evenly_mixed),
    ("byte_bpe", encoded),
]

#: SQL can express neither the classifier nor the encoding: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
