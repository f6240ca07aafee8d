"""A pipeline of the operators for training data, from documents to token shards.

Every stage takes ``(spark, docs, sf_dir)`` and returns a frame that is written as
Parquet and read back as the next one's ``docs``. All but the last return documents with
the columns they came with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from airq.llm.decontam import decontaminated
from airq.llm.mixing import mixed
from airq.llm.quality import accepted
from airq.llm.queries import DOMAIN_WEIGHTS, tokenizer_path
from airq.llm.shared import documents, written
from airq.llm.simhash import simhash_dedup
from airq.llm.tokens import read_tokens, write_tokens


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return accepted(docs, documents(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints are linked, see ``simhash``."""
    return simhash_dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminated(docs, documents(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that languages have their target weights."""
    return mixed(docs, documents(spark, sf_dir, "labels"), DOMAIN_WEIGHTS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards on disk; one row per document, as read back from them."""
    return read_tokens(write_tokens(docs, tokenizer_path()))


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing to target weights", mix),
    ("token shards", to_tokens),
]

#: SQL can express none of these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read back."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
