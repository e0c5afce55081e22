"""The corpus pipeline: quality classifier, near-dedup, decontamination, secret scan, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annulus.llm import decontam, packing, quality, secrets, simhash
from annulus.llm.common import durable, read_table
from annulus.llm.queries import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-level classifier doesn't reject. It is fitted on the whole ``documents`` table's labelled rows."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"), fit_on=read_table(spark, sf_dir, "documents"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked unless they are widely copied examples; n_chars follows the text."""
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", good_quality), ("near_dedup", one_of_each), ("decontamination", without_benchmark), ("secrets", without_secrets), ("packing", packed)]

#: no SQL: hashing majorities, a trained classifier and a tokenizer; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another on ``documents``; each stage's rows are kept in the shared checkpoint folder."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
