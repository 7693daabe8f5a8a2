"""A corpus, cleaned and tokenised: quality rules, quality classifier, SimHash near-dedup, mixing, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linesieve.llm import bpe_chunks, mixing, quality_classifier, quality_rules, simhash
from linesieve.llm.common import materialise
from linesieve.llm.queries import table, tokenizer


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.filter_documents(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labels of what is left."""
    return quality_classifier.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, as digests of the ids and of what they decode to."""
    return bpe_chunks.round_trip(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("SimHash near-dedup", near_dedup), ("mixing sources", mix), ("BPE encoding", encode)]

#: The stages hold EM, a classifier and a tokenizer, which SQL cannot express; tests/llm/test_pipeline.py has a plain version of each.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.split()[-1])
    return STAGES[-1][1](spark, docs, sf_dir)
