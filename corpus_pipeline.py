"""Corpus pipeline over documents: five stages, each on all rows that its predecessor kept, written as Parquet in between."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbrafold.llm.common import fresh, staged, table
from umbrafold.llm.decontaminate import clean_documents
from umbrafold.llm.ordinal import keep_harmless, train_from_labels
from umbrafold.llm.packing import pack_documents
from umbrafold.llm.secrets import redacted
from umbrafold.llm.sketch_join import jaccard_components


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones among them, takes for toxic go."""
    return keep_harmless(docs, train_from_labels(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked or equal sets the document of the smallest doc_id stays; documents without words and rows with a null doc_id stay."""
    name = fresh(docs, "other_id")
    others = jaccard_components(docs, count_links=False).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(others, F.col("doc_id") == F.col(name), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; every document stays."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their places in the sequences."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: The first stage fits a model, which SQL does not express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
