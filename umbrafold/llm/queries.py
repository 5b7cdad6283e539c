"""The registered queries of this subpackage. None has DuckDB SQL: tests hold them against brute force."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from umbrafold.llm.alignment import aligned_texts, link_report
from umbrafold.llm.chat import format_conversations, read_back
from umbrafold.llm.common import table
from umbrafold.llm.decontaminate import contained_items
from umbrafold.llm.edit_embedding import fingerprints, near_classes, own_fingerprints
from umbrafold.llm.hmm import language_model_scores
from umbrafold.llm.ordinal import score_severity, train_from_labels
from umbrafold.llm.packing import pack_documents
from umbrafold.llm.pii import digest, personal_spans
from umbrafold.llm.prefix_trie import prefix_trie, regrouped
from umbrafold.llm.record_files import record_round_trip
from umbrafold.llm.secrets import report, secret_spans
from umbrafold.llm.site_style_tree import main_texts
from umbrafold.llm.sketch_join import jaccard_components

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(personal_spans(table(spark, sf_dir, "documents")))


def op2_prefix_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return read_back(format_conversations(rows))


def op3_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(secret_spans(table(spark, sf_dir, "documents")))


def op4_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fingerprints(docs, classes=near_classes(own_fingerprints(docs)))


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, lasting=True)


def op7_contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))


def op9_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_severity(docs, train_from_labels(docs, labels))


def op10_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*regrouped(table(spark, sf_dir, "conversations")))


def op12_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_round_trip(table(spark, sf_dir, "documents"), BYTE_LEVEL)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_report(aligned_texts(table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_weak_labels, op2_prefix_rendering, op3_linked_secrets, op4_sketch_join, op5_edit_embedding, op6_best_fit, op7_contained_items, op8_hidden_markov, op9_severity, op10_site_style_tree, op11_prefix_trie, op12_record_files, op13_token_alignment)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
