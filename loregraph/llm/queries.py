"""The corpus operators over the test tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loregraph.llm.chat import collapse_snapshots
from loregraph.llm.common import fold, table
from loregraph.llm.decontaminate import find_leaks
from loregraph.llm.exact import exact_dedup
from loregraph.llm.hmm import score_texts
from loregraph.llm.jaccard import jaccard_join
from loregraph.llm.oracle import ORACLE
from loregraph.llm.packing import pack
from loregraph.llm.pii import find_pii, pii_digest
from loregraph.llm.quality import classify
from loregraph.llm.repair import damaged, repair_conversations
from loregraph.llm.repeats import remove_repeats
from loregraph.llm.rules import quality_rules
from loregraph.llm.token_count import count_tokens
from loregraph.llm.trie import conversation_trie


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_snapshots(table(spark, sf_dir, "conversations"))


def op4_hmm_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find_pii(table(spark, sf_dir, "documents")))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The half of the rows whose ids have an even crc32 is the history, the other half arrives."""
    docs = table(spark, sf_dir, "documents")
    return exact_dedup(docs, fold(docs["doc_id"], 2) == 0).drop("seen")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair_conversations(damaged(conversations), conversations)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_packing": op2_packing,
    "op3_chat_format": op3_chat_format,
    "op4_hmm_language_model": op4_hmm_language_model,
    "op5_token_counts": op5_token_counts,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_quality_rules": op8_quality_rules,
    "op9_pii": op9_pii,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_conversation_trie": op13_conversation_trie,
}

__all__ = ["ORACLE", "QUERIES"]
