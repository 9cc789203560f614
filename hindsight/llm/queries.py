"""The operators as queries over the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindsight.llm.bpe import round_trips
from hindsight.llm.divergence import source_divergence
from hindsight.llm.jaccard import similar_documents
from hindsight.llm.language import identify
from hindsight.llm.negatives import hard_negatives
from hindsight.llm.neighbours import nearest
from hindsight.llm.packing import pack
from hindsight.llm.pseudonyms import pseudonyms
from hindsight.llm.quality import quality_rules
from hindsight.llm.shared import table
from hindsight.llm.suffix import repeated_strings
from hindsight.llm.toolcalls import conversation_calls
from hindsight.llm.warc import archived_pages
from hindsight.llm.wordlm import cross_entropy_difference

#: Whoever runs this on real texts passes a secret; this one makes results comparable.
PSEUDONYM_KEY = "key of the test tables"


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Measures and verdicts of all documents."""
    return quality_rules(table(spark, sf, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of all documents without strings of 50 bytes that earlier ones have."""
    return repeated_strings(table(spark, sf, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of all vectors, for each hundredth of them."""
    return nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Language of all documents, learned from three fourths of them."""
    return identify(table(spark, sf, "documents"))


def op5_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, scored for being like those that are labelled good."""
    good = table(spark, sf, "labels").where("quality = 1")
    return cross_entropy_difference(table(spark, sf, "documents"), good)


def op6_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Components of all documents linked by their 5-word shingles."""
    return similar_documents(table(spark, sf, "documents"))


def op7_feistel_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with pseudonyms for personal numbers, dates and addresses."""
    return pseudonyms(table(spark, sf, "documents"), PSEUDONYM_KEY)


def op8_tool_call_linking(spark: SparkSession, sf: str) -> DataFrame:
    """User turns of conversations as calls, assistant turns as results; other turns, or without a role, give no row."""
    return conversation_calls(table(spark, sf, "conversations"))


def op9_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_byte_level_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of all documents and what they decode to, as digests."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trips(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN)


def op11_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    """How far the sources of all documents are from each other, and by which terms."""
    return source_divergence(table(spark, sf, "documents"))


def op12_warc(spark: SparkSession, sf: str) -> DataFrame:
    """All pages, written to archives and read back."""
    return archived_pages(table(spark, sf, "pages"))


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of each hundredth vector; every seventh has the label after its own."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_language_id": op4_language_id,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_feistel_pseudonyms": op7_feistel_pseudonyms,
    "op8_tool_call_linking": op8_tool_call_linking,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_byte_level_bpe": op10_byte_level_bpe,
    "op11_source_divergence": op11_source_divergence,
    "op12_warc": op12_warc,
    "op13_hard_negatives": op13_hard_negatives,
}
