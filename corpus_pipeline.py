"""From raw documents to packed training sequences: the operators as stages, in order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet
and reads it for the next one.  All but the last return the columns of documents: rows that a
stage rejects go, texts that it changes are changed, and n_chars follows them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindsight.llm.jaccard import one_of_each
from hindsight.llm.packing import pack
from hindsight.llm.pseudonyms import with_pseudonyms
from hindsight.llm.quality import quality_filter
from hindsight.llm.queries import PSEUDONYM_KEY
from hindsight.llm.shared import shared_folder, ship
from hindsight.llm.suffix import without_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules of documents and of hosts keep."""
    ship(spark)
    return quality_filter(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by shared shingles."""
    ship(spark)
    return one_of_each(docs.select(*COLUMNS))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 50 bytes that documents of smaller doc_id have."""
    ship(spark)
    return without_repeats(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal numbers, dates and addresses."""
    ship(spark)
    out = with_pseudonyms(docs.select(*COLUMNS), PSEUDONYM_KEY)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' tokens in sequences of 2048; a row for each piece of a document."""
    ship(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("personal_data", personal_data),
    ("sequences", sequences),
]

#: Suffix arrays, keyed permutations and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
