"""The corpus pipeline: language, quality, near-duplicates, mix and packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.  All
but the last return the columns of ``docs``.  A stage's input is a table that is read from
Parquet, so every stage can be rerun.

Defined results: a null or empty text has no language, so the first stage drops it; later
stages take it as an empty text.  Rows with equal ids are documents of their own, of equal rows
the near-duplicate stage keeps one.  A null id counts as the empty text where ids are hashed,
and comes first where the smallest id is kept.  Extra columns stay beside the others whatever
their names, ties end in a key, and an empty table gives an empty one at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import language_id, mixing, ngram_join, packing, quality_rules
from postloom.llm.common import free_name, id_remainder, settle, table

#: Least agreement with the best profile; texts of learnt languages have 0.4 and more.
LANGUAGE_SCORE = 0.25
QUALITY_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable language."""
    training = table(spark, sf_dir, "documents").where(id_remainder("doc_id", 3) != 1)
    profiles = language_id.learn_profiles(training)
    found = free_name(docs, "predicted")
    kept = docs.withColumn(found, language_id.predicted(F.col("text"), profiles))
    return kept.where((F.col(f"{found}.lang") != language_id.UNKNOWN) & (F.col(f"{found}.score") >= LANGUAGE_SCORE)).select(*docs.columns)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or that the trees find poor."""
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    found = free_name(docs, "verdict")
    return docs.withColumn(found, quality_rules.verdict(F.col("text"), model, QUALITY_SCORE)).where(F.col(found)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates, that with the smallest id."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, cut where it takes a part."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of all documents in sequences of up to 4096, as pieces; an empty text is its end id alone."""
    return packing.pack_documents(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", filter_quality),
    ("ngram_join", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models and tokenizers cannot be said in SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
