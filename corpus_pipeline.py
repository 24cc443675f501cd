"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again for the next.

Language identification and toxicity drop the documents they reject, the two
duplicate stages leave one document of each group, and the last stage packs what
is left into sequences. The first four return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from assetloom.llm import exact_dedup, jaccard, language, packing, toxicity
from assetloom.llm.common import table
from assetloom.llm.queries import END_ID, SEQUENCE_TOKENS, language_model, toxicity_model
from assetloom.session import cut

#: A document goes if its main language has a smaller share, or if its chance of being toxic is at least this.
LEAST_SHARE = 0.5
TOXIC = 0.5
#: Near duplicates: words of an n-gram and Jaccard similarity in percent.
NGRAM_WORDS = 5
SIMILAR = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a known main language. The model learns from the labelled documents that are not held out."""
    return language.keep_identified(docs, language_model(docs), LEAST_SHARE)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the toxicity model, fitted to the labels that are not held out, calls clean."""
    return toxicity.keep_clean(docs, toxicity_model(docs, table(spark, sf_dir, "labels")), TOXIC)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts stays, the one with the smallest id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates stays, the one with the smallest id; rows of one id stay or go together."""
    found = jaccard.near_duplicates(docs, NGRAM_WORDS, SIMILAR).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = found.select(F.col("doc_id").alias("stays")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["stays"]), "left_semi")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.token_pieces(docs, path, SEQUENCE_TOKENS, END_ID), SEQUENCE_TOKENS)


STAGES = [
    ("language_id", language_id),
    ("toxicity", clean),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("packing", packed),
]
#: Language mixtures, the random field and tokens have no form in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
