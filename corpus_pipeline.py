"""Corpus pipeline: documents without toxic ones, near duplicates and repeated passages, mixed by source and tokenized.

Every stage takes (spark, docs, sf_dir) and all that the stage before it kept; run() writes each stage's rows to the shared
folder and reads them again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.llm.bpe import encode
from cairn.llm.common import stored, table
from cairn.llm.mixing import mixed_texts
from cairn.llm.repeats import without_repeated_bytes
from cairn.llm.simhash import without_near_duplicates
from cairn.llm.toxicity import untoxic

TOXIC = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; labels of the held-out fold aren't learned from."""
    return untoxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more."""
    return without_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that start anywhere else too; every document stays."""
    return without_repeated_bytes(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; those that it takes nothing of go."""
    return mixed_texts(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids)."""
    return encode(docs, decoded=False).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", toxicity), ("simhash_near_duplicates", near_duplicates), ("suffix_array_dedup", repeated_passages), ("mixing", mixing), ("bpe", encoding)]

#: The models, the sampled tables and the tokenizer can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
