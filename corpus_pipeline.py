"""A corpus cleaned and packed in five stages, each written as Parquet and read again.

Language ID drops documents without a language, quality rules those that the
counts or the perplexity bands reject, the n-gram join all but one of each group
of near duplicates, decontamination those that leak a benchmark item; what is
left is packed into sequences.  An empty table passes through every stage.  Rows
with a null or repeated doc_id are rows like any other; only the n-gram join
goes by doc_id: there a row without one stays, and so do all rows of the least
doc_id of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontam, langid, ngram_join, packing, quality
from tallyloom.llm.queries import remainder
from tallyloom.llm.store import small_batches, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters; a null lang is filled by the prediction."""
    small_batches(spark)
    found = langid.identify(docs, usable=remainder(4) != 2, keep=COLUMNS)
    return found.where("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counts and their language's perplexity bands."""
    small_batches(spark)
    return quality.judge(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group that shares 80 % of 5-word shingles."""
    small_batches(spark)
    return ngram_join.one_of_each(docs, size=5, percent=80).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a stretch within 20 % word edits of a benchmark item; each row by its own text, whatever its doc_id."""
    small_batches(spark)
    return decontam.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 4096 tokens; a row with its ids for each piece of a document."""
    small_batches(spark)
    return packing.pack(docs, name="word_bpe_49k.json", size=4096, end=1)


STAGES = [
    ("language", language),
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Models, walks and packing are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
