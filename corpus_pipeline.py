"""A training corpus from the documents table: quality rules, line dedup, near duplicates, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as
Parquet in the shared folder and read again as the next stage's documents. All stages but the last return the
columns of documents.

Defined results, in all stages: a null or empty text has no words and goes with the quality rules; rows without an id are
judged by their own text and are no one's copy; rows that repeat id and text stay or go together; of equal texts under several ids the
smallest id stays; very long texts pass whole; further columns travel along; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import decontam, jaccard, linededup, quality
from statloom.llm.common import table, written
from statloom.llm.queries import tokenized, vocabulary_path

#: The quality verdict rests on hashed counts that SQL has no function for.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.keep(docs, trusted)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that earlier documents hold; n_chars follows."""
    cut = linededup.dedup_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of smallest id stays; rows without an id stay.

    A row goes by its id and text: another text under the id of a copy is judged for itself.
    """
    found = jaccard.join(docs, digest=True).where("component_id < doc_id").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    same = (F.col("doc_id") == F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_digest"))
    return docs.join(found.hint("merge"), same, "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    hits = decontam.find_hits(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns)
    return hits.where("n_hit = 0").select("kept.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every kept text, with digests of the ids and of the decoded text."""
    return tokenized(docs, vocabulary_path(), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), spark, f"pipeline-{name}")
    return docs
