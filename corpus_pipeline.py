"""A corpus pipeline over ``documents``: five stages, each an operator of sqlscope.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what
a stage returns as Parquet to the shared folder and reads it as the next one's
documents. All stages but the last return the columns of documents.

Defined results, for every stage: columns beyond those of documents pass through, whatever
their names (the last stage replaces columns named shard and slot); repeated rows are rows of
their own; an empty table gives none; very long texts are read whole and kept whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sqlscope.llm import decontaminate, langid, mixing, ngram_join, sharding
from sqlscope.llm.common import materialize, ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language (null, empty, or no letter) go. Rows with null ids are judged like others; no score is a tie, as any will do."""
    ship(spark)
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingles of five words at a similarity of 0.8, the smallest doc_id stays.

    Rows that share it all stay, and so do rows with a null id, which is smaller than none; null and empty texts link with nothing.
    """
    return ngram_join.keep_one(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none, null ids are ids."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), mode="documents")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources by weights 1, 2, 3 takes them.

    Texts without words are never taken; a null source is a source; of rows that tie as many are taken as fit.
    """
    return mixing.mix_documents(docs, weights=(1, 2, 3), max_repeat=3)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A uniform shuffle into 24 shards of equal size: shard and slot beside the columns of documents. Null ids and texts get a place like others."""
    return sharding.shard_documents(docs, shards=24)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: A learned model and a random shuffle can't be written as SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
