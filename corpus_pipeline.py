"""From documents to shards: toxicity, near duplicates, benchmark leaks, source mixture, uniform shards.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return
docs' columns. Each result is written as Parquet in the shared folder and reread as the next stage's docs.

Rows are kept or dropped as rows: a doc_id that is null or shared plays no part but to choose the row of a component
(the class with its least doc_id stays). Null and empty texts are neither toxic, nor near duplicates, nor leaks, and stay;
a null source is a source of its own; of repeated rows with words one stays; columns of any name are kept; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from lamina.llm.common import save, table

MAX_PASSES = 2.0
SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each_group(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated_rows(docs, max_passes=MAX_PASSES)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shuffle_shards(docs, SHARDS, stable=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mixing", mix),
    ("sharding", shard),
]
ORACLE_SQL = None  # the stages learn, search and permute; tests compare them with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
