"""From raw documents to training shards: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwell.llm import decontaminate, jaccard, language, mixing, sharding
from linkwell.llm.runtime import discard, documents, free_name, scratch, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, null and empty ones among them, and those of no clear language, go.

    Repeated rows stay or go together, very long texts are read whole, other columns stay as they are.
    """
    return language.accepted(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest doc_id.

    Texts without words are near to none; rows without doc_id stay; of rows of one doc_id one stays, the same
    in any order of rows; ties there are none but equal rows, of which one stays. Other columns stay.
    """
    return jaccard.one_of_each(docs, k=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go.

    Rows are told apart by doc_id and text: others of a doc_id stay, repeated rows go together. Null texts and
    items, and items of fewer than 4 tokens, overlap with nothing. Other columns stay.
    """
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: never, once or twice.

    Texts without words are never taken; a null source is a source; of rows equal in all columns as many come as the
    mix takes of them together. Other columns stay, whatever their names.
    """
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the committed store, each with its shard; columns and repeated rows stay."""
    rows = sharding.shard(docs).read(docs.schema)
    return rows.select(*docs.columns, F.col(rows.columns[-3]).alias(free_name("shard", docs.columns)))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing_to_weights),
    ("sharding", sharded),
]

#: No SQL expresses the network of the first stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``documents`` that every stage keeps, as often as the mix takes them, each with its shard.

    Null and empty texts go at the first stage (they have no language), and with them documents
    without a word; repeated rows and near copies become one row, ties going to the least doc_id; very
    long texts are taken whole; columns of any names stay; an empty table gives an empty result.
    """
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            done, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(docs.lw_path)
        if name != STAGES[0][0]:
            discard(done)
    sharded_rows = STAGES[-1][1](spark, docs, sf_dir)  # of the store
    discard(docs)
    return sharded_rows
