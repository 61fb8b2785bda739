"""The corpus pipeline: quality, near duplicates, benchmark leaks, mixing, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import decontam, jaccard, mixing, quality, sharding
from cairn.llm.common import Held


def rank_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking does not reject (score 0.3 or more).

    Null and empty texts are scored like others; repeated rows go or stay together; an empty table gives an empty result.
    """
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, one row, that with the smallest doc_id; documents without words link with nothing."""
    return jaccard.one_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item; null and empty texts hold none."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of one epoch at most that the source budgets take: four fifths of the tokens.

    Null lang or source: 'unknown'; rows that share a doc_id are taken together; ties go by doc_id, then token count.
    """
    return mixing.take(docs, share=(4, 5), most_epochs=1)


def place(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document that is left; a null text has size 1, repeated rows have slots of their own."""
    return sharding.shard(docs, sharding.tree(8), sharding.tree(9))


STAGES = [("quality", rank_quality), ("near_duplicates", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix_sources), ("sharding", place)]

#: The learned scores of the first stage have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again."""
    held = Held(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, held.put(stage(spark, docs, sf_dir), name)
        held.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
