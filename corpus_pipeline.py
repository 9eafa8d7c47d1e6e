"""From raw documents to shards: quality rules, near-duplicates, decontamination, source mix, shards.

Each stage reads what the one before it kept, written as Parquet in the shared folder, so no stage is computed twice
and a lost executor costs at most the stage that runs.

Texts may be null, empty or of any length: a text without ten words goes in the first stage, all others pass as they are. Nulls in
other columns stay nulls; a null source is a source of its own, a row with a null key is never a near-duplicate. Of near-duplicates
the smallest key stays; rows repeated as a whole stay or go together and take a place in a shard each. An empty table passes
through as one. Columns beyond those of documents come along; where one of them is called shard or slot, the last stage's
columns get the next free number at their end. tests/llm/test_pipeline.py holds a run against plain versions of all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from freshet.llm import decontam, mixing, neardup, quality, sharding
from freshet.llm.common import cut


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep(docs, shingle=5, threshold=0.8)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def stage_shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [("quality rules", stage_quality), ("near-duplicates", stage_near), ("decontamination", stage_decontaminate), ("source mix", stage_mix), ("shards", stage_shard)]
#: Near-duplicate components and iterative propagation are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
