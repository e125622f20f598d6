"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read as the next stage's docs. All but the last return the columns of ``documents``.
Empty tables, nulls, repeated rows and further columns behave as each operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import decontam, mixing, near_dedup, sharding, toxicity
from trellis.llm.common import fresh, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the segment scores reject (0.7 or more) go."""
    model = toxicity.train_model(docs, table(spark, sf_dir, "labels"))
    (found,) = fresh(docs, "_toxicity")
    return toxicity.annotate(docs, model, out=found).where(F.col(f"{found}.score") < 0.7).drop(found)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dedup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clear(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mixture takes, a row for each document and pass over its source."""
    return mixing.mixed(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mixture, whole, with their shard and slot."""
    return sharding.shard(docs, 24, carry=True).withColumn("law", F.lit("bytes"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", into_shards),
]

#: Learned weights, hashed signatures and pseudorandom draws are beyond SQL; the stages are
#: tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
