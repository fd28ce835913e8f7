"""The corpus pipeline: each stage works on all that the stage before it kept.

``STAGES`` lists the stages as (name, function); a function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame, which is written as Parquet and read again as the next stage's ``docs``. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import decontaminate, jaccard, mixing, quality, sharding
from nearfield.llm.common import table, written
from nearfield.session import ship_package

# Near copies of the corpus: five words and 0.8, unlike the query op6 with three and 0.9.
NEAR = jaccard.Law(words=5, percent=80)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a counted rule or the classifier rejects go."""
    model = quality.train(docs, table(ship_package(spark), sf_dir, "labels"))
    return quality.keep_good(docs, model)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    ship_package(spark)
    return jaccard.one_of_each(docs, law=NEAR)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.without_benchmark(docs, table(ship_package(spark), sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    ship_package(spark)
    return mixing.repeated(mixing.mix(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in shuffled order: their columns, and shard and slot."""
    ship_package(spark)
    rows = sharding.shuffle_to_shards(docs)
    return rows.select("rec.*", F.col("shard"), F.col("slot"))


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

# Two stages learn a model or draw by a generator that SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
