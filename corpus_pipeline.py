"""The corpus pipeline: five stages over `documents`, each on all that the last one kept.

Defined cases, besides those of the operators. Null and empty texts are scored like any other
and have no near copies and no benchmark words; what the classifier keeps of them comes through
to the shards. Rows that share a doc_id are judged by their own text each. A source without bytes
keeps rate 1. Other columns pass through every stage. Empty tables give an empty table: without
labels the classifier keeps all, without a benchmark nothing is contaminated. Each stage's table
is written in the shared folder, whose owner clears it, since the result is read from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfare.llm import decontam, jaccard_join, mixing, pu_quality, sharding
from wayfare.llm.queries import learnable
from wayfare.scratch import write_table
from wayfare.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents scored below 0.3 go."""
    return pu_quality.keep_good(docs, pu_quality.fit(docs, learnable(table(spark, sf_dir, "labels"))), 0.3)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: five-word shingles, similarity 0.8 or more; the smallest doc_id of each group stays."""
    return jaccard_join.keep_one(docs, k=5, num=4, den=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: contaminated documents go."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: sources at the 0.7th power of their bytes; a document may repeat."""
    mixed = mixing.mix(docs, mixing.smoothed_weights(docs, 0.7), seed=20)
    return mixed.select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: sixteen shards of nearly equal bytes, equal texts together."""
    return sharding.with_shards(docs, 16)


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: The classifier has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
