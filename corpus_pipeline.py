"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents; the last one returns packed pieces.
Each works on all rows that the stage before has kept. Null and empty texts fail the quality rules; the near-duplicate
stage links texts whose 5-word shingles have a Jaccard similarity of 0.8 or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.llm import mixing, neardup, packing, quality, suffixes
from adjudica.llm.common import documents, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def own_columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in COLUMNS])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(own_columns(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(own_columns(docs))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = suffixes.deduplicated(own_columns(docs), ("lang", "source"))
    return own_columns(done.withColumnRenamed("kept", "text").withColumn("n_chars", F.length("text").cast("long")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(own_columns(docs))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(own_columns(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources to target weights", source_mixing),
    ("packing", sequence_packing),
]

#: Fingerprints, suffix matches and token ids are beyond SQL; tests/llm/test_pipeline.py checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
