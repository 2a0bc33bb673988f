"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adjudica.catalog import Catalog

from . import chunks, codes, editcounts, language, markov, merkle, mixing, neighbours, packing, quality, simhash, suffixes, toxicity
from .common import documents

LLM = Catalog()


@LLM.add("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(documents(spark, sf_dir))


@LLM.add("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@LLM.add("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


@LLM.add("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.summary(documents(spark, sf_dir))


@LLM.add("op5_chunk_dedup")
def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.deduplicated(documents(spark, sf_dir)).drop("spans")


@LLM.add("op6_mixing", mixing.SQL)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


@LLM.add("op7_hidden_markov")
def op7_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.scored(documents(spark, sf_dir))


@LLM.add("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@LLM.add("op9_neighbours")
def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@LLM.add("op10_edit_counts")
def op10_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editcounts.counted(editcounts.with_edits(documents(spark, sf_dir)))


@LLM.add("op11_merkle", merkle.SQL)
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(documents(spark, sf_dir))


@LLM.add("op12_codes", codes.SQL)
def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@LLM.add("op13_language")
def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted(documents(spark, sf_dir))
