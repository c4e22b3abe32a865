"""A corpus pipeline of five stages over the documents table: each reads what the one before it wrote.

Null texts count as empty for every decision and stay null. Rows without doc_id go through all stages; they come last where an
order decides. Of repeated rows the near-duplicate stage keeps one. Empty tables give empty results: without labels nothing is
toxic, without benchmark items nothing is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import decontaminate, lines, mixing, simhash, toxicity
from sightline.llm.common import scratch


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier of the labelled rows finds toxic go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier in the corpus, exactly or within the edit bounds, are cut, however much of a document they are."""
    return lines.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share 0.8 or more of their five-word shingles the document with the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut; documents that mostly consist of them go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to their sources' target weights and shuffled."""
    return mixing.replicate(docs)


STAGES = [("toxicity", toxic), ("line dedup", repeated_lines), ("near duplicates", near_duplicates), ("decontamination", benchmark_passages), ("mixing", mix)]

#: The classifier and the fingerprints can't be said in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all documents, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
