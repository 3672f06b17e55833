"""The corpus pipeline: documents through five operators, each stage written and reread."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm import decontam, langid, linededup, mixing, simhash
from logsift.llm.scratch import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the languages learned from three quarters of them.

    The least score is the one that 99.9 % of the other quarter reach.
    """
    held_out = F.expr("coalesce(crc32(cast(doc_id as string)) % 4 = 2, true)")
    model = langid.fit(docs.where(~held_out))
    return langid.labelled_documents(docs, model, langid.least_score(docs.where(held_out), model))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes blocks of lines out of documents where an earlier one holds them."""
    return linededup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose fingerprints differ in three bits or fewer."""
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without passages of the benchmark."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's weight asks, with epoch and place in it."""
    mixed = mixing.draws(docs)
    columns = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return mixed.select(*columns, F.col("epoch").alias("mix_epoch"), F.col("draw_key").alias("mix_key"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
]

#: A trained model, patience diff and XXH64 can't be written in SQL; tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; all but the last write what the next one reads."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, name)
            if k:
                scratch.forget(STAGES[k - 1][0])
    return docs
