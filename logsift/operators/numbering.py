"""Positions within a source without sorting a whole source in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def add_position(rows: DataFrame, order: list[str], weight: Column, name: str) -> DataFrame:
    """Add ``name``: the total ``weight`` of the rows before this one in its source.

    ``rows`` has ``source`` and ``chunk``; chunks follow each other in order. Rows
    are sorted within their chunk only. What lies before a chunk comes from one
    row per chunk, so the only window over a whole source is over chunk totals.
    """
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = rows.groupBy("source", "chunk").agg(F.sum(weight).alias("_total"))
    bases = totals.select(
        "source", "chunk", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base")
    )
    within = Window.partitionBy("source", "chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = rows.withColumn("_within", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    return (
        placed.join(bases, ["source", "chunk"])
        .withColumn(name, F.col("_base") + F.col("_within"))
        .drop("_base", "_within")
    )
