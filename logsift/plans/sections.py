"""Reports as rows: ``(source, section, pos, text)``, joined to one text per source.

Every report is bounded by its rank filters before any text is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fill(wording: str, *values: Column | str) -> Column:
    """``wording`` with its ``{}`` marks filled; the values must not be null."""
    return F.format_string(wording.replace("%", "%%").replace("{}", "%s"), *values)


def rows(df: DataFrame, section: int, pos: Column, text: Column) -> DataFrame:
    """Section rows of ``df``; rows without a text are left out."""
    return df.select(
        "source",
        F.lit(section).cast("bigint").alias("section"),
        pos.cast("bigint").alias("pos"),
        text.alias("text"),
    ).filter(F.col("text").isNotNull())


def headed(first: Column, header: Column, text: Column) -> Column:
    """The text, with the section's header ahead of the first one."""
    return F.when(first, F.concat(header, F.lit("\n"), text)).otherwise(text)


def join_sections(sections: DataFrame, name: str) -> DataFrame:
    """``(source, name)``: the section rows of each source joined by line breaks."""
    ordered = F.array_sort(F.collect_list(F.struct("section", "pos", "text")))
    return (
        sections.groupBy("source")
        .agg(ordered.alias("rows"))
        .select("source", F.array_join(F.col("rows.text"), "\n").alias(name))
    )
