"""Logs that are held in a text column, one whole log per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions import catalogue as cat
from logsift.functions.dialect import WHITESPACE
from logsift.operators.lines import with_chunk


def split_lines(text: Column) -> Column:
    """The lines of a text; a break at the very end opens no further line."""
    return F.split(F.regexp_replace(text, f"(?:{cat.LINE_BREAK})\\z", ""), cat.LINE_BREAK, -1)


def lines_from_text(texts: DataFrame, strip: bool = False) -> DataFrame:
    """``(source, chunk, line_no, line)`` from ``(source, text)``; blank texts give none.

    ``strip`` first removes white space around the whole text, which drops
    leading blank lines and so shifts line numbers.
    """
    text = F.trim("text", F.lit(WHITESPACE)) if strip else F.col("text")
    lines = (
        texts.filter(~is_blank(F.col("text")))
        .select("source", F.posexplode(split_lines(text)).alias("p", "line"))
        .select("source", (F.col("p") + 1).cast("bigint").alias("line_no"), "line")
    )
    return with_chunk(lines).select("source", "chunk", "line_no", "line")


def is_blank(text: Column) -> Column:
    return F.coalesce(F.trim(text, F.lit(WHITESPACE)), F.lit("")) == ""


def rejected_sources(texts: DataFrame) -> DataFrame:
    """``(source, reason)`` of the texts that hold no log."""
    reason = F.when(F.col("text").isNull(), "no input").otherwise("empty input")
    return texts.filter(is_blank(F.col("text"))).select("source", reason.alias("reason"))
