"""Per-line classification: projections and filters, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.functions import text as tx

# A chunk is a run of neighbouring lines of one source. Sequence operators work
# on one chunk per task, so a source of any size is spread over the cluster.
CHUNK_LINES = 250_000


def with_chunk(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Add ``chunk`` from the line number unless the source already set it."""
    if "chunk" in lines.columns:
        return lines
    return lines.withColumn("chunk", F.floor((F.col("line_no") - 1) / chunk_lines))


def annotate(lines: DataFrame) -> DataFrame:
    """Add ``cleaned, is_noise, severity, ts_text, is_stack`` to every line."""
    if "cleaned" in lines.columns:
        return lines
    text = F.col("cleaned")
    return lines.withColumn("cleaned", tx.clean(F.col("line"))).withColumns(
        {
            "is_noise": tx.is_noise(text),
            "severity": tx.detect_severity(text),
            "ts_text": tx.extract_timestamp(text),
            "is_stack": tx.is_stack_line(text),
        }
    )


def classify(lines: DataFrame) -> DataFrame:
    """The annotated lines without noise."""
    return annotate(lines).filter(~F.col("is_noise")).drop("is_noise")
