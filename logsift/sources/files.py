"""Log files as numbered lines."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsift.functions import catalogue as cat
from logsift.operators.lines import with_chunk


def read_log_files(
    spark: SparkSession, paths: str | list[str] | None, label: str | None = None
) -> DataFrame:
    """``(source, chunk, line_no, line)`` of files, folders or globs.

    ``source`` is the file's address, or ``label``, which needs a single file.
    Bytes that are no UTF-8 become U+FFFD. Large files are read in blocks; lines
    are numbered within their block and shifted by the lines of earlier blocks,
    so no text is shuffled or sorted. ``chunk`` follows from the line number, also
    in a compressed file, which is a single block.
    """
    paths = [paths] if isinstance(paths, str) else list(paths or [])
    if not paths:
        raise ValueError("Provide a log text or a file path. Neither was given.")
    is_glob = any(c in path for path in paths for c in "*?[{")
    if label is not None and (len(paths) > 1 or is_glob or os.path.isdir(paths[0])):
        raise ValueError("A label names a single file; leave it out to read several.")
    for path in paths:
        local = os.path.expanduser(path)
        if "://" not in path and not is_glob and not os.path.exists(local):
            raise ValueError(f"File not found: {local}. Check the path and try again.")

    source = F.col("_metadata.file_path") if label is None else F.lit(label)
    lines = (
        spark.read.text([os.path.expanduser(p) for p in paths])
        .select(
            source.alias("source"),
            F.col("_metadata.file_block_start").alias("block"),
            F.explode(split_file_lines(F.col("value"))).alias("line"),
        )
        # Within one block this grows in file order.
        .withColumn("seq", F.monotonically_increasing_id())
    )
    return with_chunk(numbered(lines)).select("source", "chunk", "line_no", "line")


def split_file_lines(value: Column) -> Column:
    """The lines in what a reader that knows fewer line breaks takes for one."""
    value = F.make_valid_utf8(value)
    parts = F.split(value, cat.LINE_BREAK, -1)
    return F.when(value.rlike(cat.LINE_BREAK), parts).otherwise(F.array(value))


def numbered(lines: DataFrame) -> DataFrame:
    """``(source, line_no, line)`` from lines with their block and a number that grows in it.

    A block sits in one task in order, so a line's place is its distance to the block's
    first number, and only one row per block is moved. Both come from a read of their own;
    if the files were split differently in between, the numbers don't fit and the job fails
    with a message instead of losing lines.
    """
    blocks = lines.groupBy("source", "block").agg(
        F.min("seq").alias("low"), F.max("seq").alias("high"), F.count("*").alias("n")
    )
    before = Window.partitionBy("source").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    blocks = blocks.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    fits = (F.col("high") - F.col("low") + 1 == F.col("n")) & F.col("seq").between(
        F.col("low"), F.col("high")
    )
    failure = F.raise_error(
        F.lit("input was split differently between two reads; "
              "set spark.sql.files.minPartitionNum to a fixed value")
    ).cast("bigint")
    line_no = F.when(fits, F.col("base") + F.col("seq") - F.col("low") + 1).otherwise(failure)
    # A left join: a block that the other read did not see must fail, not drop its lines.
    return lines.join(blocks, ["source", "block"], "left").select(
        "source", line_no.alias("line_no"), "line"
    )
