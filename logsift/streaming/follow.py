"""Following folders of log files: new files become appends to the stored logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logsift.operators.lines import with_chunk
from logsift.plans.staging import parquet_stage
from logsift.plans.triage import Triage
from logsift.sources.files import numbered, split_file_lines


def folder_of(path: Column) -> Column:
    """The default label of a file: the folder it lies in, so that its files are one log."""
    return F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)


def follow(
    triage: Triage, path: str, checkpoint: str, name: str = "follow", label: Column | None = None, files_at_once: int | None = None
) -> StreamingQuery:
    """Appends the lines of files that appear under ``path`` to the store, then stops.

    A log is all files of one ``label``, by default of one folder, in the order of their
    names within a batch, and in the order of arrival over batches. ``files_at_once`` bounds
    the files of a batch. Each batch is one append: only its lines are read and classified,
    and a trace that goes on from an earlier file is joined when the log is read. No state is
    held between batches but the few numbers that the store has of every source.

    The store notes the number of the batch under ``name`` in the version that adds it. A
    batch that is run again, after a failure or a restart from ``checkpoint``, is passed over
    if it is noted, so lines are neither lost nor stored twice.
    """
    given = triage.spark.readStream.format("text")
    if files_at_once is not None:
        given = given.option("maxFilesPerTrigger", files_at_once)
    at = F.col("_metadata.file_path")
    rows = given.load(path).select(
        (folder_of(at) if label is None else label).alias("source"),
        F.struct(at.alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("block"),
        F.explode(split_file_lines(F.col("value"))).alias("line"),
    )

    def append(batch: DataFrame, number: int) -> None:
        if not triage.store.noted(name, number):
            triage.add_lines(_numbered(batch), mark=(name, number))

    writer = rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.queryName(name).trigger(availableNow=True).start()


def _numbered(batch: DataFrame) -> DataFrame:
    """``(source, chunk, line_no, line)`` of one batch, files in the order of their names.

    The batch is written once, with a number that grows inside each block of a file, so that
    numbering reads the same rows twice; only one row per block moves.
    """
    held = parquet_stage(batch.sparkSession)(batch.withColumn("seq", F.monotonically_increasing_id()), "batch")
    return with_chunk(numbered(held)).select("source", "chunk", "line_no", "line")
