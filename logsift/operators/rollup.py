"""Severity counts by folder of the source and slice of time, all in one aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Folder levels of a source that are told apart; what lies deeper counts at the last one.
LEVELS = 4


def severity_rollup(timed: DataFrame, slice_of: str = "hour", levels: int = LEVELS) -> DataFrame:
    """``(level, folder, slice, severity, n)`` from ``(source, event_time, severity)``.

    A source is a path such as ``site/rack/service``. Level 0 is everything, level k the first
    k names of the path; a path with fewer names has no row at that level. ``slice`` is the
    start of the hour (or of another unit that ``date_trunc`` knows); rows with a null slice
    and ``sliced`` false are totals over all time, those with ``sliced`` true hold the lines
    without an event time. One pass over the lines feeds all levels: grouping sets, which
    combine before the shuffle.
    """
    names = F.split("source", "/")
    folders = [
        F.when(F.size(names) >= k, F.array_join(F.slice(names, 1, k), "/")).alias(f"f{k}") for k in range(1, levels + 1)
    ]
    rows = timed.select(*folders, F.date_trunc(slice_of, "event_time").alias("slice"), "severity")
    keys = [F.col(f"f{k}") for k in range(1, levels + 1)]
    severity, part = F.col("severity"), F.col("slice")
    sets = [[severity], [severity, part]]
    sets += [[key, severity, *more] for key in keys for more in ([], [part])]
    grouped = rows.groupingSets(sets, *keys, part, severity).agg(
        F.count("*").alias("n"),
        *[F.grouping(key).alias(f"g{k}") for k, key in enumerate(keys, 1)],
        F.grouping(part).alias("gs"),
    )
    level = reduce(lambda other, k: F.when(F.col(f"g{k}") == 0, k).otherwise(other), range(1, levels + 1), F.lit(0))
    shown = grouped.select(
        level.cast("long").alias("level"),
        F.coalesce(*[F.when(F.col(f"g{k}") == 0, F.col(f"f{k}")) for k in range(1, levels + 1)]).alias("folder"),
        (F.col("gs") == 0).alias("sliced"),
        "slice",
        "severity",
        "n",
    )
    return shown.where((F.col("level") == 0) | F.col("folder").isNotNull())


def worst_folders(rollup: DataFrame, k: int, grave: list[str]) -> DataFrame:
    """``(level, folder, n)``: the ``k`` folders of each level with the most grave lines in all."""
    totals = rollup.where(~F.col("sliced") & F.col("severity").isin(grave)).groupBy("level", "folder").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("level").orderBy(F.desc("n"), "folder")
    return totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
