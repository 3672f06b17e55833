"""Small tables per source and slice of time that merge: counts, distinct templates, heavy hitters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.functions import catalogue as cat
from logsift.functions.text import template_key
from logsift.operators.event_time import event_times
from logsift.operators.lines import classify

#: Precision of a distinct count: an error of about 1.04 / 2 ** (HLL_BITS / 2).
HLL_BITS = 12
#: Templates that a heavy-hitter sketch keeps track of. A template that holds more than about
#: one in a third of this number of a slice's lines is never missed.
TRACKED = 10_000
_COUNTS = [f"n_{level}" for level in cat.LEVELS]


def time_slices(lines: DataFrame, unit: str = "hour", last_year: int | None = None) -> DataFrame:
    """``(source, slice, n, n_<level>, templates, frequent)`` of all lines but noise.

    ``slice`` is the start of the hour (or another unit of ``date_trunc``) of a line's event
    time, null for lines without one. ``templates`` is a sketch of the distinct templates,
    ``frequent`` one of how often they occur; stack lines have none. Slices of parts of a
    log merge into those of the whole by ``merged_slices``.
    """
    rows = classify(lines)
    kept = ("severity", "cleaned", "is_stack")
    timed = event_times(rows, last_year, keep=kept).select("source", "event_time", *kept)
    others = rows.where("ts_text is null").select("source", F.lit(None).cast("timestamp").alias("event_time"), *kept)
    template = F.when(~F.col("is_stack"), template_key(F.col("cleaned"))).alias("template")
    keyed = timed.unionByName(others).select("source", F.date_trunc(unit, "event_time").alias("slice"), "severity", template)
    return keyed.groupBy("source", "slice").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("severity") == level).alias(f"n_{level}") for level in cat.LEVELS],
        F.hll_sketch_agg("template", F.lit(HLL_BITS)).alias("templates"),
        F.call_function("approx_top_k_accumulate", F.col("template"), F.lit(TRACKED)).alias("frequent"),
    )


def merged_slices(slices: DataFrame, *keys: str) -> DataFrame:
    """Slices by ``keys`` (``source``, ``slice``, both or none), from sketches and sums alone."""
    return slices.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[F.sum(name).alias(name) for name in _COUNTS],
        F.hll_union_agg("templates").alias("templates"),
        F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(TRACKED)).alias("frequent"),
    )


def distinct_templates(merged: DataFrame) -> DataFrame:
    """The estimated number of distinct templates in place of the sketches."""
    return merged.withColumn("n_templates", F.hll_sketch_estimate("templates")).drop("templates", "frequent")


def heavy_hitters(merged: DataFrame, k: int) -> DataFrame:
    """One row for each of the ``k`` most frequent templates of a row of ``merged``."""
    top = F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(k))
    keys = [c for c in merged.columns if c in ("source", "slice")]
    listed = merged.select(*keys, F.posexplode(top).alias("p", "x"))
    return listed.select(*keys, (F.col("p") + 1).cast("long").alias("pos"), F.col("x.item").alias("template"), F.col("x.count").alias("n"))


def severity_by_time(slices: DataFrame) -> DataFrame:
    """``(source, slice, severity, n)`` without zero counts."""
    levels = F.array(*[F.struct(F.lit(lv).alias("severity"), F.col(f"n_{lv}").alias("n")) for lv in cat.LEVELS])
    sums = slices.groupBy("source", "slice").agg(*[F.sum(name).alias(name) for name in _COUNTS])
    return sums.select("source", "slice", F.inline(levels)).where("n > 0")


def late_lines(slices: DataFrame, delay: Column) -> DataFrame:
    """``(source, slice, n_late)``: lines that came in a batch after their time had passed.

    ``slices`` hold the place ``at`` of their batch. A source's watermark ahead of a batch is
    the latest slice of its earlier batches less ``delay``; lines of slices before it are
    late. They count in their slice like all others.
    """
    tops = slices.groupBy("source", "at").agg(F.max("slice").alias("top"))
    earlier = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    marks = tops.select(F.col("source").alias("s"), F.col("at").alias("a"), (F.max("top").over(earlier) - delay).alias("mark"))
    joined = slices.join(marks, (F.col("source") == F.col("s")) & (F.col("at") == F.col("a")))
    late = joined.where(F.col("slice") < F.col("mark"))
    return late.groupBy("source", "slice").agg(F.sum("n").alias("n_late"))
