"""Deduplication by template and everything counted per source.

``line_groups`` is the one aggregation over all lines: it combines on the map
side, and its key holds the template, so a source of any size spreads over the
cluster. Its buffer holds numbers only, so it hashes and sorts no lines. Templates
and source metrics are both read from its (smaller) result; the texts they show are
fetched afterwards by line number. Whatever fetches texts reads ``lines`` twice:
annotate and store them first, so that no pattern runs again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.functions import catalogue as cat
from logsift.functions import text as tx
from logsift.operators.lines import annotate, classify


def line_groups(lines: DataFrame) -> DataFrame:
    """One row per source, kind of line (text, stack, noise) and template."""
    kind = (
        F.when(F.col("is_noise"), "noise").when(F.col("is_stack"), "stack").otherwise("text")
    )
    template = F.when(F.col("kind") == "text", tx.template_key(F.col("cleaned")))
    has_ts = F.col("ts_text").isNotNull() & (F.col("kind") != "noise")
    ts_line = F.when(has_ts, F.col("line_no"))
    counts = [
        F.count_if((F.col("kind") != "noise") & (F.col("severity") == level)).alias(f"n_{level}")
        for level in cat.LEVELS
    ]
    return (
        annotate(lines)
        .withColumn("kind", kind)
        .withColumn("template", template)
        .groupBy("source", "kind", "template")
        .agg(
            F.count("*").alias("n"),
            F.min("line_no").alias("first_line"),
            F.max(tx.severity_rank(F.col("severity"))).alias("rank"),
            *counts,
            F.min(ts_line).alias("first_ts_line"),
            F.max(ts_line).alias("last_ts_line"),
        )
    )


def merged_groups(groups: DataFrame) -> DataFrame:
    """Line groups of parts of a source as those of the whole; numbers only, by their key."""
    sums = [F.sum(name).alias(name) for name in ("n", *(f"n_{level}" for level in cat.LEVELS))]
    ends = [F.min("first_line").alias("first_line"), F.max("rank").alias("rank")]
    ends += [F.min("first_ts_line").alias("first_ts_line"), F.max("last_ts_line").alias("last_ts_line")]
    merged = groups.groupBy("source", "kind", "template").agg(*sums, *ends)
    return merged.select(groups.columns)


def templates_of(groups: DataFrame) -> DataFrame:
    """``(source, template, n, severity, first_line)`` from line groups."""
    return groups.filter(F.col("kind") == "text").select(
        "source",
        "template",
        "n",
        tx.severity_of_rank(F.col("rank")).alias("severity"),
        "first_line",
    )


def with_samples(templates: DataFrame, lines: DataFrame) -> DataFrame:
    """Add ``sample``, the cleaned text of the first line, to chosen templates."""
    texts = annotate(lines).select("source", F.col("line_no").alias("first_line"), "cleaned")
    return templates.join(texts, ["source", "first_line"]).withColumnRenamed("cleaned", "sample")


def metrics_of(groups: DataFrame) -> DataFrame:
    """One row per source from line groups; sources that are all noise are kept.

    ``important`` and ``unclassified`` count templates by level; ``first_ts_line`` and
    ``last_ts_line`` are the lines of the first and the last timestamp.
    """
    is_text = F.col("kind") == "text"
    total, unique = F.col("total_lines"), F.col("unique_lines")
    return (
        groups.groupBy("source")
        .agg(
            F.sum("n").alias("total_lines"),
            F.count_if(is_text).alias("unique_lines"),
            F.coalesce(F.sum(F.when(F.col("kind") == "noise", F.col("n"))), F.lit(0)).alias(
                "noise_lines"
            ),
            F.count_if(is_text & (F.col("rank") >= cat.RANK["warning"])).alias("important"),
            F.count_if(is_text & (F.col("rank") == cat.RANK["unknown"])).alias("unclassified"),
            F.min("first_ts_line").alias("first_ts_line"),
            F.max("last_ts_line").alias("last_ts_line"),
            *[F.sum(f"n_{level}").alias(f"n_{level}") for level in cat.LEVELS],
        )
        .withColumn("reduction_pct", reduction_percent(total, unique))
    )


def with_time_range(per_source: DataFrame, lines: DataFrame) -> DataFrame:
    """Replace ``first_ts_line, last_ts_line`` by the texts ``first_ts, last_ts``.

    Where ``per_source`` was written before, Spark knows how small it is and moves no lines.
    """
    ends = [F.struct(F.lit(n).alias("end"), F.col(f"{n}_ts_line").alias("line_no")) for n in ("first", "last")]
    wanted = per_source.select("source", F.inline(F.array(*ends))).where("line_no is not null")
    seen = annotate(lines).where("ts_text is not null").select("source", "line_no", "ts_text")
    found = wanted.join(seen, ["source", "line_no"]).groupBy("source")
    texts = F.map_from_entries(F.collect_list(F.struct("end", "ts_text")))
    found = found.agg(texts.alias("ts")).select("source", F.col("ts.first").alias("first_ts"), F.col("ts.last").alias("last_ts"))
    return per_source.drop("first_ts_line", "last_ts_line").join(found, "source", "left")


def reduction_percent(total: Column, unique: Column) -> Column:
    """Share of lines removed in percent, one decimal, halves up; 0 for an empty log.

    Computed on integers, so the result does not hang on a rounding of doubles.
    """
    tenths = F.floor((2000 * (total - unique) + total) / (2 * total))
    return F.when(total == 0, F.lit(0.0)).otherwise(tenths / F.lit(10.0))


def dedup_templates(lines: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """All templates with their samples; ``groups`` are line groups that exist already."""
    return with_samples(templates_of(line_groups(lines) if groups is None else groups), lines)


def source_metrics(lines: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """``metrics_of`` with ``first_ts, last_ts``; ``metrics`` are such that exist already."""
    return with_time_range(metrics_of(line_groups(lines)) if metrics is None else metrics, lines)


def severity_counts(lines: DataFrame) -> DataFrame:
    """``(source, severity, n)`` over all lines but noise, stack lines included."""
    return classify(lines).groupBy("source", "severity").agg(F.count("*").alias("n"))


def timestamps_seen(lines: DataFrame) -> DataFrame:
    """``(source, line_no, ts_text)`` of every line that has a timestamp."""
    return (
        classify(lines)
        .filter(F.col("ts_text").isNotNull())
        .select("source", "line_no", "ts_text")
    )


def timestamp_ends(lines: DataFrame) -> DataFrame:
    """``(source, first_ts_line, last_ts_line)``: the lines of the first and last timestamp."""
    ts_line = F.when(F.col("ts_text").isNotNull(), F.col("line_no"))
    return (
        classify(lines)
        .groupBy("source")
        .agg(F.min(ts_line).alias("first_ts_line"), F.max(ts_line).alias("last_ts_line"))
    )


def time_range(lines: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """First and last timestamp of a source in line order; null where it has none.

    ``ends`` are ``timestamp_ends`` that exist already.
    """
    return with_time_range(timestamp_ends(lines) if ends is None else ends, lines)


def severity_breakdown(metrics: DataFrame) -> DataFrame:
    """``(source, pos, severity, n)`` in fixed level order without zero counts."""
    pairs = F.array(
        *[
            F.struct(F.lit(level).alias("severity"), F.col(f"n_{level}").alias("n"))
            for level in cat.LEVELS
        ]
    )
    return (
        metrics.select("source", F.posexplode(pairs).alias("pos", "level"))
        .filter(F.col("level.n") > 0)
        .select(
            "source", (F.col("pos") + 1).cast("bigint").alias("pos"), "level.severity", "level.n"
        )
    )


def first_templates(templates: DataFrame, k: int) -> DataFrame:
    """The first ``k`` templates of each source by first appearance, with ``pos``.

    Spark keeps at most ``k`` rows per source in every task before the shuffle.
    """
    order = Window.partitionBy("source").orderBy("first_line")
    ranked = templates.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k)
    return ranked.withColumn("pos", F.col("pos").cast("bigint"))


def important_templates(templates: DataFrame, k: int = cat.SUMMARY_TEMPLATES) -> DataFrame:
    return first_templates(templates.filter(F.col("severity").isin(cat.GRAVE)), k)


def high_frequency_templates(templates: DataFrame, k: int = cat.SUMMARY_FREQUENT) -> DataFrame:
    frequent = ~F.col("severity").isin(cat.GRAVE) & (F.col("n") >= cat.FREQUENT_FROM)
    return first_templates(templates.filter(frequent), k)


def unknown_templates(templates: DataFrame, k: int = cat.DIGEST_UNKNOWN) -> DataFrame:
    return first_templates(templates.filter(F.col("severity") == "unknown"), k)
