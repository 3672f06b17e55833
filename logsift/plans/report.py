"""Summary, ingest report and digest of every source at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions import catalogue as cat
from logsift.functions.text import display_text
from logsift.operators import templates as tp
from logsift.operators import traces as tr
from logsift.plans import wording as w
from logsift.plans.sections import fill, headed, join_sections, rows
from logsift.plans.staging import Stage


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _times(always: bool = False) -> Column:
    shown = fill(w.TIMES, "n")
    return shown if always else F.when(F.col("n") > 1, shown).otherwise("")


@dataclass(frozen=True)
class LogTables:
    """What reports read; every table but ``lines`` is small against the log.

    Annotated ``lines`` are only joined to the few line numbers that a report shows.
    """

    lines: DataFrame
    metrics: DataFrame
    templates: DataFrame
    pieces: DataFrame
    states: DataFrame


def tables_of(lines: DataFrame, groups: DataFrame, pieces: DataFrame, stage: Stage) -> LogTables:
    """Report tables from stored annotated lines, their groups and the ends of their pieces.

    Metrics with their time range and chunk states are read by several sections and are
    written once. The metrics are written before the time range, too, so that fetching it
    is planned for the few rows that they are.
    """
    metrics = tp.with_time_range(stage(tp.metrics_of(groups), "counts"), lines)
    states = tr.chunk_states(pieces)
    return LogTables(
        lines, stage(metrics, "metrics"), tp.templates_of(groups), pieces, stage(states, "states")
    )


def _shown_templates(tables: LogTables, chosen: dict[int, DataFrame]) -> DataFrame:
    """Chosen templates of each section, with their samples, which one join fetches."""
    tagged = [df.withColumn("section", F.lit(k)) for k, df in chosen.items()]
    return tp.with_samples(_union(tagged), tables.lines)


def _facts(tables: LogTables, texts: list[tuple[int, int, Column]]) -> DataFrame:
    """Section rows that hang on a source's counts alone, in one pass over them."""

    def number(value: int, name: str) -> Column:
        return F.lit(value).cast("bigint").alias(name)

    at = [
        F.struct(number(section, "section"), number(pos, "pos"), text.alias("text"))
        for section, pos, text in texts
    ]
    counts = tr.trace_counts(tables.states)
    facts = tables.metrics.join(counts, "source", "left")
    return facts.select("source", F.inline(F.array(*at))).filter(F.col("text").isNotNull())


def _trace_rows(tables: LogTables, k: int, text: Column) -> DataFrame:
    first = tr.first_traces(tables.pieces, k, tables.states)
    return rows(first, 3, F.col("trace_id"), text)


def _levels() -> list[Column]:
    return [
        F.when(F.col(f"n_{lv}") > 0, fill(w.BREAKDOWN_LEVEL, F.lit(lv.upper()), f"n_{lv}"))
        for lv in cat.LEVELS
    ]


def summary_sections(tables: LogTables) -> DataFrame:
    """Section rows of the summary report."""
    has_range = F.col("first_ts").isNotNull()
    left_over = F.col("n_traces") - cat.SUMMARY_TRACES
    facts = _facts(
        tables,
        [
            (1, 0, F.lit(w.SUMMARY)),
            (1, 1, fill(w.TOTAL, "total_lines")),
            (1, 2, fill(w.UNIQUE, "unique_lines", "reduction_pct")),
            (1, 3, fill(w.NOISE, "noise_lines")),
            (1, 4, F.when(has_range, fill(w.TIME_RANGE, "first_ts", "last_ts"))),
            (2, 0, F.lit(w.BREAKDOWN)),
            *((2, pos, text) for pos, text in enumerate(_levels(), 1)),
            (3, 0, F.when(F.col("n_traces") > 0, fill(w.TRACES, "n_traces"))),
            # Behind the traces that are shown.
            (3, cat.SUMMARY_TRACES + 1, F.when(left_over > 0, fill(w.MORE_TRACES, left_over))),
            (4, 0, F.when(F.col("important") > 0, F.lit(w.IMPORTANT))),
        ],
    )
    found = _shown_templates(
        tables,
        {
            4: tp.important_templates(tables.templates),
            5: tp.high_frequency_templates(tables.templates),
        },
    )
    shown = fill(w.TEMPLATE, F.upper("severity"), display_text(F.col("sample")))
    text = F.concat(shown, F.when(F.col("section") == 4, _times()).otherwise(_times(always=True)))
    frequent = (F.col("section") == 5) & (F.col("pos") == 1)
    texts = found.select(
        "source", F.col("section").cast("bigint"), "pos", headed(frequent, F.lit(w.FREQUENT), text).alias("text")
    )
    trace = fill(w.TRACE, "trace_id", "header_line", "summary")
    return _union([facts, _trace_rows(tables, cat.SUMMARY_TRACES, trace), texts])


def digest_sections(tables: LogTables) -> DataFrame:
    """Section rows of the condensed text that an external analysis reads."""
    levels = F.concat_ws(
        ", ",
        *[
            F.when(F.col(f"n_{lv}") > 0, fill(w.DIGEST_LEVEL, F.lit(lv), f"n_{lv}"))
            for lv in cat.LEVELS
        ],
    )
    has_range = F.col("first_ts").isNotNull()
    sampled = F.least("unclassified", F.lit(cat.DIGEST_UNKNOWN))
    facts = _facts(
        tables,
        [
            (1, 0, fill(w.DIGEST_TOTALS, "total_lines", "unique_lines", "noise_lines")),
            (1, 1, F.when(has_range, fill(w.DIGEST_RANGE, "first_ts", "last_ts"))),
            (1, 2, fill(w.DIGEST_LEVELS, F.concat(F.lit("{"), levels, F.lit("}")))),
            (2, 0, F.when(F.col("important") > 0, fill(w.DIGEST_IMPORTANT, "important"))),
            (3, 0, F.when(F.col("n_traces") > 0, fill(w.DIGEST_TRACES, "n_traces"))),
            (4, 0, F.when(F.col("unclassified") > 0, fill(w.DIGEST_UNKNOWN, sampled))),
        ],
    )
    found = _shown_templates(
        tables,
        {
            2: tp.important_templates(tables.templates, cat.DIGEST_TEMPLATES),
            4: tp.unknown_templates(tables.templates),
        },
    )
    important = fill(w.DIGEST_TEMPLATE, F.upper("severity"), "n", "sample")
    text = F.when(F.col("section") == 2, important).otherwise(F.concat("sample", _times()))
    texts = found.select("source", F.col("section").cast("bigint"), "pos", text.alias("text"))
    trace = fill(w.DIGEST_TRACE, "trace_id", "header_line", "summary")
    return _union([facts, _trace_rows(tables, cat.DIGEST_TRACES, trace), texts])


def summary_report(tables: LogTables) -> DataFrame:
    """``(source, summary)``."""
    return join_sections(summary_sections(tables), "summary")


def analysis_digest(tables: LogTables) -> DataFrame:
    """``(source, digest)``."""
    return join_sections(digest_sections(tables), "digest")


def ingest_report(
    summaries: DataFrame,
    metrics: DataFrame,
    semantic: DataFrame | None = None,
) -> DataFrame:
    """``(source, report)``: summary, semantic part and footer.

    ``semantic`` holds ``(source, semantic)`` texts; sources without one get a
    note. None means that no analysis was asked for.
    """
    joined = summaries.join(metrics.select("source", "total_lines"), "source")
    parts = [F.col("summary")]
    if semantic is not None:
        joined = joined.join(semantic, "source", "left")
        parts.append(
            F.coalesce(F.concat(F.lit("\n"), F.col("semantic")), F.lit(w.NO_ANALYSIS))
        )
    footer = [F.lit(w.RULE), F.lit(w.DRILL_HINT), fill(w.STORED, "source", "total_lines")]
    return joined.select("source", F.concat_ws("\n", *parts, *footer).alias("report"))


def list_sources(metrics: DataFrame, analyses: DataFrame | None = None) -> DataFrame:
    """``(source, total_lines, unique_lines, errors, has_semantic)``."""
    listed_sources = metrics.select(
        "source", "total_lines", "unique_lines", (F.col("n_error") + F.col("n_fatal")).alias("errors")
    )
    if analyses is None:
        return listed_sources.withColumn("has_semantic", F.lit(False))
    known = analyses.select("source", F.lit(True).alias("has_semantic")).distinct()
    return listed_sources.join(known, "source", "left").withColumn(
        "has_semantic", F.coalesce("has_semantic", F.lit(False))
    )


def listing(sources: DataFrame) -> DataFrame:
    """``(source, text)``: one listing line per source."""
    mark = F.when(F.col("has_semantic"), "✓").otherwise("✗")
    return sources.select(
        "source",
        fill(w.LISTING, "source", "total_lines", "unique_lines", "errors", mark).alias("text"),
    )
