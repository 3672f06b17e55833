"""Drill-down into stored lines: filters, first matches, windows around lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.functions import catalogue as cat
from logsift.functions.dialect import user_match
from logsift.functions.text import detect_severity, strip_ansi
from logsift.plans import wording as w
from logsift.plans.sections import fill


#: Line numbers of a run, the grain at which windows around hits prune lines.
RUN_LINES = 1_000


def _check_range(name: str, value: int, low: int, high: int | None = None) -> None:
    if value < low or (high is not None and value > high):
        limit = f"at least {low}" if high is None else f"between {low} and {high}"
        raise ValueError(f"{name} must be {limit}, not {value}")


def grep_lines(lines: DataFrame, pattern: str | None) -> DataFrame:
    """Lines whose raw text matches ``pattern`` in any case; no pattern keeps all."""
    if not pattern:
        return lines
    return lines.filter(user_match(lines.sparkSession, F.col("line"), pattern))


def lines_by_severity(lines: DataFrame, severity: str | None) -> DataFrame:
    """Lines of one level, noise lines counting as unknown; no level keeps all."""
    if not severity:
        return lines
    stored = "severity" in lines.columns
    level = F.col("severity") if stored else detect_severity(strip_ansi(F.col("line")))
    return lines.filter(level == severity.lower())


def first_matches(
    lines: DataFrame,
    pattern: str | None = None,
    severity: str | None = None,
    max_lines: int = cat.DRILL_LINES,
) -> DataFrame:
    """The first ``max_lines`` matches of each source in line order.

    ``(source, line_no, line, capped)``; ``capped`` tells that the limit was
    reached. Each task keeps at most ``max_lines`` rows per source before the
    shuffle.
    """
    _check_range("max_lines", max_lines, 1, cat.DRILL_LINES_MAX)
    source = Window.partitionBy("source")
    return (
        lines_by_severity(grep_lines(lines, pattern), severity)
        .select("source", "line_no", "line")
        .withColumn("rank", F.row_number().over(source.orderBy("line_no")))
        .filter(F.col("rank") <= max_lines)
        .withColumn("capped", F.count("*").over(source) >= max_lines)
        .drop("rank")
    )


def lines_around(
    lines: DataFrame, source: str, line_no: int, context: int = cat.DRILL_CONTEXT
) -> DataFrame:
    """The lines of ``source`` at most ``context`` lines away from ``line_no``."""
    _check_range("line_no", line_no, 1)
    _check_range("context", context, 0, cat.DRILL_CONTEXT_MAX)
    near = F.col("line_no").between(line_no - context, line_no + context)
    return lines.filter((F.col("source") == source) & near).select(
        "source", "line_no", "line", (F.col("line_no") == line_no).alias("is_center")
    )


def lines_around_hits(
    lines: DataFrame, hits: DataFrame, context: int = cat.DRILL_CONTEXT
) -> DataFrame:
    """``lines_around`` for a table of ``(source, line_no)`` hits.

    Each hit becomes the line numbers it asks for, so the join is on
    ``(source, line_no)``: no key is hot and no row pair is tested in vain. Lines far
    from all hits are left out first, by runs of ``RUN_LINES`` line numbers: the
    distinct runs near hits are the smallest table there is, and once Spark
    broadcasts it, only text near hits is moved by the join.
    """
    _check_range("context", context, 0, cat.DRILL_CONTEXT_MAX)
    center = F.col("center")
    wanted = (
        hits.select("source", F.col("line_no").alias("center"))
        .distinct()
        .select(
            "source",
            "center",
            F.explode(F.sequence(F.greatest(center - context, F.lit(1)), center + context)).alias(
                "line_no"
            ),
        )
    )
    def run(name: str) -> Column:
        return F.expr(f"{name} div {RUN_LINES}")

    runs = wanted.select(F.col("source").alias("of"), run("line_no").alias("run")).distinct()
    in_run = (F.col("source") == F.col("of")) & (run("line_no") == F.col("run"))
    near = lines.join(runs, in_run, "left_semi")
    return near.join(wanted, ["source", "line_no"]).select(
        "source", "center", "line_no", "line", (F.col("line_no") == center).alias("is_center")
    )


def rendered(line_no: Column, line: Column) -> Column:
    """Line number, right-aligned to six places, and the line."""
    return F.format_string("  %6d | %s", line_no, line)


def rendered_context(line_no: Column, line: Column, is_center: Column) -> Column:
    """As ``rendered``, with a marker on the line asked for."""
    mark = F.when(is_center, F.lit(" >>> ")).otherwise(F.lit("     "))
    return F.format_string("%s%6d | %s", mark, line_no, line)


def render_matches(matches: DataFrame, max_lines: int = cat.DRILL_LINES) -> DataFrame:
    """``(source, text)``: header and lines of ``first_matches``, one text per source."""
    count = F.size("rows")
    header = F.concat(
        fill(w.MATCH_HEADER, count),
        F.when(count >= max_lines, fill(w.CAPPED, F.lit(max_lines))).otherwise(""),
        F.lit(":"),
    )
    line = F.struct("line_no", rendered(F.col("line_no"), F.col("line")).alias("text"))
    return (
        matches.groupBy("source")
        .agg(F.array_sort(F.collect_list(line)).alias("rows"))
        .select(
            "source", F.concat_ws("\n", header, F.array_join("rows.text", "\n")).alias("text")
        )
    )


def render_around(window: DataFrame, line_no: int, context: int = cat.DRILL_CONTEXT) -> DataFrame:
    """``(source, text)``: header and lines of ``lines_around``."""
    start = max(1, line_no - context)
    line = F.struct(
        "line_no",
        rendered_context(F.col("line_no"), F.col("line"), F.col("is_center")).alias("text"),
    )
    header = fill(w.WINDOW_HEADER, F.lit(start), F.max("line_no"), F.lit(line_no))
    return window.groupBy("source").agg(
        F.concat_ws(
            "\n", header, F.array_join(F.array_sort(F.collect_list(line))["text"], "\n")
        ).alias("text")
    )


def no_match(pattern: str | None, severity: str | None) -> str:
    """What is said when no line passes the filters."""
    return w.NO_MATCH.format(repr(pattern), repr(severity))


def empty_window(total: int, line_no: int, context: int) -> str:
    """The header alone, for a line number beyond the end of the log."""
    start = max(1, line_no - context)
    return w.WINDOW_HEADER.format(start, min(total, line_no + context), line_no) + "\n"
