"""Stack traces as a scan over chunks.

A line is of one kind: S a stack line, I indented, X an exception line, E an
error or fatal line, N anything else. S opens a trace or joins the open one; I
joins the open trace; X and E join and close it; N closes it. Only the last
line that is not I decides whether a trace is open, so every chunk can be
grouped by itself (``trace_pieces``), leaving open only whether its first lines
continue a trace of an earlier chunk. That is settled with one row per chunk
(``resolve``). No task ever holds more than a chunk, however long a source or a
single trace may be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.functions.text import is_exception_line
from logsift.operators.lines import CHUNK_LINES, classify, with_chunk

# Lines of a trace held in one array value.
PART_LINES = 1_000


def trace_pieces(
    lines: DataFrame, chunk_lines: int = CHUNK_LINES, part_lines: int = PART_LINES
) -> DataFrame:
    """The possible traces of each chunk, in parts of at most ``part_lines`` lines.

    ``ord`` counts the traces started in the chunk; 0 holds the lines before the
    first one, which are members only if a trace is carried in. Every chunk has
    at least one row. Text is shuffled only for lines that may be members.
    """
    text, kind = F.col("cleaned"), F.col("kind")
    kinds = (
        F.when(F.col("is_stack"), "S")
        .when(F.startswith(text, F.lit(" ")) | F.startswith(text, F.lit("\t")), "I")
        .when(is_exception_line(text), "X")
        .when(F.col("severity").isin("error", "fatal"), "E")
        .otherwise("N")
    )
    chunk = Window.partitionBy("source", "chunk")
    ordered = chunk.orderBy("line_no")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    is_s = F.when(kind != "I", kind == "S")
    is_open = F.col("is_open")
    line = F.struct((F.col("within") % part_lines).alias("i"), "line_no", "text")
    may_join = kind.isin("I", "X", "E") & F.coalesce(is_open, F.lit(True))
    return (
        with_chunk(classify(lines), chunk_lines)
        .withColumn("kind", kinds)
        .select(
            "source",
            "chunk",
            "line_no",
            "kind",
            F.when(kind == "E", F.col("severity")).alias("severity"),
            F.when(kind != "N", text).alias("text"),
        )
        .withColumns(
            {
                "is_open": F.last(is_s, ignorenulls=True).over(earlier),
                "row": F.row_number().over(ordered),
                "ends_open": F.last(is_s, ignorenulls=True).over(whole),
                "begins_s": F.first(is_s, ignorenulls=True).over(whole),
            }
        )
        .withColumn("starts", (kind == "S") & ~F.coalesce(is_open, F.lit(False)))
        .withColumns(
            {
                "ord": F.coalesce(F.count_if("starts").over(so_far), F.lit(0)),
                "n_starts": F.count_if("starts").over(whole),
                "start": F.last(
                    F.when(F.col("starts"), F.struct("row", "line_no")), ignorenulls=True
                ).over(so_far),
                "member": (kind == "S") | may_join,
            }
        )
        .filter(F.col("member") | (F.col("row") == 1))
        .withColumn("within", F.col("row") - F.coalesce(F.col("start.row"), F.lit(1)))
        .groupBy(
            "source", "chunk", "ord", F.floor(F.col("within") / part_lines).alias("part")
        )
        .agg(
            F.count_if("member").alias("n"),
            F.first("start.line_no").alias("start"),
            F.max(F.when(F.col("member"), F.col("severity"))).alias("severity"),
            F.array_sort(F.collect_list(F.when(F.col("member"), line))).alias("lines"),
            F.first("n_starts").alias("n_starts"),
            F.first("ends_open").alias("ends_open"),
            F.coalesce(F.first("begins_s"), F.lit(False)).alias("begins_s"),
        )
    )


def with_every_source(pieces: DataFrame, sources: DataFrame) -> DataFrame:
    """Add an empty piece for sources without any, so that a store replaces their old ones."""
    missing = sources.select("source").join(pieces.select("source"), "source", "left_anti")
    empty = {"chunk": 0, "ord": 0, "part": 0, "n": 0, "n_starts": 0, "begins_s": False}
    columns = [
        F.lit(empty.get(f.name)).cast(f.dataType).alias(f.name)
        for f in pieces.schema.fields
        if f.name != "source"
    ]
    return pieces.unionByName(missing.select("source", *columns))


def ends_only(pieces: DataFrame) -> DataFrame:
    """The pieces with no more lines than a trace summary can show."""
    near_end = F.filter("lines", lambda at: (at["i"] < 2) | (at["i"] >= F.col("n") - 2))
    return pieces.withColumn("lines", near_end)


def chunk_states(pieces: DataFrame) -> DataFrame:
    """One row per chunk: the trace carried into it and the traces started before.

    ``carry`` tells whether a trace is open at its start, ``carry_header`` and
    ``carry_lines`` describe that trace, ``ids_before`` counts the traces
    started in earlier chunks and ``new`` those started here.
    """

    def lines_in(test):
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))

    ordinal = F.col("ord")
    chunks = pieces.groupBy("source", "chunk").agg(
        F.first("ends_open").alias("ends_open"),
        F.first("begins_s").alias("begins_s"),
        F.first("n_starts").alias("n_starts"),
        lines_in(ordinal == 0).alias("n_lead"),
        lines_in(ordinal == 1).alias("n_first"),
        lines_in(ordinal == F.col("n_starts")).alias("n_last"),
        F.max("start").alias("last_start"),
    )

    order = Window.partitionBy("source").orderBy("chunk")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.withColumn(
        "carry", F.coalesce(F.last("ends_open", ignorenulls=True).over(earlier), F.lit(False))
    ).withColumn(
        # A stack line at the start of a chunk continues the carried trace.
        "new", F.col("n_starts") - (F.col("carry") & F.col("begins_s")).cast("long")
    )
    # Lines that this chunk adds to the trace that is the last one after it.
    continued = F.col("n_lead") + F.when(F.col("begins_s"), F.col("n_first")).otherwise(0)
    gain = F.when(F.col("new") > 0, F.col("n_last")).when(F.col("carry"), continued).otherwise(0)
    summed = carried.withColumn("gain", gain).withColumn(
        "sum_before", F.coalesce(F.sum("gain").over(earlier), F.lit(0))
    )
    opened = F.when(F.col("new") > 0, F.struct("last_start", "sum_before"))
    return summed.withColumns(
        {
            "ids_before": F.coalesce(F.sum("new").over(earlier), F.lit(0)),
            "opened": F.last(opened, ignorenulls=True).over(earlier),
        }
    ).select(
        "source",
        "chunk",
        "carry",
        "n_lead",
        "new",
        "ids_before",
        F.col("opened.last_start").alias("carry_header"),
        (F.col("sum_before") - F.col("opened.sum_before")).alias("carry_lines"),
    )


def resolve(
    pieces: DataFrame,
    part_lines: int = PART_LINES,
    first: int | None = None,
    states: DataFrame | None = None,
) -> DataFrame:
    """Join pieces to traces across chunks, perhaps only the ``first`` ones of each source.

    One row per piece: ``source, trace_id, header_line, before, n, severity,
    lines``; ``before`` counts the trace's lines ahead of this piece. ``states`` are the
    ``chunk_states`` of the pieces, if they exist already.
    """
    states = (chunk_states(pieces) if states is None else states).drop("new")
    if first is not None:
        # Few chunks hold the first traces; the others need not be joined.
        states = states.filter(F.col("ids_before") <= first)
    ordinal = F.col("ord")
    lead = (ordinal == 0) | ((ordinal == 1) & F.col("begins_s"))
    goes_on = F.col("carry") & lead
    shift = (F.col("carry") & F.col("begins_s")).cast("long")
    in_piece = F.col("part") * part_lines
    ahead = F.when(ordinal == 1, F.col("n_lead")).otherwise(0)
    resolved = (
        pieces.filter(F.col("n") > 0)
        .join(states, ["source", "chunk"])
        .filter((ordinal > 0) | F.col("carry"))
        .select(
            "source",
            F.when(goes_on, F.col("ids_before"))
            .otherwise(F.col("ids_before") + ordinal - shift)
            .alias("trace_id"),
            F.when(goes_on, F.col("carry_header")).otherwise(F.col("start")).alias("header_line"),
            F.when(goes_on, F.col("carry_lines") + in_piece + ahead)
            .otherwise(in_piece)
            .alias("before"),
            "n",
            "severity",
            "lines",
        )
    )
    return resolved if first is None else resolved.filter(F.col("trace_id") <= first)


def resolved_pieces(
    lines: DataFrame, chunk_lines: int = CHUNK_LINES, part_lines: int = PART_LINES
) -> DataFrame:
    """``resolve`` straight from lines; it reads the pieces twice, so large ones are better
    written out first (see ``plans/staging.py``)."""
    return resolve(trace_pieces(lines, chunk_lines, part_lines), part_lines)


def trace_lines(resolved: DataFrame) -> DataFrame:
    """Every member line: ``(source, trace_id, header_line, pos, line_no, line)``."""
    return resolved.select(
        "source", "trace_id", "header_line", "before", F.explode("lines").alias("at")
    ).select(
        "source",
        "trace_id",
        "header_line",
        (F.col("before") + F.col("at.i") + 1).alias("pos"),
        F.col("at.line_no").alias("line_no"),
        F.col("at.text").alias("line"),
    )


def _totals(resolved: DataFrame) -> DataFrame:
    """``(source, trace_id, header_line, n_lines, fatal)``, combined before the shuffle."""
    return resolved.groupBy("source", "trace_id", "header_line").agg(
        F.sum("n").alias("n_lines"),
        F.max(F.when(F.col("severity") == "fatal", 1).otherwise(0)).alias("fatal"),
    )


def stack_traces(resolved: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """Whole traces: ``(source, trace_id, header_line, part, n_parts, part_lines, n_lines, lines)``.

    A trace longer than ``part_lines`` continues in rows with ``part`` 1, 2, ...;
    ``n_lines`` and ``n_parts`` are those of the whole trace, ``part_lines`` counts the
    lines of the row.
    """
    key = ["source", "trace_id", "header_line"]
    part = F.floor((F.col("pos") - 1) / part_lines).alias("part")
    parts = (
        trace_lines(resolved)
        .groupBy(*key, part)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("members"))
    )
    return parts.join(_totals(resolved).select(*key, "n_lines"), key).select(
        *key,
        "part",
        F.ceil(F.col("n_lines") / part_lines).alias("n_parts"),
        F.size("members").cast("bigint").alias("part_lines"),
        "n_lines",
        F.col("members.line").alias("lines"),
    )


def trace_text(resolved: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """The text of each trace, in parts as ``stack_traces``."""
    shown = stack_traces(resolved, part_lines)
    return shown.withColumn("text", F.array_join("lines", "\n")).drop("lines")


def trace_summaries(resolved: DataFrame) -> DataFrame:
    """One row per trace: ``source, trace_id, header_line, n_lines, severity, summary``.

    Up to four lines are shown whole; of longer traces the first two and the last two. The
    totals of a trace are summed before the shuffle, and only pieces at its ends hand on
    lines, so neither rows nor arrays of one key grow with a trace.
    """
    key = ["source", "trace_id", "header_line"]
    total = F.col("n_lines")
    totals = _totals(resolved)
    # Known within a piece: only its first and last two lines can be shown.
    ends = F.transform(
        F.filter("lines", lambda at: (at["i"] < 2) | (at["i"] >= F.col("n") - 2)),
        lambda at: F.struct((F.col("before") + at["i"] + 1).alias("pos"), at["text"].alias("line")),
    )
    at_an_end = (F.col("before") < 4) | (F.col("before") + F.col("n") > total - 2)
    shown_ends = F.filter(
        F.col("ends"), lambda at: (total <= 4) | (at["pos"] <= 2) | (at["pos"] > total - 2)
    )
    shown = F.col("shown.line")
    cut = F.format_string("  ... (%d frames omitted)", total - 4)
    return (
        resolved.select(*key, "n", "before", ends.alias("ends"))
        .join(totals, key)
        .filter(at_an_end)
        .select(*key, "n_lines", "fatal", F.explode(shown_ends).alias("at"))
        .groupBy(*key, "n_lines", "fatal")
        .agg(F.array_sort(F.collect_list("at")).alias("shown"))
        .select(
            *key,
            "n_lines",
            F.when(F.col("fatal") == 1, "fatal").otherwise("error").alias("severity"),
            F.when(total <= 4, F.array_join(shown, "\n"))
            .otherwise(
                F.concat_ws("\n", F.slice(shown, 1, 2), cut, F.slice(shown, -2, 2))
            )
            .alias("summary"),
        )
    )


def first_traces(pieces: DataFrame, k: int, states: DataFrame | None = None) -> DataFrame:
    """Summaries of the first ``k`` traces of each source; ids count from 1 without gaps."""
    return trace_summaries(resolve(ends_only(pieces), first=k, states=states))


def trace_counts(states: DataFrame) -> DataFrame:
    """``(source, n_traces)`` of the sources that have traces, from ``chunk_states``."""
    total = F.max(F.col("ids_before") + F.col("new"))
    return (
        states.groupBy("source").agg(total.alias("n_traces")).filter(F.col("n_traces") > 0)
    )
