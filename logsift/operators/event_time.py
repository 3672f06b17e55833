"""Event times: timestamps of log lines as points in time, the year of those that lack one found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.operators.lines import CHUNK_LINES, classify, with_chunk

# Month names as they stand in timestamps.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_CLOCK = r"(\d{2}):(\d{2}):(\d{2})"
#: For each timestamp format its pattern and what its groups are: year, month, day, clock.
_FORMATS = (
    (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_CLOCK}", "ymdHMS"),
    (rf"^(\d{{2}})/(\w{{3}})/(\d{{4}}):{_CLOCK}", "dbyHMS"),
    (rf"^\[?\w{{3}}\s+(\w{{3}})\s+(\d{{1,2}})\s+{_CLOCK}\s+(\d{{4}})", "bdHMSy"),
    (rf"^(\w{{3}})\s+(\d{{1,2}})\s+{_CLOCK}", "bdHMS"),
)
#: Months that lie so far apart on two neighbouring lines belong to different years.
HALF_A_YEAR = 6


def time_parts(ts_text: Column) -> Column:
    """A struct of year, month, day, hour, minute and second; null if no format fits.

    The year is null where the text has none. A month name that is none gives a null month.
    """
    names = F.array(*[F.lit(name.lower()) for name in MONTHS])

    def part(pattern: str, kinds: str, kind: str, alias: str) -> Column:
        wanted = {"m": "mb"}.get(kind, kind)
        at = next((k for k, c in enumerate(kinds, 1) if c in wanted), None)
        if at is None:
            return F.lit(None).cast("int").alias(alias)
        text = F.regexp_extract(ts_text, pattern, at)
        if kinds[at - 1] == "b":
            return F.nullif(F.array_position(names, F.lower(text)).cast("int"), F.lit(0)).alias(alias)
        return text.try_cast("int").alias(alias)

    chain = F
    fields = (("y", "year"), ("m", "month"), ("d", "day"), ("H", "hour"), ("M", "minute"), ("S", "second"))
    for pattern, kinds in _FORMATS:
        chain = chain.when(ts_text.rlike(pattern), F.struct(*[part(pattern, kinds, k, a) for k, a in fields]))
    return chain


def _turn(month: Column, before: Column) -> Column:
    """By how many years two neighbouring lines differ, told by their months alone."""
    gap = month - before
    return F.when(gap <= -HALF_A_YEAR, 1).when(gap >= HALF_A_YEAR, -1).otherwise(0)


def event_times(
    lines: DataFrame, last_year: int | None = None, chunk_lines: int = CHUNK_LINES, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``(source, chunk, line_no, ts_text, event_time, behind)`` of every line with a timestamp.

    Columns named in ``keep`` are carried along.

    Years are counted along the lines of a source: where the month falls back by half a year
    or more the year turns, where it jumps ahead as far, a line of the old year came late.
    A line that names its year fixes the count; a line without one takes the count of the last
    line before it that did, else of the first one after it, else the last line of the source
    is taken to be of ``last_year``. ``event_time`` is null where the text is no date, or no
    year is known. ``behind`` are the seconds by which a line is earlier than the latest line
    before it, 0 if it is not.

    A window runs over one chunk. What lies before and behind a chunk comes from one row per
    chunk, over which the only windows of a whole source run.
    """
    stamped = with_chunk(classify(lines), chunk_lines).where("ts_text is not null").select("source", "chunk", "line_no", "ts_text", *keep)
    parsed = stamped.withColumn("t", time_parts(F.col("ts_text"))).withColumn("month", F.col("t.month"))
    chunk = Window.partitionBy("source", "chunk").orderBy("line_no")
    upto, before = chunk.rowsBetween(Window.unboundedPreceding, 0), chunk.rowsBetween(Window.unboundedPreceding, -1)
    onward = chunk.rowsBetween(0, Window.unboundedFollowing)
    whole = chunk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = (
        parsed.withColumn("turn", _turn(F.col("month"), F.last("month", ignorenulls=True).over(before)))
        .withColumn("turns", F.sum("turn").over(upto))
        .withColumn("fixed", F.when(F.col("month").isNotNull(), F.col("t.year") - F.col("turns")))
        .withColumns(
            {
                "past": F.last("fixed", ignorenulls=True).over(upto),
                "ahead": F.first("fixed", ignorenulls=True).over(onward),
                "first_month": F.first("month", ignorenulls=True).over(whole),
                "last_month": F.last("month", ignorenulls=True).over(whole),
                "all_turns": F.sum("turn").over(whole),
                "first_fixed": F.first("fixed", ignorenulls=True).over(whole),
                "last_fixed": F.last("fixed", ignorenulls=True).over(whole),
            }
        )
    )
    ends = counted.groupBy("source", "chunk").agg(
        *[F.first(c).alias(c) for c in ("first_month", "last_month", "all_turns", "first_fixed", "last_fixed")]
    )
    order = Window.partitionBy("source").orderBy("chunk")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    seam = _turn(F.col("first_month"), F.last("last_month", ignorenulls=True).over(earlier))
    ends = ends.withColumn("seam", seam).withColumn(
        "base", F.coalesce(F.sum("all_turns").over(earlier), F.lit(0)) + F.sum("seam").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    states = ends.select(
        F.col("source").alias("s"),
        F.col("chunk").alias("c"),
        "base",
        F.last(F.col("last_fixed") - F.col("base"), ignorenulls=True).over(earlier).alias("carried"),
        F.first(F.col("first_fixed") - F.col("base"), ignorenulls=True).over(later).alias("coming"),
        F.last(F.col("base") + F.col("all_turns")).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("end"),
    )
    joined = counted.join(states, (F.col("source") == F.col("s")) & (F.col("chunk") == F.col("c")))
    base = F.col("base")
    count = F.coalesce(F.col("past") - base, "carried", F.col("ahead") - base, "coming", F.lit(last_year).cast("int") - F.col("end"))
    year = F.coalesce("t.year", count + base + F.col("turns")).cast("int")
    time = F.try_make_timestamp(year, F.col("t.month"), F.col("t.day"), F.col("t.hour"), F.col("t.minute"), F.col("t.second"))
    return _with_behind(joined.select("source", "chunk", "line_no", "ts_text", time.alias("event_time"), *keep), keep)


def _with_behind(timed: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Adds the seconds a line is behind the latest one before it, by chunk and chunk totals."""
    chunk = Window.partitionBy("source", "chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = timed.groupBy("source", "chunk").agg(F.max("event_time").alias("top"))
    tops = tops.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.max("top").over(order).alias("top_before"))
    joined = timed.withColumn("top", F.max("event_time").over(chunk)).join(
        tops, (F.col("source") == F.col("s")) & (F.col("chunk") == F.col("c"))
    )
    latest = F.greatest("top", "top_before")
    behind = F.greatest(F.unix_timestamp(latest) - F.unix_timestamp("event_time"), F.lit(0).cast("long"))
    behind = F.when(F.col("event_time").isNotNull(), F.coalesce(behind, F.lit(0).cast("long")))
    return joined.select("source", "chunk", "line_no", "ts_text", "event_time", behind.alias("behind"), *keep)


def event_ranges(timed: DataFrame) -> DataFrame:
    """``(source, first_event, last_event, timed_lines, late_lines, most_behind)`` from ``event_times``.

    Unlike ``time_range``, which shows the first and the last timestamp in line order, these
    are the earliest and the latest time.
    """
    return timed.groupBy("source").agg(
        F.min("event_time").alias("first_event"),
        F.max("event_time").alias("last_event"),
        F.count("event_time").alias("timed_lines"),
        F.count_if(F.col("behind") > 0).alias("late_lines"),
        F.max("behind").alias("most_behind"),
    )
