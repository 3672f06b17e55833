from __future__ import annotations

import pytest

from logsift.operators import drill

TEXT = "\n".join(
    ["start", "\x1b[31mERROR\x1b[0m one", "", "ERROR two", "[x", "FATAL three", "end"]
)


@pytest.fixture
def lines(lines_of):
    return lines_of(log=TEXT, other="ERROR elsewhere")


def _numbers(df):
    return sorted(r.line_no for r in df.filter("source = 'log'").collect())


def test_filters(lines):
    assert _numbers(drill.grep_lines(lines, "error")) == [2, 4]
    assert _numbers(drill.grep_lines(lines, r"\x1b")) == [2]
    assert _numbers(drill.grep_lines(lines, "[")) == [2, 5]
    assert _numbers(drill.grep_lines(lines, "")) == [1, 2, 3, 4, 5, 6, 7]
    assert _numbers(drill.lines_by_severity(lines, "Error")) == [2, 4]
    assert _numbers(drill.lines_by_severity(lines, "unknown")) == [1, 3, 5, 7]
    assert _numbers(drill.lines_by_severity(lines, "loud")) == []


def test_first_matches(lines):
    two = drill.first_matches(lines, severity="error", max_lines=2)
    assert _numbers(two) == [2, 4]
    assert {(r.source, r.capped) for r in two.collect()} == {("log", True), ("other", False)}
    for bad in (0, 201):
        with pytest.raises(ValueError):
            drill.first_matches(lines, max_lines=bad)


def test_windows(lines):
    assert _numbers(drill.lines_around(lines, "log", 1, 2)) == [1, 2, 3]
    assert _numbers(drill.lines_around(lines, "log", 7, 1)) == [6, 7]
    assert _numbers(drill.lines_around(lines, "log", 60, 5)) == []
    for bad in ((0, 5), (1, 51), (1, -1)):
        with pytest.raises(ValueError):
            drill.lines_around(lines, "log", *bad)


def test_windows_around_many_hits(spark, lines):
    hits = spark.createDataFrame(
        [("log", 1), ("log", 1), ("log", 4), ("other", 1), ("none", 1)], "source string, line_no long"
    )
    rows = drill.lines_around_hits(lines, hits, 2).collect()
    got = sorted((r.source, r.center, r.line_no, r.is_center) for r in rows)
    assert got == [
        ("log", 1, 1, True), ("log", 1, 2, False), ("log", 1, 3, False),
        ("log", 4, 2, False), ("log", 4, 3, False), ("log", 4, 4, True), ("log", 4, 5, False),
        ("log", 4, 6, False), ("other", 1, 1, True),
    ]


def test_rendering(lines):
    matches = drill.first_matches(lines.filter("source = 'log'"), severity="error", max_lines=2)
    assert drill.render_matches(matches, 2).first().text == (
        "Found 2 matching lines (capped at 2 — increase max_lines for more):\n"
        "       2 | \x1b[31mERROR\x1b[0m one\n       4 | ERROR two"
    )
    window = drill.lines_around(lines, "log", 4, 1)
    assert drill.render_around(window, 4, 1).first().text == (
        "Lines 3-5 (centered on line 4):\n"
        "          3 | \n >>>      4 | ERROR two\n          5 | [x"
    )


def test_line_numbers_over_six_digits_are_whole(spark):
    from pyspark.sql import functions as F

    df = spark.range(1).select(F.lit(12345678).alias("n"), F.lit("x").alias("l"))
    assert df.select(drill.rendered(F.col("n"), F.col("l"))).first()[0] == "  12345678 | x"
