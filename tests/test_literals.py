"""The literal index: what a pattern needs, which runs it leaves out, equality with the full scan."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from logsift.operators import literals
from logsift.operators.drill import first_matches, grep_lines
from logsift.plans.triage import Triage


@pytest.mark.parametrize(
    ("pattern", "needed"),
    [
        ("timeout", [["timeout"]]),
        ("TimeOut=\\d+ms|retry limit", [["timeout="], ["retry limit"]]),
        ("a.b", None),
        ("(foo|barbar)baz", [["foo", "baz"], ["barbar", "baz"]]),
        ("(foo|ba)baz", [["foo", "baz"], ["baz"]]),
        ("foo|b", None),
        ("(?:conn)+ refused", [["conn", " refused"]]),
        ("(?:conn)* refused", [[" refused"]]),
        ("err[o]r", [["error"]]),
        ("err[oa]r", [["err"]]),
        (r"foo\bbar", [["foobar"]]),
        ("^start", [["start"]]),
        ("(?=.*pool)conn(?!x)ect", [["pool", "connect"]]),
        (r"(\w+)abc\1", [["abc"]]),
        ("[unclosed", [["[unclosed"]]),
        ("naïve text", [["ve text"]]),
        ("", None),
        (r"\d+", None),
        ("(a|b)(c|d)(e|f)xyz", [["xyz"]]),
        ("x{3}yyy", [["yyy"]]),
    ],
)
def test_required_literals(pattern, needed):
    assert literals.required_literals(pattern) == needed


def test_many_alternatives_need_nothing():
    assert literals.required_literals("|".join(f"{i}word" for i in range(80))) is None
    assert literals.required_literals("(" + "|".join(f"{i}word" for i in range(80)) + ")tail") == [["tail"]]


PIECES = ["error", "Timeout", "=", "5000", "ms", " ", "refused", "Σιγμα", "ſtate", "Key", "İd", "x", "日本", "ab"]


def random_lines(spark, seed, n=6_000):
    rng = random.Random(seed)
    rows = [(f"s{rng.randrange(3)}", k, "".join(rng.choices(PIECES, k=rng.randrange(7)))) for k in range(1, n + 1)]
    return spark.createDataFrame(rows, "source string, line_no long, line string")


def random_pattern(rng):
    atom = lambda: rng.choice([re.escape(rng.choice(PIECES)), r"\d+", ".", "[a-z]+", "state", "key", "id", r"\b", "err?or"])
    text = "".join(atom() for _ in range(rng.randint(1, 4)))
    return rng.choice([text, f"({text}|{atom()}{atom()})", f"(?:{text}){rng.choice('+*?')}{atom()}", f"{text}|{atom()}"])


def test_equals_the_full_scan_on_random_patterns(spark, monkeypatch):
    monkeypatch.setattr(literals, "RUN_LINES", 16)
    lines = random_lines(spark, 1).persist()
    grams = literals.line_grams(lines).persist()
    rng = random.Random(2)
    for k in range(30):
        monkeypatch.setattr(literals, "NAMED_RUNS", 200 if k % 2 else 0)
        pattern = random_pattern(rng)
        want = sorted(map(tuple, grep_lines(lines, pattern).collect()))
        assert sorted(map(tuple, literals.grep_indexed(lines, grams, pattern).collect())) == want, pattern
    lines.unpersist(), grams.unpersist()


def test_grams(spark):
    rows = [("a", 1, "Abcſd"), ("a", 999, "abcs"), ("a", 1_000, "xy"), ("b", 1, None), ("b", 2, ""), ("b", 3, "日本語x")]
    grams = literals.line_grams(spark.createDataFrame(rows, "source string, line_no long, line string"))
    assert sorted(map(tuple, grams.collect())) == [("a", 0, "abc"), ("a", 0, "bcs"), ("a", 0, "csd")]


def test_very_long_line(spark):
    rows = [("a", 1, "ab" * 200_000), ("a", 2_000, "needle in it")]
    lines = spark.createDataFrame(rows, "source string, line_no long, line string")
    grams = literals.line_grams(lines)
    assert literals.runs_with(grams, "NEEDLE").collect() == [("a", 2)]
    assert literals.runs_with(grams, "needle|zzz").collect() == [("a", 2)]
    assert literals.grep_indexed(lines, grams, "needle").count() == 1
    assert literals.grep_indexed(lines, grams, "nothing like it").count() == 0


def test_a_rare_pattern_and_a_window_read_few_rows(spark, tmp_path):
    """Of a stored log, only the row groups of runs that may match, or of a window, are read."""
    text = spark.range(1, 60_001).selectExpr(
        "'big' AS source", "0L AS chunk", "id AS line_no",
        "concat(IF(id = 31234, 'needle ', 'INFO '), repeat(md5(string(id)), 4)) AS line",
    )
    triage = Triage(spark, str(tmp_path / "store"), index=True)
    spark.conf.set("parquet.block.size", 1 << 18)
    spark.sparkContext._jsc.hadoopConfiguration().setInt("parquet.block.size", 1 << 18)
    try:
        triage.store_lines(text.coalesce(1))
    finally:
        spark.conf.unset("parquet.block.size")
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    found = triage.search("needle")
    rows = found.collect()
    assert [(r.source, r.line_no) for r in rows] == [("big", 31_234)]
    plan = found._jdf.queryExecution().executedPlan()
    read = _rows_read(spark, plan)
    assert 0 < read < 30_000
    window = triage.get_lines("big", around_line=45_000)
    assert sorted(r.line_no for r in window.collect()) == list(range(44_995, 45_006))
    assert 0 < _rows_read(spark, window._jdf.queryExecution().executedPlan()) < 30_000


def _rows_read(spark, plan):
    """Output rows of the scan of lines, from the plan's metrics."""
    text, total = [plan], 0
    while text:
        node = text.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            text.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            text.append(node.plan())
            continue
        if "Scan parquet" in node.nodeName():
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        text += [children.apply(k) for k in range(children.size())]
    return total


def test_search_of_a_session(spark, tmp_path, lines_of):
    triage = Triage(spark, str(tmp_path / "store"), index=True)
    triage.store_lines(lines_of(a="ERROR pool refused\nINFO fine", b="INFO refused\nINFO x"))
    plain = Triage(spark, str(tmp_path / "store"))  # a batch without an index is read whole
    plain.add_lines(lines_of(a="WARN refused again"))
    triage.add_lines(lines_of(b="WARN and refused"))
    want = sorted(map(tuple, first_matches(triage._stored("lines"), "REFUSED").collect()))
    assert sorted(map(tuple, triage.search("REFUSED").collect())) == want and len(want) == 4
    assert [r.line for r in triage.get_lines("a", pattern="refused").orderBy("line_no").collect()] == [
        "ERROR pool refused", "WARN refused again",
    ]
    assert triage.search("refused", severity="error").count() == 1
    before = sorted(map(tuple, triage.search("refused").collect()))
    triage.compact()
    triage.store.vacuum()
    assert sorted(map(tuple, triage.search("refused").collect())) == before
    assert triage.search("x$").count() == triage.search("").where(F.col("line").endswith("x")).count() == 1
