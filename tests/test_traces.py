from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from logsift.operators import traces as tr
from logsift.plans.staging import parquet_stage
from tests import plain

ALPHABET = [
    "    at a.B.c(B.java:1)", "Traceback (most recent call last):", '  File "x.py", line 1',
    "    indented code", "\tindented", "KeyError: 'x'", "WARN: x", "2024 ERROR boom",
    "FATAL boom now", "plain line", "[WARN] slow", "panic: x", "", "---",
]


def _logs(count, seed, longest):
    rng = random.Random(seed)
    return {
        f"log{i}": [
            rng.choices(ALPHABET, weights=[4, 1, 3, 4, 1, 1, 1, 1, 1, 2, 1, 1, 2, 1])[0]
            for _ in range(rng.randint(1, longest))
        ]
        for i in range(count)
    }


def _frame(spark, logs):
    rows = [(s, n, line) for s, ls in logs.items() for n, line in enumerate(ls, 1)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "source string, line_no long, line string")


def _expected(logs):
    return {
        (source, i): trace
        for source, lines in logs.items()
        for i, trace in enumerate(plain.traces(lines), 1)
    }


@pytest.mark.parametrize("chunk, part", [(3, 2), (7, 1_000), (20, 3), (10**6, 1_000), (1, 1)])
def test_equal_to_a_walk_over_the_lines(spark, chunk, part):
    logs = _logs(250, seed=chunk, longest=60)
    expected = _expected(logs)
    pieces = tr.trace_pieces(_frame(spark, logs), chunk, part).cache()
    resolved = tr.resolve(pieces, part).cache()

    summaries = {(r.source, r.trace_id): r for r in tr.trace_summaries(resolved).collect()}
    assert len(expected) > 300
    assert summaries.keys() == expected.keys()
    for key, (header, texts, severity) in expected.items():
        got = summaries[key]
        assert (got.header_line, got.n_lines, got.severity, got.summary) == (
            header, len(texts), severity, plain.trace_summary(texts),
        )

    short = tr.trace_summaries(tr.resolve(tr.ends_only(pieces), part)).collect()
    assert sorted(short) == sorted(summaries.values())
    if part == tr.PART_LINES:
        first = tr.first_traces(pieces, 2).collect()
        assert sorted(first) == sorted(r for k, r in summaries.items() if k[1] <= 2)

    members = tr.trace_lines(resolved).orderBy("source", "trace_id", "pos").collect()
    by_trace = {}
    for r in members:
        by_trace.setdefault((r.source, r.trace_id), []).append((r.pos, r.line))
    assert by_trace == {k: list(enumerate(t[1], 1)) for k, t in expected.items()}

    whole = {}
    for r in tr.stack_traces(resolved, part).orderBy("source", "trace_id", "part").collect():
        assert r.part_lines == len(r.lines) <= part
        total = len(expected[r.source, r.trace_id][1])
        assert (r.n_lines, r.n_parts) == (total, -(-total // part))
        whole.setdefault((r.source, r.trace_id), []).extend(r.lines)
    assert whole == {k: t[1] for k, t in expected.items()}

    counts = {r.source: r.n_traces for r in tr.trace_counts(tr.chunk_states(pieces)).collect()}
    assert counts == {
        s: n for s, lines in logs.items() if (n := len(plain.traces(lines)))
    }
    pieces.unpersist()
    resolved.unpersist()


def test_one_trace_over_many_chunks_stays_in_parts(spark):
    lines = spark.range(1, 5_001).select(
        F.lit("hot").alias("source"),
        F.col("id").alias("line_no"),
        F.concat(F.lit("    at f"), "id").alias("line"),
    )
    pieces = tr.trace_pieces(lines, chunk_lines=512, part_lines=100)
    assert pieces.agg(F.max(F.size("lines"))).first()[0] == 100
    resolved = tr.resolve(parquet_stage(spark)(pieces, "pieces"), 100)
    (row,) = tr.trace_summaries(resolved).collect()
    assert (row.trace_id, row.header_line, row.n_lines) == (1, 1, 5_000)
    assert row.summary == (
        "    at f1\n    at f2\n  ... (4996 frames omitted)\n    at f4999\n    at f5000"
    )
    parts = tr.trace_text(resolved, 1_000).orderBy("part").collect()
    assert [p.part for p in parts] == [0, 1, 2, 3, 4]
    assert {(p.n_parts, p.part_lines, p.n_lines) for p in parts} == {(5, 1_000, 5_000)}
    uneven = tr.trace_text(resolved, 2_300).orderBy("part").collect()
    assert [(p.n_parts, p.part_lines, p.n_lines) for p in uneven] == [
        (3, 2_300, 5_000), (3, 2_300, 5_000), (3, 400, 5_000),
    ]
    plan = tr.trace_summaries(resolved)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan.replace("partitionBy", "") or "trace_id" not in plan.split("Window")[1][:200]
    assert "\n".join(p.text for p in parts) == "\n".join(f"    at f{i}" for i in range(1, 5_001))


@pytest.mark.parametrize(
    "text, members, severity",
    [
        ("Traceback (x):\n\n  File \"a\"\nKeyError: 1", 3, "error"),
        ("    at a\n[WARN] slow\n    at b", None, None),
        ("    at a\nWARN: x", 2, "error"),
        ("    at a\npanic: x", 1, "error"),
        ("    at a\nFATAL boom now", 2, "fatal"),
        ("[ERROR] before\n    at a\n    at b\n    Caused by: c", 3, "error"),
    ],
)
def test_closing_rules(lines_of, text, members, severity):
    rows = tr.trace_summaries(tr.resolved_pieces(lines_of(log=text))).collect()
    if members is None:
        assert len(rows) == 2
    else:
        assert [(r.n_lines, r.severity) for r in rows] == [(members, severity)]


def test_trace_summary_length(lines_of):
    four = "\n".join(f"    at f{i}" for i in range(4))
    five = "\n".join(f"    at f{i}" for i in range(5))
    rows = tr.trace_summaries(tr.resolved_pieces(lines_of(four=four, five=five))).collect()
    got = {r.source: r.summary for r in rows}
    assert got["four"] == four
    assert got["five"] == (
        "    at f0\n    at f1\n  ... (1 frames omitted)\n    at f3\n    at f4"
    )
