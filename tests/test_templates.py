from __future__ import annotations

import random

import pytest

from logsift.functions import catalogue as cat
from logsift.operators import templates as tp
from tests import plain
from workload.queries import QUERIES

def _metrics(lines):
    return {r.source: r for r in tp.source_metrics(lines).collect()}


def test_counts_of_small_logs(lines_of):
    got = _metrics(
        lines_of(
            ruled="----\n \n=====\n...\n\t\n\n",
            retried="err: lease 7 lost\nerr: lease 7 lost",
            mixed="fatal: a\nok\nok\nok\nok\nnotice b\ntrace c\nwarn d\nwarn e\nerr f",
            clocks="boot\n2031-02-03 04:05:06 up\nidle\n2031-02-03 09:00:00 down\nbye",
            stacked="job\n  at f (g.js:1)\n  at h (g.js:2)\n---\n",
        )
    )
    ruled, retried, mixed = got["ruled"], got["retried"], got["mixed"]
    assert (ruled.total_lines, ruled.unique_lines, ruled.noise_lines) == (6, 0, 6)
    assert (ruled.reduction_pct, ruled.first_ts, ruled.n_unknown) == (100.0, None, 0)
    assert (retried.total_lines, retried.unique_lines, retried.reduction_pct) == (2, 1, 50.0)
    levels = [mixed[f"n_{level}"] for level in ("fatal", "error", "warning", "info", "debug", "unknown")]
    assert levels == [1, 1, 2, 1, 1, 4] and (mixed.important, mixed.unclassified) == (4, 1)
    assert mixed.reduction_pct == 30.0
    assert (got["clocks"].first_ts, got["clocks"].last_ts) == (
        "2031-02-03 04:05:06", "2031-02-03 09:00:00",
    )
    # Stack lines are no unique lines, noise counts for the total; both add to the reduction.
    stacked = got["stacked"]
    assert (stacked.total_lines, stacked.unique_lines, stacked.reduction_pct) == (4, 1, 75.0)


def test_time_range_follows_lines_not_values(lines_of):
    lines = lines_of(a="2024-01-15T10:00:30 b\n2024-01-15T10:00:00 a", b="no time")
    got = {r.source: (r.first_ts, r.last_ts) for r in tp.time_range(lines).collect()}
    assert got == {"a": ("2024-01-15T10:00:30", "2024-01-15T10:00:00"), "b": (None, None)}


def test_deduplication(lines_of):
    lines = lines_of(
        ts="Mar  3 21:22:23 poll\nMar  3 21:22:53 poll\nMar 14 00:00:00 poll",
        ids="txn 01234567-89ab-cdef-0123-456789abcdef at 0xfe\ntxn FEDCBA98-7654-3210-fedc-ba9876543210 at 0x1",
        ansi="\x1b[35mnotice\x1b[0m spool 4711",
        level="Mar 12 10:30:45 gc\nERR 12 10:30:45 gc",
    )
    got = {r.source: r for r in tp.dedup_templates(lines).collect()}
    assert len(got) == 4
    assert (got["ts"].n, got["ts"].sample) == (3, "Mar  3 21:22:23 poll")
    assert (got["ids"].n, got["ids"].template) == (2, "txn <UUID> at <ADDR>")
    assert (got["ansi"].sample, got["ansi"].template) == ("notice spool 4711", "notice spool <NUM>")
    assert (got["level"].template, got["level"].sample) == ("<TS> gc", "Mar 12 10:30:45 gc")
    assert (got["level"].n, got["level"].severity) == (2, "error")


@pytest.mark.parametrize("build", ["dedup_templates", "source_metrics", "time_range", "list_sources"])
def test_no_sort_of_lines(spark, build):
    """Lines are aggregated by hash, and the few texts that are shown are joined by broadcast."""
    found = QUERIES[build](spark, "/root/testdata/sf0.001")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortAggregate" not in plan and "Sort [" not in plan


def test_line_groups_hash(spark, lines_of):
    plan = tp.line_groups(lines_of(a="x"))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("HashAggregate") == 2 and "Sort" not in plan


def test_random_logs_with_one_hot_source(spark):
    rng = random.Random(11)
    shapes = ["INFO tick {n}", "ERROR boom {n}", "plain", "    at f{n}", "", "warn {n} 0xFF", "ERR 12 10:30:45 x",
              "Jan 12 10:30:45 x"]
    logs = {
        f"s{i}": [rng.choice(shapes).format(n=rng.randint(900, 1100)) for _ in range(size)]
        for i, size in enumerate([3_000, 1, 2, 40, 200])
    }
    rows = [(s, n, line) for s, ls in logs.items() for n, line in enumerate(ls, 1)]
    rng.shuffle(rows)
    lines = spark.createDataFrame(rows, "source string, line_no long, line string")
    got = {
        (r.source, r.template): [r.sample, r.n, r.severity, r.first_line]
        for r in tp.dedup_templates(lines).collect()
    }
    expected = {(s, t): e for s, ls in logs.items() for t, e in plain.templates(ls).items()}
    assert got == expected

    metrics = _metrics(lines)
    for source, ls in logs.items():
        texts = [t for t in map(plain.clean, ls) if not plain.noise(t)]
        row = metrics[source]
        assert (row.total_lines, row.noise_lines) == (len(ls), len(ls) - len(texts))
        assert row.unique_lines == len(plain.templates(ls))
        for level in cat.LEVELS:
            assert row[f"n_{level}"] == sum(plain.severity(t) == level for t in texts)


def test_first_templates_are_by_appearance(lines_of):
    text = "\n".join([*(f"ERROR e{c}" for c in "zyxwv"), *["INFO often"] * 5, *["INFO few"] * 4])
    lines = lines_of(log=text)
    templates = tp.templates_of(tp.line_groups(lines))
    important = tp.with_samples(tp.important_templates(templates, 3), lines).orderBy("pos").collect()
    assert [r.sample for r in important] == ["ERROR ez", "ERROR ey", "ERROR ex"]
    frequent = tp.with_samples(tp.high_frequency_templates(templates), lines)
    assert [r.sample for r in frequent.collect()] == ["INFO often"]
    assert tp.unknown_templates(templates).collect() == []


def test_severity_breakdown_leaves_out_zeros(lines_of):
    metrics = tp.source_metrics(lines_of(log="plain\nERROR x\nFATAL y\nplain"))
    rows = tp.severity_breakdown(metrics).orderBy("pos").collect()
    assert [(r.severity, r.n) for r in rows] == [("fatal", 1), ("error", 1), ("unknown", 2)]
