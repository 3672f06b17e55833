from __future__ import annotations

import os
import subprocess
import sys
import time

import pytest

from logsift.operators import templates as tp
from logsift.operators import traces as tr
from logsift.operators.lines import annotate
from logsift.plans import report
from logsift.plans.staging import parquet_stage, shared_folder


def _tables(lines):
    stage = parquet_stage(lines.sparkSession)
    lines = stage(annotate(lines), "lines")
    pieces = tr.ends_only(tr.trace_pieces(lines))
    return report.tables_of(lines, tp.line_groups(lines), pieces, stage)


@pytest.fixture
def big(lines_of):
    def name(i):
        return "".join(chr(97 + int(d)) for d in f"{i:03d}")

    errors = [f"ERROR: {name(i)}" for i in range(150)]
    unknown = [f"thing {name(i)}" for i in range(30)]
    often = [f"INFO {name(i)}" for i in range(30)] * 5
    traces = [line for i in range(12) for line in (f"    at f{i}", "[INFO] closes")]
    return lines_of(log="\n".join(errors + unknown + often + traces))


def test_summary_is_bounded(big):
    text = report.summary_report(_tables(big)).first().summary
    assert text.count("- [ERROR]") == 50
    assert "- [ERROR] : aaa" in text and "- [ERROR] : afa" not in text
    assert text.count("- [INFO]") == 20
    assert "### Stack Traces (12 found)" in text
    assert "**Trace 5** (line" in text and "**Trace 6**" not in text
    assert "\n\n... and 7 more traces\n" in text


def test_digest_is_bounded(big):
    text = report.analysis_digest(_tables(big)).first().digest
    assert text.startswith("Total lines: 354, Unique: 211, Noise removed: 0\n\nSeverity counts: {")
    assert '{"error": 150, "info": 162, "unknown": 42}' in text
    assert text.count("[ERROR ×1] ERROR: ") == 100
    assert "--- ERROR/WARNING/FATAL LINES (150 unique) ---" in text
    assert "--- STACK TRACES (12) ---\n\nTrace 1 (line 331):\n    at f0" in text
    assert "Trace 10 " in text and "Trace 11 " not in text
    assert "--- UNCLASSIFIED LINES (sample of 20) ---\nthing aaa\n" in text
    assert text.count("\nthing ") == 20


def test_digest_of_a_quiet_log(lines_of):
    lines = lines_of(log="2024-01-15T10:00:00 INFO a\n2024-01-15T10:00:30 INFO a")
    text = report.analysis_digest(_tables(lines)).first().digest
    assert text == (
        "Total lines: 2, Unique: 1, Noise removed: 0\n"
        "Time range: 2024-01-15T10:00:00 → 2024-01-15T10:00:30\n"
        '\nSeverity counts: {"info": 2}'
    )


def test_ingest_report_without_semantic_part(lines_of):
    tables = _tables(lines_of(log="ERROR x"))
    summaries = report.summary_report(tables)
    text = report.ingest_report(summaries, tables.metrics).first().report
    assert "No analysis" not in text
    assert text.endswith("📋 **Source**: `log` (1 lines stored)")
    (line,) = report.listing(report.list_sources(tables.metrics)).collect()
    assert line.text == "- **log**: 1 lines, 1 unique, 1 errors, semantic=✗"


def test_stage_writes_to_the_shared_folder(spark):
    staged = parquet_stage(spark)(spark.range(3).toDF("n"), "numbers")
    assert staged.count() == 3
    assert all(shared_folder(spark) in f for f in staged.inputFiles())


def test_scratch_folders_go_with_the_jvm(tmp_path):
    """Run in a JVM of its own: what was staged is gone after it."""
    code = (
        "from pyspark.sql import SparkSession\n"
        "from logsift.plans.staging import parquet_stage, scratch_folder\n"
        f"s = SparkSession.builder.master('local[1]').config('spark.checkpoint.dir', '{tmp_path}')"
        ".config('spark.ui.enabled', 'false').getOrCreate()\n"
        "parquet_stage(s)(s.range(3), 'n')\n"
        "s.range(2).write.parquet(scratch_folder(s, 'x') + '/t')\n"
        "import os\n"
        f"names = sorted(n.split('-')[0] for n in os.listdir('{tmp_path}'))\n"
        "assert {'stage', 'x'} <= set(names), names\n"
        "s.stop()\n"
    )
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=repo, timeout=120)
    # The JVM removes them while it shuts down; Spark's own checkpoint folder stays.
    for _ in range(40):
        left = [p.name for p in tmp_path.iterdir() if p.name.split("-")[0] in ("stage", "x")]
        if not left:
            break
        time.sleep(0.25)
    assert not left


def test_patterns_run_once_per_report(spark):
    """All sections read lines that were annotated and written before."""
    from workload.queries import QUERIES

    for name in ("summary_report", "analysis_digest", "ingest_report"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
        text = plan.optimizedPlan().toString()
        assert "Traceback" not in text and "events" not in text.replace("user_id", "")
        exchanges = plan.executedPlan().toString().count("Exchange hashpartitioning")
        # Replies and their join come on top in the ingest report.
        assert exchanges <= (8 if name == "ingest_report" else 6)
