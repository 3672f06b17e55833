from __future__ import annotations

import random

import pytest

from logsift.operators.lines import with_chunk
from logsift.plans.triage import Triage
from logsift.sources.files import read_log_files
from logsift.sources.store import BUCKETS, check_label
from logsift.sources.text_column import lines_from_text, rejected_sources


def _collected(lines):
    rows = lines.orderBy("source", "line_no").collect()
    got = {}
    for r in rows:
        got.setdefault(r.source, []).append((r.line_no, r.line))
    return got


TEXTS = {
    "crlf": "a\r\nb\rc\n",
    "odd": "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i",
    "leading": "\n\n  x\n\n",
    "none_at_end": "x\n\ny",
}


def test_text_is_cut_as_python_cuts_it(spark):
    texts = spark.createDataFrame(list(TEXTS.items()), "source string, text string")
    got = _collected(lines_from_text(texts))
    assert got == {s: list(enumerate(t.splitlines(), 1)) for s, t in TEXTS.items()}
    stripped = _collected(lines_from_text(texts, strip=True))
    assert stripped["leading"] == [(1, "x")]


def test_blank_texts_are_listed(spark):
    rows = [("a", "x"), ("b", " \n\t"), ("c", None), ("d", "")]
    texts = spark.createDataFrame(rows, "source string, text string")
    got = {r.source: r.reason for r in rejected_sources(texts).collect()}
    assert got == {"b": "empty input", "c": "no input", "d": "empty input"}
    assert set(_collected(lines_from_text(texts))) == {"a"}


def test_files_in_many_blocks(spark, tmp_path):
    rng = random.Random(2)
    expected = {}
    for name, count in [("a", 2_000), ("b", 1), ("c", 700), ("d", 3_000)]:
        path = tmp_path / f"{name}.log"
        breaks = ["\n", "\r\n"] if name != "c" else ["\n", "\x0b", "\r"]
        text = "".join(
            f"{i} " + "x" * rng.randint(0, 60) + rng.choice(breaks) for i in range(count)
        ) + "last"
        path.write_bytes(text.encode())
        expected[f"file:{path}"] = list(enumerate(text.splitlines(), 1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        lines = read_log_files(spark, f"{tmp_path}/*.log")
        assert lines.rdd.getNumPartitions() > 20
        assert _collected(lines) == expected
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_bytes_that_are_no_utf8(spark, tmp_path):
    raw = b"ok \xff\xfe bad\nlone \xc3\nsplit \xe2\x82\nfine \xe2\x82\xac\n"
    path = tmp_path / "bytes.log"
    path.write_bytes(raw)
    got = _collected(read_log_files(spark, str(path), "b"))["b"]
    assert [line for _, line in got] == raw.decode("utf-8", errors="replace").splitlines()


def test_bad_arguments(spark, tmp_path):
    with pytest.raises(ValueError, match="Neither was given"):
        read_log_files(spark, None)
    with pytest.raises(ValueError, match="File not found"):
        read_log_files(spark, str(tmp_path / "missing.log"))
    with pytest.raises(ValueError, match="single file"):
        read_log_files(spark, str(tmp_path), "label")
    for label in ("", "x" * 65):
        with pytest.raises(ValueError):
            check_label(label)


LOG = """2024-01-15 10:00:00 ERROR [db] failed
Traceback (most recent call last):
  File "a.py", line 1
KeyError: 'x'
---
[WARN] slow
[WARN] slow
2024-01-15 10:00:09 INFO done"""


@pytest.fixture
def triage(spark, tmp_path):
    return Triage(spark, str(tmp_path / "store"))


def test_session(spark, triage, tmp_path):
    path = tmp_path / "x.log"
    path.write_text(LOG)
    report = triage.ingest(file_path=str(path), label="17", enable_semantic=False).first()
    assert report.source == "17"
    assert report.report == (
        "## Log Preprocessing Summary\n- **Total lines**: 8\n"
        "- **Unique lines**: 4 (50.0% reduction)\n- **Noise removed**: 1\n"
        "- **Time range**: 2024-01-15 10:00:00 → 2024-01-15 10:00:09\n"
        "\n### Severity Breakdown\n- ERROR: 1\n- WARNING: 2\n- INFO: 1\n- UNKNOWN: 3\n"
        "\n### Stack Traces (1 found)\n\n**Trace 1** (line 2):\n```\n"
        "Traceback (most recent call last):\n  File \"a.py\", line 1\nKeyError: 'x'\n```\n"
        "\n### Error/Warning Lines (deduplicated)\n- [ERROR] [db] failed\n"
        "- [WARNING] slow (×2)\n\n---\n"
        "💡 **Raw lines**: `get_lines` takes a pattern, a severity or a line number.\n"
        "📋 **Source**: `17` (8 lines stored)"
    )
    other = triage.ingest(log_text="INFO other", file_path="/nowhere", label="other")
    assert "*No analysis is stored for this log." in other.first().report
    assert [r.line_no for r in triage.get_lines("17", pattern="slow").collect()] == [6, 7]
    assert triage.get_lines_text("17", around_line=99) == (
        "Lines 94-8 (centered on line 99):\n"
    )
    assert triage.get_lines_text("17", pattern="zzz") == (
        "No lines matched the filters (pattern='zzz', severity=None). Try broader filters."
    )
    assert triage.get_lines_text("17", severity="info").endswith(
        ":\n       8 | 2024-01-15 10:00:09 INFO done"
    )
    with pytest.raises(KeyError, match="Stored are 2: 17, other"):
        triage.get_lines("missing")

    assert triage.get_analysis("17").startswith("No analysis is stored")
    replies = [("17", '```json\n{"primary_issue": "db"}\n```'), ("other", "nothing"), ("x", "{}")]
    bad = triage.add_replies(spark.createDataFrame(replies, "source string, reply string"))
    assert {(r.source, r.reason) for r in bad.collect()} == {
        ("other", "not JSON"), ("x", "unknown source"),
    }
    assert triage.get_analysis("17") == '{\n  "primary_issue": "db"\n}'
    reports = {r.source: r.report for r in triage.reports().collect()}
    assert "**Primary Issue**: db" in reports["17"]
    assert "*No analysis is stored" in reports["other"]
    listed = {r.source: tuple(r)[1:] for r in triage.list_sources().collect()}
    assert listed == {"17": (8, 4, 1, True), "other": (1, 1, 0, False)}
    assert triage.listing_text() == (
        "Stored sources:\n\n- **17**: 8 lines, 4 unique, 1 errors, semantic=✓\n"
        "- **other**: 1 lines, 1 unique, 0 errors, semantic=✗"
    )
    assert triage.listing_text(most=1).endswith("semantic=✓\n... and 1 more")
    assert {r.source for r in triage.digests().collect()} == {"17", "other"}


def test_ingesting_again_replaces(triage):
    triage.ingest(log_text=LOG, label="a")
    triage.ingest(log_text=LOG, label="b")
    report = triage.ingest(log_text="---\n===", label="a").first().report
    assert "Stack Traces" not in report and "**Total lines**: 2" in report
    assert triage._stored("lines").filter("source = 'a'").count() == 2
    assert triage._stored("lines", "a").count() == 2
    kept = {r.source: r.report for r in triage.reports().collect()}
    assert "Stack Traces (1 found)" in kept["b"] and "Stack Traces" not in kept["a"]


def test_an_analysis_counts_for_its_log_only(spark, triage):
    def reply(text):
        triage.add_replies(spark.createDataFrame([("a", text)], "source string, reply string"))

    triage.ingest(log_text=LOG, label="a")
    reply('{"primary_issue": "db down"}')
    assert "db down" in triage.get_analysis("a")
    assert "db down" not in triage.ingest(log_text="INFO fine", label="a").first().report
    assert triage.get_analysis("a").startswith("No analysis")
    assert not triage.list_sources().first().has_semantic
    reply('{"primary_issue": "one"}')
    reply('{"primary_issue": "two"}')
    assert "two" in triage.get_analysis("a") and triage.list_sources().count() == 1
    reply("sorry")
    assert triage.get_analysis("a").startswith("No analysis")


def test_what_is_written_counts_only_once_published(triage):
    """A failure between the tables of an ingest leaves the old log in place."""
    triage.ingest(log_text=LOG, label="a")
    newer = lines_from_text(triage.spark.createDataFrame([("a", "x")], "source string, text string"))
    from logsift.operators.lines import annotate

    triage.store.write(annotate(newer), "lines", triage.store.new_batch())
    assert triage._stored("lines", "a").count() == 8


def test_empty_store(triage, spark):
    with pytest.raises(KeyError, match=r"Stored are 0: \(none\)"):
        triage.get_lines("a")
    with pytest.raises(KeyError):
        triage.get_analysis("a")
    assert triage.list_sources().columns == [
        "source", "total_lines", "unique_lines", "errors", "has_semantic",
    ]
    assert triage.list_sources().count() == triage.reports().count() == triage.digests().count() == 0
    assert triage.listing_text().startswith("No source is stored")
    bad = triage.add_replies(spark.createDataFrame([("a", "{}")], "source string, reply string"))
    assert [r.reason for r in bad.collect()] == ["unknown source"]


def test_stripped_text(triage):
    triage.ingest(log_text="\n \n ERROR x\nINFO y \n\n", label="a", strip=True)
    triage.ingest(log_text="\nERROR x", label="b")
    assert [(r.line_no, r.line) for r in triage.get_lines("a").collect()] == [(1, "ERROR x"), (2, "INFO y")]
    assert [r.line_no for r in triage.get_lines("b", severity="error").collect()] == [2]


def test_empty_input(triage, tmp_path):
    blank = tmp_path / "blank.log"
    blank.write_text(" \n\t\n")
    with pytest.raises(ValueError, match="empty"):
        triage.ingest(file_path=str(blank))
    with pytest.raises(ValueError, match="empty"):
        triage.ingest(log_text="  \n ")
    with pytest.raises(ValueError, match="Neither"):
        triage.ingest()


@pytest.mark.parametrize("path", ["{}", "{}/", "{}/*.log"])
def test_folder_is_stored_per_file(triage, tmp_path, path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for name in "ab":
        (folder / f"{name}.log").write_text(f"ERROR {name}\n")
    triage.ingest(file_path=path.format(folder))
    labels = sorted(r.source for r in triage.store.current().collect())
    assert labels == [f"file:{folder}/{n}.log" for n in "ab"]


def test_many_small_sources_take_few_folders(spark, triage, tmp_path):
    sources = spark.range(20_000).selectExpr("concat('s', id) AS source", "concat('INFO ', id) AS text")
    triage.ingest_lines(lines_from_text(sources))
    triage.ingest(log_text="ERROR again", label="s7")
    for table in ("lines", "groups", "pieces", "batches"):
        assert len(list((tmp_path / "store" / table).iterdir())) <= BUCKETS + 2
    with pytest.raises(KeyError, match=r"Stored are 20000: s0, s1, s10, .*list_sources"):
        triage.get_lines("missing")
    assert [r.line for r in triage.get_lines("s7").collect()] == ["ERROR again"]
    assert triage.list_sources().count() == 20_000


def test_stored_lines_are_read_by_bucket(triage):
    triage.ingest(log_text=LOG, label="a")
    triage.ingest(log_text=LOG, label="b")
    plan = triage.get_lines("a", severity="error")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(source,a)" in plan
    assert "InMemoryFileIndex(1 paths)" in plan


def test_compressed_file_becomes_many_chunks(spark, tmp_path, monkeypatch):
    import gzip

    from logsift.sources import files

    text = "\n".join(f"INFO {i}" for i in range(5_000))
    with gzip.open(tmp_path / "a.log.gz", "wt") as f:
        f.write(text)
    monkeypatch.setattr(files, "with_chunk", lambda df: with_chunk(df, 700))
    lines = read_log_files(spark, str(tmp_path / "a.log.gz"), "a")
    assert lines.select("chunk").distinct().count() == 8
    assert _collected(lines)["a"] == list(enumerate(text.splitlines(), 1))


def test_numbering_moves_no_text(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\ny\n")
    lines = read_log_files(spark, str(tmp_path / "a.log"), "a")
    lines.collect()
    plan = lines._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    for part in plan.split("Exchange hashpartitioning")[1:]:
        assert "line#" not in part.split("\n")[1]
