"""Appending to stored logs, versions of the store, and compaction."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from logsift.operators import templates as tp
from logsift.operators import traces as tr
from logsift.plans.triage import Triage
from logsift.sources.store import APPEND, ConcurrentWrite, Store, Version
from logsift.sources.text_column import lines_from_text

PARTS = [
    "2024-01-15 10:00:01 INFO start\n---\nTraceback (most recent call last):\n  File \"a.py\", line 1, in f",
    "    run()\n  File \"b.py\", line 2, in g",  # the trace goes on
    "ValueError: x\n2024-01-15 10:00:05 ERROR job 12345 failed\n    at a.B.c(D.java:1)",
    "    at a.B.d(D.java:2)\nCaused by: java.io.IOException: y\n    ... 3 more",
    "2024-01-15 10:00:09 ERROR job 67890 failed\n2024-01-15 10:00:09 INFO start",
]


@pytest.fixture
def triage(spark, tmp_path):
    return Triage(spark, str(tmp_path / "store"))


def lines(spark, **texts):
    return lines_from_text(spark.createDataFrame(list(texts.items()), "source string, text string"))


def state(triage, label=None):
    """Everything that is stored, but for how it is cut into chunks and pieces."""
    def of(rows):
        return rows if label is None else rows.where(F.col("source") == label)

    def sorted_rows(rows):
        return sorted(map(tuple, rows.collect()), key=str)

    traces = tr.trace_summaries(tr.resolve(triage._stored("pieces")))
    return (
        sorted_rows(of(triage._stored("lines").drop("chunk"))),
        sorted_rows(of(triage._stored("groups"))),
        sorted_rows(of(traces)),
        sorted_rows(of(triage.reports())),
        sorted_rows(of(triage.list_sources())),
    )


def test_five_appends_equal_one_ingest(spark, triage, tmp_path):
    for part in PARTS[:-1]:
        triage.add_lines(lines(spark, a=part))
    report = triage.append(log_text=PARTS[-1], label="a").collect()
    assert [r.source for r in report] == ["a"]
    triage.add_lines(lines(spark, b="INFO other"))
    whole = Triage(spark, str(tmp_path / "whole"))
    text = whole.ingest(log_text="\n".join(PARTS), label="a").first().report
    whole.store_lines(lines(spark, b="INFO other"))
    assert state(triage) == state(whole)
    assert report[0].report == text
    assert "Stack Traces (2 found)" in text


def test_append_touches_new_lines_only(spark, triage, tmp_path):
    triage.ingest(log_text="\n".join(PARTS[:3]), label="a")
    folder = tmp_path / "store" / "lines"
    before = {f: f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}
    batch = triage.add_lines(lines(spark, a=PARTS[3]))
    assert {f: f.stat().st_mtime_ns for f in folder.rglob("*.parquet") if f in before} == before
    new = spark.read.parquet(f"{folder}/batch={batch}")
    assert sorted(r.line_no for r in new.collect()) == [10, 11, 12]


def test_append_after_append_to_many_sources(spark, triage, tmp_path):
    texts = [(f"s{i}", "\n".join(f"INFO {i} {k}" for k in range(i + 1))) for i in range(40)]
    for _ in range(3):
        triage.add_lines(lines_from_text(spark.createDataFrame(texts, "source string, text string")))
    whole = Triage(spark, str(tmp_path / "whole"))
    thrice = [(s, "\n".join([t] * 3)) for s, t in texts]
    whole.store_lines(lines_from_text(spark.createDataFrame(thrice, "source string, text string")))
    assert state(triage) == state(whole)


def test_replace_after_append_and_append_after_replace(spark, triage, tmp_path):
    for part in PARTS[:3]:
        triage.add_lines(lines(spark, a=part))
    triage.store_lines(lines(spark, a="INFO new"))
    assert triage._stored("lines", "a").count() == 1
    triage.add_lines(lines(spark, a="INFO more\nINFO most"))
    assert sorted(r.line_no for r in triage._stored("lines", "a").collect()) == [1, 2, 3]
    assert triage.get_lines_text("a", around_line=99).startswith("Lines 94-3 ")


def test_append_makes_an_analysis_old(spark, triage):
    triage.ingest(log_text="ERROR x", label="a")
    triage.add_replies(spark.createDataFrame([("a", '{"primary_issue": "db"}')], "source string, reply string"))
    assert "db" in triage.get_analysis("a")
    triage.append(log_text="ERROR y", label="a")
    assert triage.get_analysis("a").startswith("No analysis")


def test_append_of_nothing_and_of_a_new_source(spark, triage):
    triage.add_lines(lines(spark, a="INFO one").where("false"))
    assert triage.list_sources().count() == 0
    triage.append(log_text="INFO one", label="a")
    assert triage.list_sources().first().total_lines == 1
    with pytest.raises(ValueError, match="empty"):
        triage.append(log_text="  ", label="a")


# -- versions ------------------------------------------------------------------


def test_ten_ingests_leave_one_live_batch(spark, triage, tmp_path):
    for k in range(10):
        triage.store_lines(lines(spark, a=f"INFO {k}\nERROR {k}"))
    assert len(triage.store.version().batches) == 10
    before = state(triage)
    triage.compact()
    assert len(triage.store.version().batches) == 1 and state(triage) == before
    removed = triage.store.vacuum()
    assert len(removed) == 9 and state(triage) == before
    for table in ("lines", "groups", "pieces", "batches"):
        assert len(list((tmp_path / "store" / table).iterdir())) == 1
    assert triage.store.versions() == [11]


def test_compaction_merges_appends_and_keeps_whole_batches(spark, triage):
    triage.store_lines(lines(spark, z="INFO apart"))
    apart = triage.store.version().batches[0][0]
    for part in PARTS:
        triage.add_lines(lines(spark, a=part))
    triage.store_lines(lines(spark, b="ERROR b", c="ERROR c"))
    triage.store_lines(lines(spark, c="ERROR again"))
    replies = [(s, f'{{"primary_issue": "of {s}"}}') for s in "abz"]
    for row in replies:
        triage.add_replies(spark.createDataFrame([row], "source string, reply string"))
    before = state(triage)
    assert "of b" in triage.get_analysis("b")
    version = triage.compact()
    names = [b for b, _ in version.batches]
    assert len(names) == 3 and apart in names  # z and the second c are whole
    assert state(triage) == before
    for label in "abz":
        assert f"of {label}" in triage.get_analysis(label)
    triage.store.vacuum()
    assert state(triage) == before
    assert triage.compact() == triage.store.version() and triage.store.version() == version
    triage.add_lines(lines(spark, a="INFO after"))
    assert triage.get_lines("a").agg(F.max("line_no")).first()[0] == 15


def test_compacting_an_empty_store(triage):
    assert triage.compact() == Version(0, ()) and triage.store.vacuum() == []


def test_old_versions_stay_readable_until_vacuum(spark, triage):
    triage.store_lines(lines(spark, a="INFO one"))
    first = triage.store.version().number
    triage.store_lines(lines(spark, a="INFO two\nINFO three"))
    old = Triage(spark, triage.store.root, at=first)
    assert [r.line for r in old.get_lines("a").collect()] == ["INFO one"]
    assert triage.get_lines("a").count() == 2
    triage.compact()
    triage.store.vacuum(keep=3)
    assert old.get_lines("a").count() == 1
    triage.store.vacuum()
    with pytest.raises(Exception, match="(?i)no such file|does not exist|filenotfound"):
        Triage(spark, triage.store.root, at=first)


def test_second_of_two_appends_fails(spark, triage, monkeypatch):
    triage.store_lines(lines(spark, a="INFO one"))
    other = Triage(spark, triage.store.root)
    write = Store.write

    def slow(self, df, table, batch):
        if self is triage.store and table == "lines":
            other.add_lines(lines(spark, a="INFO of the other"))
        return write(self, df, table, batch)

    monkeypatch.setattr(Store, "write", slow)
    with pytest.raises(ConcurrentWrite):
        triage.add_lines(lines(spark, a="INFO mine"))
    monkeypatch.setattr(Store, "write", write)
    assert [r.line for r in triage.get_lines("a").collect()] == ["INFO one", "INFO of the other"]
    triage.add_lines(lines(spark, a="INFO mine"))
    assert [r.line for r in triage.get_lines("a").collect()] == ["INFO one", "INFO of the other", "INFO mine"]


def test_writers_of_other_sources_both_succeed(spark, triage):
    other = Store(spark, triage.store.root)
    seen = triage.store.version()
    triage.add_lines(lines(spark, a="INFO a"))
    batch = other.new_batch()
    rows = spark.createDataFrame([("b", 1, 1, 0)], "source string, n_lines long, last_line long, last_chunk long")
    version = other.publish(rows, batch, APPEND, seen)
    assert version.number == 2 and len(version.batches) == 2
    assert sorted(r.source for r in triage.store.current().collect()) == ["a", "b"]


def test_a_taken_number_is_not_overwritten(spark, triage):
    triage.store_lines(lines(spark, a="INFO a"))
    assert triage.store._put(Version(1, ())) is False
    assert len(triage.store.version().batches) == 1


def test_compaction_fails_beside_another_writer(spark, triage, monkeypatch):
    for k in range(2):
        triage.store_lines(lines(spark, a=f"INFO {k}\nINFO two"))
    triage.store_lines(lines(spark, a="INFO a", b="INFO b"))
    triage.store_lines(lines(spark, a="INFO c"))
    other, publish = Triage(spark, triage.store.root), Store.publish

    def late(self, *args, **kwargs):
        monkeypatch.setattr(Store, "publish", publish)
        other.ingest(log_text="INFO late", label="late")
        return publish(self, *args, **kwargs)

    monkeypatch.setattr(Store, "publish", late)
    with pytest.raises(ConcurrentWrite):
        triage.compact()
    triage.compact()
    assert sorted(r.source for r in triage.list_sources().collect()) == ["a", "b", "late"]


def test_clock_that_runs_back_changes_nothing(spark, triage, monkeypatch):
    triage.store_lines(lines(spark, a="INFO one"))
    monkeypatch.setattr(time, "time_ns", lambda: 0)
    monkeypatch.setattr(time, "time", lambda: 0.0)
    triage.store_lines(lines(spark, a="INFO two"))
    assert [r.line for r in triage.get_lines("a").collect()] == ["INFO two"]


def test_vacuum_leaves_what_writers_have_put_down(spark, triage, tmp_path):
    triage.store_lines(lines(spark, a="INFO one"))
    batch = triage.store.new_batch()
    triage.store.write(lines(spark, a="INFO x"), "lines", batch)
    assert triage.store.vacuum() == []
    assert triage.store.vacuum(orphans=True) == [batch]
    assert triage.get_lines("a").count() == 1


def test_merged_groups_equal_groups_of_all(spark):
    whole = lines(spark, a="\n".join(PARTS), b="INFO 1\nINFO 2\nERROR 12345")
    parts = whole.withColumn("part", F.col("line_no") % 3)
    cut = [tp.line_groups(parts.where(F.col("part") == k).drop("part")) for k in range(3)]
    merged = tp.merged_groups(cut[0].union(cut[1]).union(cut[2]))
    groups = tp.line_groups(whole)
    assert merged.columns == groups.columns
    assert sorted(map(tuple, merged.collect()), key=str) == sorted(map(tuple, groups.collect()), key=str)
