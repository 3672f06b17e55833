"""Following folders: streams into the store against what is stored at once."""

from __future__ import annotations

import os

import pytest

from logsift.plans.triage import Triage
from logsift.streaming.follow import follow
from logsift.sources.store import Store
from tests.test_store import PARTS, state


def put(folder, files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files:
        (folder / name).write_text(text)
        # Files arrive one after the other.
        os.utime(folder / name, (1_700_000_000 + int(name[0]) * 60,) * 2)


def run(triage, tmp_path, **options):
    follow(triage, f"{tmp_path}/in/*", f"{tmp_path}/checkpoint", **options).awaitTermination()


@pytest.mark.parametrize("at_once", [1, None])
def test_files_in_order_equal_one_ingest(spark, tmp_path, at_once):
    """A trace goes on over files; each file may be a batch of its own."""
    triage, whole = Triage(spark, f"{tmp_path}/store"), Triage(spark, f"{tmp_path}/whole")
    put(tmp_path / "in" / "a", [(f"{k}.log", part + "\n") for k, part in enumerate(PARTS)])
    run(triage, tmp_path, files_at_once=at_once)
    whole.ingest(log_text="\n".join(PARTS), label="a")
    assert state(triage) == state(whole)


def test_restart_goes_on_and_reads_new_files_only(spark, tmp_path):
    triage, whole = Triage(spark, f"{tmp_path}/store"), Triage(spark, f"{tmp_path}/whole")
    put(tmp_path / "in" / "a", [("0.log", PARTS[0]), ("1.log", PARTS[1])])
    put(tmp_path / "in" / "b", [("0.log", "INFO b")])
    run(triage, tmp_path)
    run(triage, tmp_path)
    assert triage.list_sources().count() == 2
    put(tmp_path / "in" / "a", [("2.log", "\n".join(PARTS[2:]))])
    run(triage, tmp_path)
    whole.ingest(log_text="\n".join(PARTS), label="a")
    whole.ingest(log_text="INFO b", label="b")
    assert state(triage) == state(whole)


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path, monkeypatch):
    """The stream dies after the store has the batch, before the checkpoint knows."""
    triage = Triage(spark, f"{tmp_path}/store")
    put(tmp_path / "in" / "a", [("0.log", PARTS[0])])
    add = Triage.add_lines

    def dies(self, lines, mark=None):
        add(self, lines, mark)
        raise RuntimeError("lost")

    monkeypatch.setattr(Triage, "add_lines", dies)
    with pytest.raises(Exception, match="lost"):
        run(triage, tmp_path)
    monkeypatch.setattr(Triage, "add_lines", add)
    run(triage, tmp_path)
    assert triage._stored("lines", "a").count() == 4
    assert len(triage.store.version().batches) == 1


def test_a_batch_that_fails_halfway_is_repeated(spark, tmp_path, monkeypatch):
    triage = Triage(spark, f"{tmp_path}/store")
    put(tmp_path / "in" / "a", [("0.log", PARTS[0])])
    publish = Store.publish

    def dies(self, *args, **kwargs):
        raise RuntimeError("lost")

    monkeypatch.setattr(Store, "publish", dies)
    with pytest.raises(Exception, match="lost"):
        run(triage, tmp_path)
    assert triage.list_sources().count() == 0
    monkeypatch.setattr(Store, "publish", publish)
    run(triage, tmp_path)
    assert sorted(r.line_no for r in triage._stored("lines", "a").collect()) == [1, 2, 3, 4]
