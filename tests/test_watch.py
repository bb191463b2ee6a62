"""The streamed archive equals a full build, whatever happened to the files meanwhile."""

from __future__ import annotations

import os
import time

import pytest
import transcripts_fixture as fx
from sessionloom import ingest
from sessionloom.streaming import watch
from test_sync import CHILD, OTHER, ROOT, tables


def touched(path, rows, when):
    fx.write(path, rows)
    os.utime(path, (when, when))


def test_watch_follows_appends_new_files_and_truncation(spark, tmp_path):
    logs, out, kept = tmp_path / "logs", str(tmp_path / "archive"), str(tmp_path / "checkpoint")
    seen = []

    def look():
        query = watch.watch(spark, out, str(logs), checkpoint=kept, every=None, on_report=lambda batch, r: seen.append((batch, r)))
        query.awaitTermination()
        assert query.exception() is None

    touched(logs / "p.jsonl", ROOT, 1_700_000_000)
    touched(logs / "o.jsonl", OTHER, 1_700_000_000)
    look()
    # One file grows in place, one is new.
    touched(logs / "o.jsonl", [*OTHER, fx.user("more", fx.at(3), sessionId="o")], 1_700_000_100)
    touched(logs / "p" / "subagents" / "agent-k.jsonl", CHILD, 1_700_000_100)
    look()  # a new query from the same checkpoint
    # One is cut short.
    touched(logs / "p.jsonl", ROOT[:1], 1_700_000_200)
    look()
    look()
    assert [b for b, _ in seen] == sorted({b for b, _ in seen})
    assert [(r.ingested, r.skipped) for _, r in seen] == [(2, 0), (2, 1), (1, 2), (0, 3)]
    assert tables(ingest.load(spark, out)) == tables(ingest.build(spark, str(logs)))


def test_a_failed_batch_is_repeated(spark, tmp_path, monkeypatch):
    logs, out, kept = tmp_path / "logs", str(tmp_path / "archive"), str(tmp_path / "checkpoint")
    touched(logs / "o.jsonl", OTHER, 1_700_000_000)
    commit = ingest.store.Change.commit
    monkeypatch.setattr(ingest.store.Change, "commit", lambda self: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(Exception, match="lost"):
        watch.watch(spark, out, str(logs), checkpoint=kept, every=None).awaitTermination()
    monkeypatch.setattr(ingest.store.Change, "commit", commit)
    watch.watch(spark, out, str(logs), checkpoint=kept, every=None).awaitTermination()
    assert tables(ingest.load(spark, out)) == tables(ingest.build(spark, str(logs)))


def test_watch_goes_on_until_stopped(spark, tmp_path):
    logs, out, kept = tmp_path / "logs", str(tmp_path / "archive"), str(tmp_path / "checkpoint")
    touched(logs / "o.jsonl", OTHER, 1_700_000_000)
    seen = []
    query = watch.watch(spark, out, str(logs), checkpoint=kept, every=1, on_report=lambda batch, r: seen.append(r.ingested))
    until = time.time() + 90
    while len(seen) < 2 and time.time() < until:
        time.sleep(0.2)
    query.stop()
    assert seen[:2] == [1, 0]
    assert watch.refreshed(spark, out, str(logs)).session.count() == 1
    touched(logs / "n.jsonl", [fx.user("new", fx.at(5), sessionId="n")], 1_700_000_000)
    assert watch.refreshed(spark, out, str(logs), sync=False).session.count() == 1
    assert watch.refreshed(spark, out, str(logs)).session.count() == 2
