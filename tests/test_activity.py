"""Economics of hand-made sessions against sums worked out by hand."""

from __future__ import annotations

import os

import pytest
import transcripts_fixture as fx
from pyspark.sql import functions as F
from sessionloom import ingest, schema, store
from sessionloom.operators import activity as ac
from sessionloom.operators import lineage
from sessionloom.schema import Archive

T = "2024-05-01T10:00:{:02d}.000Z"


def archive(spark, sessions, messages, blocks, calls=()):
    """``sessions``: dicts; ``messages``: (session, seq, role, out, time); ``blocks``: (session,
    seq, ordinal, type, text, tool, input, result); ``calls``: (session, seq, tool, input,
    bytes, result seq, result ordinal)."""
    empty = lambda ddl: spark.createDataFrame([], ddl)

    def wide(rows, names, ddl):
        fields = [f.split()[0] for f in ddl.split(", ")]
        return spark.createDataFrame([tuple(dict(zip(names, r, strict=True)).get(f) for f in fields) for r in rows], ddl)

    s = spark.createDataFrame([tuple(x.get(f.split()[0]) for f in schema.SESSION.split(", ")) for x in sessions], schema.SESSION)
    m = wide(messages, ("session_id", "seq", "role", "output_tokens", "timestamp"), schema.MESSAGE)
    b = wide(blocks, ("session_id", "seq", "ordinal", "type", "text", "tool_name", "tool_input", "tool_result"), schema.BLOCK)
    c = wide(calls, ("session_id", "seq", "tool_name", "input", "output_bytes", "result_seq", "result_ordinal"), schema.TOOL_CALL)
    return Archive(empty(schema.PROJECT), s, m, b, c, empty(schema.FILE_REF), empty(schema.ISSUE), empty(schema.USER_STATE))


def by_bucket(df):
    return {r.bucket: r for r in df.collect()}


SESSION = {"id": 1, "tool": "claude_code", "output_tokens": 40, "input_tokens": 100, "cache_read_tokens": 20, "cache_creation_tokens": 0, "cost_in_nano": 6_000_000_000, "cost_out_nano": 2_000_000_000, "is_subagent": False}
MESSAGES = [(1, 0, "user", None, T.format(0)), (1, 1, "assistant", 30, T.format(10)), (1, 2, "tool", None, T.format(11)), (1, 3, "assistant", 10, T.format(31)), (1, 4, "user", None, T.format(51)), (1, 5, "assistant", None, "2024-05-01T11:00:00.000Z")]
BLOCKS = [
    (1, 0, 0, "text", "go", None, None, None),
    (1, 1, 0, "thinking", "x" * 100, None, None, None),
    (1, 1, 1, "text", "y" * 24, None, None, None),
    (1, 1, 2, "tool_use", None, "Read", '{"a": 1}', None),  # 4 + 1 + 8 bytes
    (1, 2, 0, "tool_result", None, None, None, "z" * 40),
    (1, 3, 0, "tool_use", None, "Edit", "{}", None),
    (1, 4, 0, "text", "thanks", None, None, None),
    (1, 5, 0, "text", "", None, None, None),
]
CALLS = [(1, 1, "Read", '{"a": 1}', 40, 2, 0), (1, 3, "Edit", "{}", None, None, None)]


def test_a_session_by_hand(spark):
    rows, summary = ac.activity(archive(spark, [SESSION], MESSAGES, BLOCKS, CALLS))
    got = by_bucket(rows)
    plan = 30 - (24 + 13) / 4
    assert got["planning"].generation == pytest.approx(plan) and got["planning"].generation_o == pytest.approx(plan)
    assert got["communicating"].generation == pytest.approx((30 - plan) * 24 / 37) and got["context"].generation == pytest.approx((30 - plan) * 13 / 37)
    # The edit begins the implementation.
    assert (got["code"].generation, got["code"].generation_o) == (10, 0)
    assert (got["context"].window, got["context"].window_o, got["context"].calls) == (10, 10, 1) and (got["code"].window, got["code"].calls) == (0, 1)
    # Ten seconds of the first reply by bytes; one of the result; twenty of the edit; then the user's; an hour is capped.
    assert got["planning"].ms == pytest.approx(10_000 * 100 / 137) and got["context"].ms == pytest.approx(10_000 * 13 / 137 + 1000)
    assert got["code"].ms == 20_000 and got["code"].ms_o == 0
    assert got["communicating"].ms == pytest.approx(10_000 * 24 / 137 + 300_000) and got["communicating"].ms_o == pytest.approx(10_000 * 24 / 137)
    assert summary.first().waiting_ms == 20_000 and summary.first().billed == 120

    out = by_bucket(ac.report(rows, summary))
    assert list(out) == [*schema.BUCKETS, "total"]
    total = out["total"]
    assert total.generation_tokens == sum(out[b].generation_tokens for b in schema.BUCKETS) and total.attributed_ms == total.active_ms + 20_000
    assert (total.input_cost_usd, total.output_cost_usd) == (6, 2) and total.estimated_cost_usd == pytest.approx(8)
    assert out["code"].estimated_cost_usd == pytest.approx(2 * 10 / 40 + 6 * 10 / 50) and out["code"].orientation_estimated_cost_usd == 0
    assert sum(out[b].cost_share for b in schema.BUCKETS) == pytest.approx(1)
    for n in ac._AMOUNTS[:1]:
        assert all(out[b][n] - out[b][f"orientation_{n}"] - out[b][f"implementation_{n}"] in (-1, 0, 1) for b in schema.BUCKETS)


def test_sums_of_sessions_without_message_usage(spark):
    sessions = [{"id": 2, "tool": "codex", "output_tokens": 100, "reasoning_tokens": 30}, {"id": 3, "tool": "codex", "output_tokens": 10, "reasoning_tokens": 0, "reasoning_estimate": 50}]
    messages = [(2, 0, "assistant", 99, None), (2, 1, "assistant", None, None)]
    blocks = [(2, 0, 0, "text", "a" * 30, None, None, None), (2, 0, 1, "thinking", "t" * 500, None, None, None), (2, 1, 0, "tool_use", None, "apply_patch", "x" * 58, None)]
    rows, summary = ac.activity(archive(spark, sessions, messages, blocks))
    got = {(r.session_id, r.bucket): r for r in rows.collect()}
    assert got[2, "planning"].generation == pytest.approx(30) and got[2, "planning"].generation_o == pytest.approx(9)
    assert got[2, "communicating"].generation == pytest.approx(21) and got[2, "code"].generation == pytest.approx(49) and got[2, "code"].generation_o == 0
    # No blocks: all of it is planning of the implementation.
    assert (got[3, "planning"].generation, got[3, "planning"].generation_o) == (10, 0) and summary.count() == 2


def test_billed_input_follows_the_window(spark):
    child = SESSION | {"id": 9, "parent_session_id": 1, "is_subagent": True, "input_tokens": 50, "cache_read_tokens": 0, "output_tokens": 0, "cost_in_nano": 0, "cost_out_nano": 0}
    a = archive(spark, [SESSION, child], MESSAGES, BLOCKS, CALLS)
    rows, summary = ac.activity(a)
    out = {(r.scope_id, r.bucket): r for r in ac.session_reports(rows, summary, lineage.closure(a.session, None)).collect()}
    # 40 generated and 10 of results; 120 billed for the one, 50 for the other, which has only context.
    assert out[1, "total"].context_window_tokens == pytest.approx(40 + 10 + 120 + 50, abs=2) and out[9, "context"].context_window_tokens == 50
    assert out[9, "context"].orientation_context_window_tokens == 50 and out[9, "context"].sessions == 1
    assert out[1, "code"].context_window_tokens == 10 + round(120 * 10 / 50)


def test_nothing(spark):
    rows, summary = ac.activity(archive(spark, [], [], []))
    assert rows.count() == 0 and ac.report(rows, summary).count() == 0


def test_kept_rows_are_made_again_where_stale(spark, tmp_path):
    logs, out, kept = tmp_path / "logs", str(tmp_path / "archive"), str(tmp_path / "kept")
    for i in range(5):
        fx.write(logs / f"s{i}.jsonl", [fx.user(f"go {i}", fx.at(i), sessionId=f"s{i}"), fx.reply([fx.text("done")], fx.at(i, 9), fx.usage(5, 7), request=f"r{i}", sessionId=f"s{i}")])
    ingest.sync(spark, out, str(logs))
    assert ac.refresh(spark, kept, out) == 5 and ac.refresh(spark, kept, out) == 0
    before = store.manifest(spark, kept)
    fx.write(logs / "s3.jsonl", [fx.user("go 3", fx.at(3), sessionId="s3"), fx.reply([fx.text("done")], fx.at(3, 9), fx.usage(5, 70), request="r3", sessionId="s3")])
    os.utime(logs / "s3.jsonl", (1_800_000_000, 1_800_000_000))
    ingest.sync(spark, out, str(logs))
    assert ac.refresh(spark, kept, out) == 1
    after = store.manifest(spark, kept)
    changed = {k for k, g in after.tables["activity"].items() if before.tables["activity"].get(k) != g}
    one = ingest.load(spark, out).session.where("source_session_id = 's3'").select(store.folder_of(F.col("id"), after.folders).alias("k")).first().k
    assert changed == {str(one)}
    rows, summary = ac.kept(spark, kept)
    built = ac.activity(ingest.load(spark, out))
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, built[0].collect())) and sorted(map(repr, summary.collect())) == sorted(map(repr, built[1].collect()))
    assert ac.refresh(spark, kept, out, version=3) == 5  # another version makes all anew
