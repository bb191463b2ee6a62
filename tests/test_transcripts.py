"""Transcripts of both producers to the canonical tables."""

from __future__ import annotations

import pytest
import transcripts_fixture as fx
from sessionloom import ingest, schema
from sessionloom.sources import manifest, transcripts


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    path = tmp_path_factory.mktemp("logs")
    fx.write_all(path)
    return path


@pytest.fixture(scope="module")
def archive(spark, root):
    return ingest.build(spark, str(root), side_folders=(str(root),), index_files=(str(root / "second" / "session_index.jsonl"),))


@pytest.fixture(scope="module")
def sessions(archive):
    return {r.source_session_id: r for r in archive.session.collect()}


def rows(df, session, *order):
    return df.where(df.session_id == session.id).orderBy(*order).collect()


def test_tables_have_their_schemas(archive):
    for name, ddl in schema.TABLES.items():
        assert schema.drift(getattr(archive, name), ddl) == [], name


def test_first_producer_session(sessions):
    s = sessions["main"]
    assert (s.tool, s.title, s.cwd, s.git_branch, s.version) == ("claude_code", "Fix the failing login test", "/work/app", "main", "1.2.3")
    assert (s.started_at, s.ended_at, s.message_count) == (fx.at(0), fx.at(10, 14), 16)
    # r1 is billed once, r3's counts are no whole numbers.
    assert (s.input_tokens, s.output_tokens, s.cache_read_tokens, s.cache_creation_tokens, s.cache_creation_1h_tokens) == (17, 12, 100, 20, 8)
    assert s.model == "claude-opus-4-7" and (s.reasoning_effort, s.reasoning_effort_levels) == ("mixed", ["high", "5"])
    # The one thinking request: nine tokens less a quarter of 14 and 38 visible bytes.
    assert (s.reasoning_source, s.reasoning_estimate) == ("inferred", max(0, 9 - (14 + len('{"file_path":"/work/app/src/login.py"}')) // 4))
    assert s.cost_in_nano == 17 * 5000 + 100 * 500 + 12 * 6250 + 8 * 10000 and s.cost_out_nano == 12 * 25000
    assert (s.turn_count, s.error_count, s.interruption_count, s.compaction_count, s.sidechain_count) == (1, 1, 1, 1, 1)
    assert (s.agent_spawn_count, s.skill_count, s.command_count, s.thinking_count, s.thinking_bytes) == (1, 0, 1, 1, 3)
    assert s.active_seconds == 4 + 300 + 9
    assert (s.outcome, s.work_type) == ("abandoned", "debugging")
    assert (s.context_window_tokens, s.peak_context_tokens) == (1_000_000, 130)
    assert not s.is_subagent and s.root_source_session_id == "root-1"


def test_result_records_override_sums(sessions):
    s = sessions["totals"]
    assert (s.input_tokens, s.output_tokens, s.cache_read_tokens, s.cache_creation_tokens) == (50, 60, 70, 80)
    assert s.work_type == "feature" and s.outcome == "completed"


def test_subagents_find_their_spawner(sessions):
    s = sessions["agent-a7"]
    assert s.is_subagent and s.parent_session_id == sessions["main"].id
    assert (s.agent_id, s.agent_type, s.spawn_tool_use_id, s.spawn_depth, s.turn_count) == ("a7", "scout", "spawn-1", 1, 1)
    c = sessions["cx-child"]
    assert c.is_subagent and c.parent_session_id == sessions["cx-1"].id and c.is_archived
    assert (c.agent_id, c.agent_type, c.spawn_tool_use_id, c.spawn_depth) == ("scout", "explorer", "s1", 1)


def test_second_producer_session(sessions):
    s = sessions["cx-1"]
    assert (s.tool, s.title, s.cwd, s.model, s.version) == ("codex", "The deploy", "/work/app", "gpt-5.4", "9")
    # The last reading; its cached and written parts don't fit, so nothing was written.
    assert (s.input_tokens, s.output_tokens, s.cache_read_tokens, s.cache_creation_tokens, s.reasoning_tokens) == (50, 30, 150, 0, 12)
    assert (s.reasoning_source, s.reasoning_effort, s.context_window_tokens, s.peak_context_tokens) == ("reported", "medium", 272000, 90)
    assert s.message_count == 14 and s.compaction_count == 1
    assert s.work_type == "feature"  # the developer's text comes first and names nothing, a file was written


def test_first_producer_messages(archive, sessions):
    ms = rows(archive.message, sessions["main"], "seq")
    assert [m.role for m in ms] == ["user", "assistant", "assistant", "assistant", "tool", "assistant", "tool", "tool", "other", "other", "user", "system", "user", "user", "assistant", "user"]
    assert [m.seq for m in ms] == list(range(len(ms)))
    assert [m.output_tokens for m in ms if m.role == "assistant"] == [None, 9, None, 3, 0]
    assert ms[2].context_tokens == 130 and ms[11].is_boundary and ms[11].pre_tokens == 130 and ms[11].compact_trigger == "auto"
    assert [m.seq for m in ms if m.is_turn] == [0]


def test_second_producer_messages(archive, sessions):
    ms = rows(archive.message, sessions["cx-1"], "seq")
    assert [m.role for m in ms] == ["user", "user", "assistant", "assistant", "tool", "assistant", "tool", "assistant", "tool", "assistant", "tool", "assistant", "system", "assistant"]
    # The first reading goes to the call before the tool's row, the second is stopped by the system's.
    assert [(m.seq, m.input_tokens, m.cache_read_tokens) for m in ms if m.input_tokens is not None] == [(3, 60, 30)]
    assert ms[5].timestamp == "2024-05-01T10:30:06.500Z" and ms[6].timestamp == fx.at(30, 8)


def test_blocks(archive, sessions):
    bs = rows(archive.block, sessions["main"], "seq", "ordinal")
    assert [b.type for b in bs[:5]] == ["text", "thinking", "text", "tool_use", "tool_result"]
    assert bs[4].tool_result == 'line\n{"a":[true],"x":1}'
    cx = rows(archive.block, sessions["cx-1"], "seq")
    assert cx[2].text == "think" and cx[3].tool_input.startswith('"*** Begin Patch') and cx[4].tool_result == '{"a":1,"ok":true}'
    assert [b.type for b in cx].count("web_search") == 1 and len(cx) == 13  # an empty compaction has no block


def test_tool_calls(archive, sessions):
    calls = {c.tool_use_id: c for c in rows(archive.tool_call, sessions["main"], "seq")}
    assert (calls["u1"].duration_ms, calls["u1"].is_error, calls["u1"].has_result) == (1000, None, True)
    assert (calls["u2"].is_error, calls["u2"].input_bytes) == (True, len('{"file_path":"/elsewhere/b.RS","new_string":"é"}'.encode()))
    assert calls["u3"].output_preview == "clean" and not calls["spawn-1"].has_result and calls["spawn-1"].output_bytes is None
    cx = {c.tool_use_id: c for c in rows(archive.tool_call, sessions["cx-1"], "seq")}
    assert (cx["k1"].tool_name, cx["k1"].mcp_server, cx["k1"].mcp_tool, cx["k1"].input, cx["k1"].duration_ms) == ("mcp__docs__read__it", "docs", "read__it", '{"a":2,"b":1}', 1500)
    assert (cx["k2"].tool_name, cx["k2"].is_error, cx["k2"].output_preview) == ("mcp__docs__x", True, '{"Err":"gone"}')
    assert cx["p1"].is_error is None


def test_file_refs(archive, sessions):
    assert [(f.path, f.rel_path, f.ext, f.operation) for f in rows(archive.file_ref, sessions["main"], "seq")] == [("/work/app/src/login.py", "src/login.py", "py", "read"), ("/elsewhere/b.RS", None, "rs", "edit")]
    assert [(f.path, f.ext, f.operation) for f in rows(archive.file_ref, sessions["cx-1"], "nth")] == [("new.md", "md", "write"), ("a/.env", None, "delete")]


def test_issues(archive, sessions):
    found = sorted((i.code, i.line_no, i.error) for i in rows(archive.issue, sessions["main"], "code"))
    assert [(c, n) for c, n, _ in found] == [("duplicate_tool_result", None), ("orphan_tool_result", None), ("unknown_record_type", 19), ("unparsed_line", 17)]
    assert found[2][2] == 'unknown record type "mystery" on 2 line(s); kept as role "other"'
    assert [(i.code, i.error) for i in rows(archive.issue, sessions["cx-1"], "code")] == [("unknown_record_type", 'unknown record type "novel" on 1 line(s); ignored')]


def test_projects(archive):
    found = {p.path: p for p in archive.project.collect()}
    assert (found["/work/app"].name, found["/work/app"].is_worktree, found["/work/app"].root_source) == ("app", False, "self")
    assert (found["/work/.worktrees/x"].root_path, found["/work/.worktrees/x"].worktree_label, found["/work/.worktrees/x"].root_source) == ("/work", "x", "intree")


def test_listing_and_facts(spark, root):
    files = {r.path.rsplit("/", 1)[-1]: r for r in manifest.listing(spark, str(root)).collect()}
    assert set(files) == {"main.jsonl", "agent-a7.jsonl", "wrapper.jsonl", "totals.jsonl", "rollout-1.jsonl", "rollout-2.jsonl"}
    assert files["rollout-2.jsonl"].is_archived and files["rollout-1.jsonl"].tool == "codex"
    facts = {r.path.rsplit("/", 1)[-1]: r for r in manifest.content_facts(spark, str(root)).collect()}
    assert facts["wrapper.jsonl"].line_count == 2 and len(facts["wrapper.jsonl"].hash) == 64


def test_numbers_do_not_depend_on_how_files_are_split(spark, tmp_path):
    said = [fx.user(f"text {i} " + "x" * (i % 40), fx.at(i)) for i in range(60)]
    fx.write(tmp_path / "long.jsonl", said)
    body = (tmp_path / "long.jsonl").read_text().split("\n")
    (tmp_path / "long.jsonl").write_text("\n".join(x + ("\n  \nnot json" if i % 7 == 3 else "") for i, x in enumerate(body)))
    turn = {"type": "response_item", "timestamp": fx.at(1), "payload": {"type": "message", "role": "user", "content": []}}
    fx.write(tmp_path / "rollout-a.jsonl", [{"type": "session_meta", "payload": {"id": "one"}}, *[turn] * 40, {"type": "session_meta", "payload": {"id": "two"}}, turn])
    whole = lambda: sorted(tuple(r) for r in transcripts.parsed(spark, str(tmp_path))[0].select("path", "line_no", "seq", "type", "raw", "emitted", "source_session_id").collect())
    plain = whole()
    for n, (line, x) in enumerate((k, t) for k, t in enumerate((tmp_path / "long.jsonl").read_text().split("\n"), 1) if t.strip()):
        row = [r for r in plain if r[0].endswith("long.jsonl")][n]
        assert row[1] == line and (row[4] is not None) == (x == "not json")
    assert {r[6] for r in plain} == {"long", "two"}
    seqs = [r[2] for r in plain if r[0].endswith("long.jsonl") and r[5]]
    assert seqs == list(range(60))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        read = transcripts.lines(spark, str(tmp_path))
        assert read.select("path", "block_start").distinct().count() > 10
        assert whole() == plain
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
