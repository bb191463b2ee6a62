"""Scopes, pages and reports over small archives with a case of everything."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from sessionloom import schema
from sessionloom.operators import reads
from sessionloom.operators.reads import CallScope, Scope
from sessionloom.schema import Archive
from test_sessions import rows

CAVEAT = "<local-command-caveat>"


@pytest.fixture(scope="module")
def a(spark):
    project = [{"id": 1, "path": "/w/one", "name": "one"}, {"id": 2, "path": "/w/one-tree", "name": "tree", "is_worktree": True, "root_path": "/w/one"}, {"id": 3, "path": "/w/none", "name": "none"}]
    own = {"tool": "claude_code", "is_subagent": False}
    session = [
        {"id": 1, **own, "source_session_id": "s1", "project_id": 1, "model": "m", "title": "First", "started_at": "2024-05-01T10:00:00Z", "ended_at": "2024-05-01T11:00:00Z", "source_path": "/f1", "cost_nano": 5, "work_type": "fix", "turn_count": 3},
        {"id": 2, "tool": "claude_code", "is_subagent": True, "source_session_id": "s2", "project_id": 1, "parent_session_id": 1, "agent_type": "Explorer", "started_at": "2024-05-02T10:00:00Z", "cost_nano": 7},
        {"id": 3, "tool": "codex", "is_subagent": False, "source_session_id": "s3", "project_id": 2, "model": "n", "title": "Second", "started_at": "2024-05-02T10:00:00Z"},
        {"id": 4, **own, "source_session_id": "s4", "title": "No project", "started_at": None, "source_path": "/f4"},
        {"id": 5, **own, "source_session_id": "s5", "project_id": 1, "title": "Kept away", "started_at": "2024-05-03T10:00:00Z"},
        {"id": 6, "tool": "claude_code", "is_subagent": True, "source_session_id": "s6", "project_id": 1, "parent_session_id": 5, "title": "Below", "started_at": "2024-05-03T10:00:00Z"},
        {"id": 7, **own, "source_session_id": "s7", "project_id": 1, "title": "Gone", "started_at": "2024-05-03T10:00:00Z"},
        {"id": 8, **own, "source_session_id": "s8", "project_id": 1, "title": CAVEAT, "started_at": "2024-05-03T10:00:00Z"},
    ]
    message = [{"session_id": 1, "seq": 0, "role": "user"}, {"session_id": 1, "seq": 1, "role": "assistant"}, {"session_id": 8, "seq": 0, "role": "user"}, {"session_id": 3, "seq": 0, "role": "user"}]
    block = [{"session_id": 1, "seq": 0, "ordinal": 0, "type": "text", "text": " Do  this "}, {"session_id": 8, "seq": 0, "ordinal": 0, "type": "text", "text": "<command-name>/x"}, {"session_id": 3, "seq": 0, "ordinal": 0, "type": "text", "text": " "}]
    call = {"session_id": 1, "seq": 1, "tool_name": "Read", "tool_kind": "builtin", "is_error": False, "timestamp": "2024-05-01T23:00:00Z"}
    calls = [
        {**call, "id": 1, "ordinal": 0, "duration_ms": 10, "input": "x" * 600},
        {**call, "id": 2, "ordinal": 1, "duration_ms": None, "is_error": None, "timestamp": "2024-05-02T00:00:00Z"},
        {**call, "id": 3, "ordinal": 2, "tool_name": "mcp__srv__find", "tool_kind": "mcp", "mcp_server": "srv", "mcp_tool": "find", "is_error": True, "duration_ms": 30},
        {**call, "id": 4, "ordinal": 3, "tool_name": None, "duration_ms": 5, "timestamp": None},
        {**call, "id": 5, "session_id": 6, "ordinal": 0, "duration_ms": 99},
        {**call, "id": 6, "session_id": 4, "ordinal": 0, "duration_ms": 1, "tool_name": "Bash"},
    ]
    ref = {"session_id": 1, "seq": 0, "ordinal": 0, "nth": 0, "path": "/w/one/a.py", "rel_path": "a.py", "ext": "py", "operation": "read", "timestamp": "2024-05-01T10:00:00Z"}
    refs = [{**ref, "operation": "edit"}, ref, {**ref, "session_id": 2}, {**ref, "session_id": 3}, {**ref, "session_id": 4, "rel_path": None, "path": None, "ext": None}, {**ref, "session_id": 7}, {**ref, "rel_path": None, "path": "/etc/b", "ext": None}]
    issue = [{"source_path": "/f1", "session_id": 1, "line_no": n, "code": c} for n, c in ((9, "unparsed_line"), (2, "orphan_tool_result"), (3, "unparsed_line"))]
    states = [{"tool": "claude_code", "source_session_id": "s5", "state": "archived"}, {"tool": "claude_code", "source_session_id": "s7", "state": "deleted"}]
    made = {"project": project, "session": session, "message": message, "block": block, "tool_call": calls, "file_ref": refs, "issue": issue, "user_state": states}
    return Archive(**{name: rows(spark, schema.TABLES[name], given) for name, given in made.items()})


@pytest.fixture(scope="module")
def hidden(a):
    return {archived: reads._hidden(a, archived) for archived in (False, True)}


def ids(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize(
    "scope, want",
    [
        (Scope(), {1, 2, 3, 4}),
        (Scope(include_archived=True), {1, 2, 3, 4, 5, 6}),
        (Scope(include_subagents=False), {1, 3, 4}),
        (Scope(tool="codex"), {3}),
        (Scope(model=""), {2, 4}),
        (Scope(model="m"), {1}),
        (Scope(project="/w/one"), {1, 2}),
        (Scope(project=""), {4}),
        (Scope(project="/nowhere"), set()),
        (Scope(place="one"), {1, 2}),
        (Scope(place="/w/one"), {1, 2, 3}),
        (Scope(place="tree"), {3}),
        (Scope(work_type="fix"), {1}),
        (Scope(session_id=3), {3}),
        (Scope(session_id=7), set()),
        (Scope(date_from="2024-05-02"), {2, 3}),
        (Scope(date_to="2024-05-01"), {1}),
        (Scope(date_from="2024-5-2"), {1, 2, 3, 4}),
    ],
)
def test_scopes_of_sessions(a, hidden, scope, want):
    got = reads.sessions_in(a, scope, hidden[scope.include_archived])
    assert set(ids(got)) == want and got.columns == a.session.columns


@pytest.mark.parametrize(
    "scope, want",
    [
        (CallScope(), {1, 2, 3, 4, 6}),
        (CallScope(tool="Read"), {1, 2}),
        (CallScope(server="srv"), {3}),
        (CallScope(errors_only=True), {3}),
        (CallScope(session_id=4), {6}),
        (CallScope(session_id=6), set()),
        (CallScope(project="/w/one"), {1, 2, 3, 4}),
        (CallScope(date_from="2024-05-02"), {2}),
        (CallScope(date_to="2024-05-01"), {1, 3, 6}),
        (CallScope(least_ms=10), {1, 3}),
        (CallScope(least_ms=-1), {1, 3, 4, 6}),
    ],
)
def test_scopes_of_calls(a, hidden, scope, want):
    assert set(ids(reads.calls_in(a, scope, hidden[False]))) == want


def test_pages_of_sessions(a):
    got = {r.id: r for r in reads.session_page(a, servers=("srv",)).collect()}
    assert list(got) == [3, 1, 4]
    one = got[1]
    assert (one.title, one.project, one.subagents, one.subagent_nano, one.issues, one.remarks, one.direct_calls, one.tree_calls, one.user_state, one.is_user_archived) == ("Do this", "/w/one", 1, 7, 2, 1, 1, 1, None, False)
    assert (got[3].title, got[4].title, got[4].project, got[4].subagents) == ("Second", "No project", None, 0)
    assert ids(reads.session_page(a, limit=1, offset=1)) == [1] and ids(reads.session_page(a, limit=0, offset=-5)) == [3, 1, 4] and ids(reads.session_page(a, offset=9)) == []
    kept = {r.id: r for r in reads.session_page(a, Scope(include_archived=True)).collect()}
    assert list(kept) == [6, 5, 3, 2, 1, 4]
    assert (kept[5].user_state, kept[5].is_user_archived, kept[6].user_state, kept[6].is_user_archived) == ("archived", True, None, True)
    assert ids(reads.session_index(a)) == [3, 1, 4]


def test_sessions_that_name_a_text(a):
    titles = a.session.select("id", "title")
    find = lambda t: set(ids(reads.containing(a.session, a.project, titles, t)))
    assert find(" EXPLORER ") == {1, 2} and find("one-tree") == {3} and find("below") == {5, 6} and find("zzz") == set() and len(find("  ")) == 8


def test_projects(a):
    got = {r.path: r for r in reads.projects(a).collect()}
    assert list(got) == ["/w/one", "/w/one-tree", "/w/none"]
    assert (got["/w/one"].sessions, got["/w/one"].worktrees, got["/w/one"].tools, got["/w/one"].last_active) == (1, 1, ["claude_code"], "2024-05-01T11:00:00Z")
    assert (got["/w/none"].sessions, got["/w/none"].tools, got["/w/none"].cost_usd) == (0, [], 0.0)


def test_calls(a):
    page = reads.call_page(a).collect()
    assert [r.id for r in page] == [2, 6, 3, 1, 4] and [r.id for r in reads.call_page(a, limit=2, offset=1).collect()] == [6, 3]
    long = page[3].input_preview
    assert long == "x" * 300 + "\n[… 100 chars omitted …]\n" + "x" * 200 and page[3].project == "/w/one" and page[1].project is None
    s = reads.call_summary(a).first()
    assert (s.calls, s.errors, s.error_pct, s.p50_ms, s.p95_ms, s.top_tool) == (5, 1, 20.0, 5, 30, "Read")
    empty = reads.call_summary(a, CallScope(tool="none")).first()
    assert (empty.calls, empty.errors, empty.error_pct, empty.p50_ms, empty.top_tool) == (0, 0, 0.0, None, None)
    got = [(r.tool_name, r.calls, r.errors, r.p50_ms) for r in reads.tool_summary(a.tool_call, 1).collect()]
    assert got == [("Read", 2, 0, 10), ("(unknown)", 1, 0, 5), ("mcp__srv__find", 1, 1, 30)]
    assert reads.tool_summary(a.tool_call).select("session_id").distinct().count() == 3


def test_files(a):
    got = [(r.key, r.project, r.reads, r.edits, r.sessions) for r in reads.file_hotspots(a).collect()]
    assert got == [("a.py", "/w/one", 2, 1, 2), ("", None, 1, 0, 1), ("/etc/b", "/w/one", 1, 0, 1), ("a.py", "/w/one-tree", 1, 0, 1)]
    assert [(r.key, r.reads) for r in reads.file_hotspots(a, "ext", "read").collect()] == [("py", 3), ("(none)", 2)]
    assert [(r.key, r.rank) for r in reads.hot_files(a, 1).collect()] == [("a.py", 1), ("/etc/b", 2)]


def test_a_day_and_a_session(spark, a):
    got = reads.day_totals(a, "2024-05-01").first()
    assert (got.sessions, got.messages, got.tool_calls, got.input_tokens, got.cost_usd) == (1, 2, 4, 0, 0.0)
    none = reads.day_totals(a, "2030-01-01").first()
    assert (none.sessions, none.messages, none.cost_usd) == (0, 0, 0.0)
    assert [r.turn_count for r in reads.facets(a.session, 1).collect()] == [3] and reads.facets(a.session).count() == 8
    assert [(r.line_no, r.code) for r in reads.issues_of(a.session, a.issue, 1).collect()] == [(2, "orphan_tool_result"), (3, "unparsed_line"), (9, "unparsed_line")]
    assert reads.issues_of(a.session, a.issue, 2).count() == 0 and reads.issues_of(a.session, a.issue, 4).count() == 0 and reads.issues_of(a.session, a.issue, 99) is None
    line = [(r.session_id, r.seq, r.kind, r.text) for r in reads.outline(a.message, a.block, a.tool_call, ("srv",)).where("session_id = 1").collect()]
    assert line == [(1, 0, "prompt", " Do  this "), (1, 1, "call", "find")]
    hits = spark.createDataFrame([(0, 7, "a"), (1, 8, "b"), (2, 7, "c"), (3, 9, "d"), (4, 8, "e")], "rank int, session_id long, hit string")
    assert "".join(r.hit for r in reads.grouped_hits(hits).collect()) == "acbed"


def test_names_of_servers(spark):
    odd = "0123abcd-0000-1111-2222-0123456789AB"
    want = {
        "dosing": "Dosing (local)", "claude_ai_Dosing": "Dosing (connector)", "plugin_x_dosing": "Dosing (x plugin)", "plugin_post_post": "Post", "my-own__server": "My Own Server", odd: odd, f"claude_ai_{odd}": odd,
        "éa": "Éa", "plugin_a_": "", "claude_ai_plugin_x_y": "Plugin X Y",
    }
    want[odd], want[f"claude_ai_{odd}"] = f"{odd} (local)", f"{odd} (connector)"
    df = spark.createDataFrame([(s,) for s in [*want, *want, None, ""]], "mcp_server string")
    assert {r.mcp_server: r.label for r in reads.server_labels(df).collect()} == want
    assert [r.n for r in df.select(reads.server_name(F.col("mcp_server")).alias("n")).collect()][-2:] == ["", ""]
