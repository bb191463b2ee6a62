"""Trajectories of hand-made sessions, a rule at a time."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from sessionloom import schema
from sessionloom.operators import trajectory as tr
from sessionloom.schema import shaped


def archive(spark, sessions):
    """``{id: [(role, time, [block])]}`` with ``more`` fields of the session under ``(id, "more")``."""
    s, m, b = [], [], []
    for sid, said in sessions.items():
        if isinstance(sid, tuple):
            continue
        s.append((sid, sessions.get((sid, "more"), {})))
        for seq, (role, at, blocks) in enumerate(said):
            m.append((sid, seq, role, at))
            b += [(sid, seq, o, *x) for o, x in enumerate(blocks)]
    names = ("tool", "cwd", "git_branch", "model", "started_at")
    session = spark.createDataFrame([(i, *[{"tool": "claude_code"}.get(n) if n not in more else more[n] for n in names]) for i, more in s], "id long, tool string, cwd string, git_branch string, model string, started_at string")
    message = spark.createDataFrame(m, "session_id long, seq int, role string, timestamp string")
    block = spark.createDataFrame(b, "session_id long, seq int, ordinal int, type string, text string, tool_name string, tool_use_id string, tool_input string, tool_result string")
    return session, message, shaped(block.withColumn("id", F.xxhash64("session_id", "seq", "ordinal")).withColumn("is_error", F.lit(False)), schema.BLOCK)


def text(t):
    return ("text", t, None, None, None, None)


def use(i, name="Bash", given="{}"):
    return ("tool_use", None, name, i, given, None)


def result(i, t):
    return ("tool_result", None, None, i, None, t)


def lines(spark, sessions):
    records, reports = tr.trajectories(*archive(spark, sessions))
    out = {}
    for r in sorted(tr.as_json(records).collect(), key=lambda r: (r.session_id, r.n)):
        out.setdefault(r.session_id, []).append(json.loads(r.line))
    return out, {r.session_id: r for r in reports.collect()}


T = "2024-05-01T10:00:{:02d}.000Z"


def test_records_in_order(spark):
    said = [
        ("user", T.format(1), [text("do it")]),
        ("assistant", T.format(2), [("thinking", "hm", None, None, None, None), text("ok"), use("a", "Read", '{ "p": 1.0 }')]),
        ("tool", T.format(3), [result("a", "found")]),
        ("system", T.format(4), [text("compacted"), text("again")]),
        ("user", T.format(5), [text("  <command-name>/x"), text(" "), ("image", None, None, None, None, None)]),
        ("tool", T.format(6), [text("spoken by a tool")]),
    ]
    out, reports = lines(spark, {1: said, (1, "more"): {"cwd": "/w", "git_branch": "", "model": "m"}})
    assert out[1] == [
        {"role": "meta", "source": "claude-code", "cwd": "/w", "model": "m"},
        {"role": "user", "content": "do it", "timestamp": T.format(1)},
        {"role": "reasoning", "content": "hm", "timestamp": T.format(2)},
        {"role": "assistant", "content": "ok", "timestamp": T.format(2)},
        {"role": "assistant", "content": None, "tool_calls": [{"id": "a", "name": "Read", "args": '{"p":1}'}], "timestamp": T.format(2)},
        {"role": "tool", "tool_call_id": "a", "content": "found", "timestamp": T.format(3)},
    ]
    r = reports[1]
    assert r.is_ok and r.noise_user_records_dropped == 1 and r.dropped_blocks == {"system_message": 1, "text": 1, "image": 1, "tool_text": 1}
    assert sum(r[c] for c in tr.COUNTERS) == 1


def test_sessions_without_both_sides(spark):
    out, reports = lines(spark, {1: [("user", None, [text("a")])], 2: [("assistant", None, [text("a")])], 3: [("user", None, [text("<command-message>x")]), ("assistant", None, [text("a")])]})
    assert out == {} and {i: r.reason for i, r in reports.items()} == {1: "missing_assistant_records", 2: "missing_user_records", 3: "missing_user_records"}


def test_results_answer_calls_by_position(spark):
    said = [
        ("user", None, [text("go")]),
        ("assistant", None, [use("x"), use("x"), use("y"), use(None, ""), use("z")]),
        ("user", None, [result("x", "1"), result("x", "2"), result("x", "3"), result("gone", "4"), result(None, "5"), result("y", "6"), result("y", "7")]),
    ]
    out, reports = lines(spark, {7: said})
    calls = [r["tool_calls"][0] for r in out[7] if "tool_calls" in r]
    assert [(c["id"], c["name"]) for c in calls] == [("x", "Bash"), ("x__dup2", "Bash"), ("y", "Bash"), ("call-7-4", "unknown_tool"), ("z", "Bash")]
    assert [(r["tool_call_id"], r["content"]) for r in out[7] if r["role"] == "tool"] == [("x", "1"), ("x__dup2", "2"), ("y", "6")]
    r = reports[7]
    assert (r.tool_call_ids_renamed, r.tool_call_ids_synthesized, r.orphan_tool_results_dropped, r.duplicate_tool_results_dropped) == (1, 1, 2, 2)


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (["a", "a", "a"], ["a", "a__dup2", "a__dup3"]),
        (["a__dup2", "a", "a", "a"], ["a__dup2", "a", "a__dup3", "a__dup4"]),
        (["a", "a", "a__dup2", "a__dup2"], ["a", "a__dup2", "a__dup2__dup2", "a__dup2__dup3"]),
        (["a", "b__dup2", "a", "b", "b"], ["a", "b__dup2", "a__dup2", "b", "b__dup3"]),
    ],
)
def test_ids_are_unique(spark, given, want):
    out, _ = lines(spark, {1: [("user", None, [text("go")]), ("assistant", None, [use(i) for i in given])]})
    got = [r["tool_calls"][0]["id"] for r in out[1] if "tool_calls" in r]
    assert got == want and len(set(got)) == len(got)


def test_missing_times_are_filled(spark):
    said = [("user", "soon", [text("a"), text("b")]), ("assistant", "2024-05-01T12:00:00+02:00", [text("c")]), ("user", None, [text(" "), text("d")]), ("assistant", "2024-05-01T10:00:07", [text("e")]), ("user", "2024-05-01T10:00:00+02", [text("f")])]
    out, reports = lines(spark, {1: said, (1, "more"): {"started_at": "2024-05-01T09:00:00Z"}, 2: said})
    tail = ["2024-05-01T10:00:00.000Z"] * 2 + ["2024-05-01T10:00:07.000Z"] * 2
    assert [r["timestamp"] for r in out[1][1:]] == ["2024-05-01T09:00:00.000Z"] * 2 + tail
    assert [r["timestamp"] for r in out[2][1:]] == ["2026-01-01T00:00:15.000Z", "2026-01-01T00:00:30.000Z", *tail]
    assert reports[1].timestamps_filled == reports[2].timestamps_filled == 4


@pytest.mark.parametrize("length", [0, 2499, 2500, 2501, 3459, 3460, 12_500, 102_470])
def test_long_results_are_cut(spark, length):
    whole = "".join("aé😀z"[i % 4] for i in range(length))
    short = tr.truncated(whole, 2500)
    assert len(short) <= 2500 and (short == whole) == (length <= 2500)
    if length > 2500:
        head, rest = short.split(tr.MARKER[0])
        dropped, tail = rest.split(tr.MARKER[1])
        assert whole.startswith(head) and whole.endswith(tail) and len(head) - len(tail) in (0, 1)
        assert int(dropped) == length - len(head) - len(tail)
        # One more character wouldn't fit.
        more = length - int(dropped) + 1
        assert more + len(tr.MARKER[0] + str(length - more) + tr.MARKER[1]) > 2500
    assert spark.createDataFrame([(whole,)], "t string").select(tr.truncated_column(F.col("t"), 2500)).first()[0] == short


def test_arguments():
    assert tr.arguments(None) == ("{}", False) and tr.arguments(' {"a" : [1, 2.50, "é"]}') == ('{"a":[1,2.5,"é"]}', False)
    for given in ("[1]", "oops {", "3", '"s"', '{"a": NaN}'):
        out, changed = tr.arguments(given)
        assert changed and json.loads(out) == {"_raw": given}
    long, changed = tr.arguments(json.dumps({"keep": "k", "deep": {"big": "x" * 30_000, "list": ["y" * 500]}}))
    value = json.loads(long)
    assert changed and 19_000 < len(long) <= 20_000 and value["keep"] == "k" and value["deep"]["list"] == ["y" * 500] and "truncated" in value["deep"]["big"]
    quotes, changed = tr.arguments(json.dumps({"q": '"' * 15_000, "n": "\n" * 9000}))
    assert changed and len(quotes) <= 20_000 and set(json.loads(quotes)) == {"q", "n"}
    many, changed = tr.arguments(json.dumps({f"k{i}": i for i in range(4000)}))
    assert changed and len(many) <= 20_000 and list(json.loads(many)) == ["_raw"]


def test_export(spark, tmp_path):
    records, _ = tr.trajectories(*archive(spark, {i: [("user", None, [text(f"q{i}")]), ("assistant", None, [text("a\nb")])] for i in range(3)}))
    tr.export(records, str(tmp_path / "out"))
    got = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert len(got) == 9 and [r["role"] for r in got[:3]] == ["meta", "user", "assistant"]
    empty, reports = tr.trajectories(*[df.limit(0) for df in archive(spark, {1: [("user", None, [text("x")])]})])
    assert empty.count() == reports.count() == 0
