"""Documents of sessions: written, read back, and run."""

from __future__ import annotations

import json
import subprocess

import pytest
from pyspark.sql import functions as F
from sessionloom import schema
from sessionloom.operators import export
from sessionloom.schema import Archive
from test_sessions import rows


@pytest.fixture(scope="module")
def a(spark):
    session = [
        {"id": 1, "tool": "claude_code", "is_subagent": False, "source_session_id": "s1", "message_count": 3, "cost_nano": 1_235_000_000, "started_at": "2024-05-01T10:00:00Z", "model": "m"},
        {"id": 2, "tool": "claude_code", "is_subagent": True, "source_session_id": "s2", "parent_session_id": 1},
        {"id": 3, "tool": "codex", "is_subagent": False, "source_session_id": "s3"},
        {"id": 4, "tool": "codex", "is_subagent": False, "source_session_id": "s4"},
    ]
    message = [{"session_id": 1, "seq": s, "role": r} for s, r in ((0, "user"), (4, "assistant"), (5, "tool"))] + [{"session_id": 2, "seq": 0, "role": None}]
    b = {"session_id": 1, "seq": 4}
    block = [
        {"session_id": 1, "seq": 0, "ordinal": 0, "type": "text", "text": "Fix\nthe test"}, {**b, "ordinal": 0, "type": "thinking", "text": "hm"}, {**b, "ordinal": 1, "type": "text", "text": None},
        {**b, "ordinal": 2, "type": "tool_use", "tool_name": "Bash", "tool_input": '{"command":"ls"}'}, {**b, "ordinal": 3, "type": "image"}, {**b, "ordinal": 10, "type": "text", "text": "done"},
        {"session_id": 1, "seq": 5, "ordinal": 0, "type": "tool_result", "tool_result": 'a "b"\n'},
    ]
    calls = [{"session_id": 1, "seq": 4, "ordinal": 2, "tool_name": "Bash", "result_seq": 5, "result_ordinal": 0}]
    states = [{"tool": "codex", "source_session_id": "s4", "state": "deleted"}]
    made = {"project": [], "session": session, "message": message, "block": block, "tool_call": calls, "file_ref": [], "issue": [], "user_state": states}
    return Archive(**{name: rows(spark, schema.TABLES[name], given) for name, given in made.items()})


def documents(path):
    return {int(d.name.split("=")[1]): "".join(f.read_text() for f in sorted(d.glob("part-*"))) for d in path.glob("session_id=*")}


MARKDOWN = """# Fix the test

- **tool:** claude_code
- **model:** m
- **messages:** 3
- **est. cost:** $1.24
- **started:** 2024-05-01T10:00:00Z

## USER

Fix
the test

## ASSISTANT

> _thinking:_ hm

**→ Bash**

```json
{"command":"ls"}
```

_[image]_

done

## TOOL

```
a "b"

```

"""


def test_markdown(a, tmp_path):
    assert export.export_all(a, str(tmp_path)) == (2, 0)
    got = documents(tmp_path)
    assert set(got) == {1, 3} and got[1] == MARKDOWN and got[3].startswith("# s3\n\n- **tool:** codex\n- **model:** \n- **messages:** 0\n- **est. cost:** $0.00\n")
    # Again, with subagents: what is there is replaced, not added to.
    assert export.export_all(a, str(tmp_path), include_subagents=True) == (3, 0)
    assert documents(tmp_path)[1] == MARKDOWN and documents(tmp_path)[2].endswith("## UNKNOWN\n\n")


def test_json(a, tmp_path):
    assert export.export_all(a, str(tmp_path), "json") == (2, 0)
    got = {i: json.loads(t) for i, t in documents(tmp_path).items()}
    one = got[1]
    assert one["summary"]["title"] == "Fix the test" and one["totals"] == {"replies": 1, "tool_calls": 1} and [s["id"] for s in one["subagents"]] == [2]
    assert [(m["seq"], [b["ordinal"] for b in m["blocks"]]) for m in one["messages"]] == [(0, [0]), (4, [0, 1, 2, 3, 10]), (5, [0])]
    assert one["messages"][2]["blocks"][0]["tool_name"] == "Bash" and one["messages"][2]["blocks"][0]["tool_result"] == 'a "b"\n'
    assert got[3]["messages"] == [] and got[3]["subagents"] == []


def test_trajectories(a, tmp_path):
    assert export.export_all(a, str(tmp_path), "trajectory") == (1, 1)
    got = json.loads(documents(tmp_path)[1])
    assert [r["role"] for r in got][:2] == ["meta", "user"]
    with pytest.raises(ValueError):
        export.export_all(a, str(tmp_path), "pdf")


def test_long_sessions_are_cut_over_files(spark, tmp_path):
    parts = spark.range(20_000).select(F.floor(F.col("id") % 10 / 9).alias("session_id"), F.col("id").cast("int").alias("seq"), F.lit(0).alias("ordinal"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("text"))
    # So few rows would be put together into one task.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        export.write(parts, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "session_id=0").glob("part-*"))) > 1
    assert documents(tmp_path)[0].split("\n")[:-1] == [f"line {i}" for i in range(20_000) if i % 10 < 9]


def replayed(spark, given, include_errors=False, title=None):
    calls = rows(spark, schema.TOOL_CALL, [{"session_id": 1, "seq": i, "ordinal": 0, "tool_name": n, "input": x if isinstance(x, str) or x is None else json.dumps(x), "is_error": e} for i, (n, x, e) in enumerate(given)])
    session = rows(spark, schema.SESSION, [{"id": 1, "tool": "codex", "cwd": "/w/p/", "title": title}])
    return [r.text for r in export.replay(session, calls, include_errors).orderBy("seq").collect()], export.replay_ops(session, calls)


def test_replay(spark):
    given = [
        ("Bash", {"command": "cat /w/p/a  b"}, False),
        ("Bash", {"command": "false"}, True),
        ("Bash", {"command": "rm -rf x\ny"}, False),
        ("Write", {"file_path": "/w/p/it's.txt", "content": "one $HOME\n`x`\n\n"}, False),
        ("Write", {"file_path": "bad\nname", "content": "x"}, False),
        ("Write", {"file_path": "c", "content": "REPLAY_EOF"}, False),
        ("Write", {"file_path": 7, "content": "x"}, False),
        ("Edit", {"file_path": "/q/z", "old_string": "a\n  b", "new_string": "y" * 70}, False),
        ("NotebookEdit", {"notebook_path": "/w/p/n.ipynb"}, False),
        ("apply_patch", json.dumps("*** patch\n"), False),
        ("apply_patch", {"patch": "x"}, False),
        ("Write", json.dumps(json.dumps({"file_path": "d"})), False),
        ("Read", {"file_path": "x"}, False), ("Bash", "no json", False), ("Bash", None, False), (None, "{}", False),
        ("Bash", {"command": "curl -H 'Authorization: Bearer abc'"}, False),
    ]
    lines, ops = replayed(spark, given, title="a\nb")
    assert lines[0].startswith("#!/usr/bin/env bash\n# Replay of codex session 1: a\\u000ab\n")
    assert lines[1:] == [
        "cat $PROJECT_ROOT/a b",
        "# REVIEW: destructive (rm -rf)\n# rm -rf x y",
        "mkdir -p \"$(dirname 'it'\\''s.txt')\"\ncat > 'it'\\''s.txt' <<'REPLAY_EOF'\none $HOME\n`x`\nREPLAY_EOF",
        '# SKIPPED write to "bad\\nname": content or path unsafe for a heredoc, recreate it by hand',
        '# SKIPPED write to "c": content or path unsafe for a heredoc, recreate it by hand',
        "# EDIT /q/z: replace `a b` -> `" + "y" * 60 + "…` (apply by hand)",
        "# EDIT n.ipynb: notebook cell edit (apply by hand)",
        "git apply <<'REPLAY_EOF'\n*** patch\nREPLAY_EOF",
        "mkdir -p \"$(dirname 'd')\"\ncat > 'd' <<'REPLAY_EOF'\n\nREPLAY_EOF",
        "curl -H 'Authorization: Bearer <REDACTED>",
    ]
    assert [r.seq for r in ops.where("redacted").collect()] == [16]
    with_errors, _ = replayed(spark, given[:2], include_errors=True)
    assert with_errors[2] == "# (errored in original run)\n# false"


def test_a_script_does_what_it_says(spark, tmp_path):
    lines, _ = replayed(spark, [("Write", {"file_path": "/w/p/a b/it's", "content": "$(touch no) `x`\n'y'"}, False), ("Bash", {"command": "cp '/w/p/a b/it'\\''s' out"}, False)])
    done = subprocess.run(["bash", "-c", "\n".join(lines)], cwd=tmp_path, env={"PROJECT_ROOT": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert (tmp_path / "a b" / "it's").read_text() == "$(touch no) `x`\n'y'\n" and not (tmp_path / "no").exists(), done.stderr
