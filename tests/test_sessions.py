"""Visibility, titles, trees, details, fuzzy titles and the keys of signals."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F
from sessionloom.operators import fuzzy, sessions, signals
from sessionloom.schema import BLOCK, MESSAGE, SESSION, TOOL_CALL


def rows(spark, ddl, given):
    names = [f.split()[0] for f in ddl.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in given], ddl)


def archive(spark, talks, **more):
    """``{id: [(role, text)]}``, a block for each message; ``more``: fields of session or message."""
    s = [{"id": i, "tool": "claude_code", "is_subagent": False, **more.get("session", {}).get(i, {})} for i in talks]
    m = [{"session_id": i, "seq": k, "role": role, **more.get("message", {}).get((i, k), {})} for i, said in talks.items() for k, (role, _) in enumerate(said)]
    b = [{"session_id": i, "seq": k, "ordinal": 0, "type": "text", "text": text} for i, said in talks.items() for k, (_, text) in enumerate(said)]
    return rows(spark, SESSION, s), rows(spark, MESSAGE, m), rows(spark, BLOCK, b)


CAVEAT = "<local-command-caveat>Caveat: made locally"


def test_sessions_of_local_commands_are_hidden(spark):
    talk = [("user", CAVEAT), ("user", "  <command-name>/model</command-name>"), ("user", " "), ("system", "x")]
    talks = {1: talk, 2: [*talk, ("user", "a real question")], 3: [*talk, ("assistant", "")], 4: talk, 5: talk, 6: [], 7: talk}
    more = {i: {"title": CAVEAT} for i in talks} | {4: {"title": CAVEAT, "output_tokens": 1}, 5: {"title": "Own title"}, 7: {"title": CAVEAT.upper(), "tool": "codex"}}
    assert {r.id for r in sessions.wrapper_only(*archive(spark, talks, session=more)).collect()} == {1, 6}
    assert {r.id for r in sessions.shown(*archive(spark, talks, session=more)).collect()} == {2, 3, 4, 5, 7}


TITLES = [
    ([("user", "\x1b[1m Fix \x1b[0m\n the   test ")], {}, {}, "Fix the test"),
    ([("user", CAVEAT), ("user", "<COMMAND-NAME>/x"), ("user", "# AGENTS.md instructions for x"), ("user", "then <environment_context> y"), ("user", "go on")], {}, {}, "go on"),
    ([("user", "You are `/root`, the primary agent of it"), ("user", "<skills_instructions>a"), ("user", "The following is the Codex agent history x"), ("user", "real")], {}, {}, "real"),
    ([("assistant", "no"), ("user", "developer's"), ("user", "human's")], {}, {1: {"payload_role": "developer"}, 2: {"payload_role": "user"}}, "human's"),
    ([("user", "summary"), ("user", "copied"), ("user", "own")], {}, {0: {"is_compact_summary": True}, 1: {"is_sidechain": True}}, "own"),
    ([("user", "told")], {"is_subagent": True}, {0: {"is_sidechain": True}}, "told"),
    ([("user", '<teammate-message id="a" summary="Look  at it">long</teammate-message>')], {"is_subagent": True}, {}, "Look at it"),
    ([("user", "<fork-boilerplate>rules</fork-boilerplate>\nYour directive: Check the\n build.\n\nSCOPE: all of it")], {"is_subagent": True}, {}, "Check the build."),
    ([("user", '<teammate-message summary="Look">x')], {"title": "Given"}, {}, "Given"),
    ([("user", " ")], {"title": " <permissions instructions> x"}, {}, None),
    ([("user", "y" * 181)], {}, {}, "y" * 180 + "…"),
]


def test_titles(spark):
    talks = {i: t[0] for i, t in enumerate(TITLES)}
    message = {(i, k): m for i, t in enumerate(TITLES) for k, m in t[2].items()}
    got = {r.id: r.title for r in sessions.display_titles(*archive(spark, talks, session={i: t[1] for i, t in enumerate(TITLES)}, message=message)).collect()}
    assert got == {i: t[3] for i, t in enumerate(TITLES)}


def nested(nodes):
    return {n.id: nested(n.subagents) for n in nodes if not isinstance(n, str)}


def test_trees(spark):
    chain = [{"id": i, "parent_session_id": i - 1 if i else None} for i in range(9)]
    more = [{"id": 10, "parent_session_id": 0, "spawn_depth": 0, "started_at": "b"}, {"id": 11, "parent_session_id": 0, "spawn_depth": 0, "started_at": "a"}, {"id": 20, "parent_session_id": 21}, {"id": 21, "parent_session_id": 20}, {"id": 30, "parent_session_id": 99}]
    s = rows(spark, SESSION, chain + more)
    got = {r.id: r.subagents for r in sessions.trees(s).collect()}
    assert set(got) == {0, 30} and nested(got[0]) == {1: {2: {3: {4: {5: {}}}}}, 10: {}, 11: {}} and list(nested(got[0])) == [1, 11, 10]
    cycle = {r.id: nested(r.subagents) for r in sessions.trees(s, spark.createDataFrame([(20,), (3,), (77,)], "id long")).collect()}
    assert cycle == {20: {21: {}}, 3: {4: {5: {6: {7: {8: {}}}}}}}
    assert {r.id: (r.subagents, r.own_nano) for r in sessions.rollups(s).collect()}[0] == (10, 0)


def test_detail_and_outline(spark):
    s, m, b = archive(spark, {1: [("user", "a"), ("assistant", "b"), (None, "c")], 2: [("user", "x")]})
    calls = rows(spark, TOOL_CALL, [{"session_id": 1, "seq": 1, "tool_name": "Read", "result_seq": 2, "result_ordinal": 0}])
    got = sessions.detail(1, m, b, calls).collect()
    assert [(r.seq, r.role, [x.text for x in r.blocks]) for r in got] == [(0, "user", ["a"]), (1, "assistant", ["b"]), (2, "unknown", ["c"])] and got[2].blocks[0].tool_name == "Read"
    assert [r.seq for r in sessions.detail(1, m, b, calls, limit=1, offset=1).collect()] == [1]
    assert {(r.session_id, r.seq): r.excerpt for r in sessions.outline(m, b).collect()} == {(1, 0): "a", (2, 0): "x"}
    assert {r.id: (r.replies, r.tool_calls) for r in sessions.totals(s, m, calls).collect()} == {1: (1, 1), 2: (0, 0)}


def one_error(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    swaps = {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    letters = set(a + b)
    others = {a[:i] + x + a[i + k :] for i in range(len(a) + 1) for k in (0, 1) for x in ["", *letters]}
    return b == a or b in swaps or b in others


@pytest.mark.parametrize("seed", range(3))
def test_fuzzy_finds_what_brute_force_finds(spark, seed):
    r = random.Random(seed)
    words = ["".join(r.choices("abc", k=r.randint(2, 6))) for _ in range(30)]
    titles = [(i, " ".join(r.choices(words, k=r.randint(1, 5)))) for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(titles, "id long, title string")
    for query in (words[0], f"{words[1]} {words[2]}", "".join(r.choices("abc", k=4)), "ab"):
        asked = query.split()
        want = {i for i, t in titles if t and all(w in t or (len(w) >= 3 and any(len(v) >= 3 - 1 and one_error(w, v) for v in t.split())) for w in asked)}
        assert {x.id for x in fuzzy.fuzzy_titles(df, query).collect()} == want
    assert fuzzy.fuzzy_titles(df, " -- ").count() == 0


def test_near_words(spark):
    pairs = [("".join(a), "".join(b)) for a, b in itertools.product(itertools.product("ab", repeat=3), itertools.product("ab", repeat=4))] + [("abcd", "acbd"), ("abcd", "abdc"), ("abcd", "badc"), ("abc", "abc"), ("abc", "xyz")]
    df = spark.createDataFrame(pairs, "a string, b string")
    out = df.select("a", "b", fuzzy.is_near(F.col("a"), F.col("b")).alias("near"), F.arrays_overlap(fuzzy.forms(F.col("a")), fuzzy.forms(F.col("b"))).alias("meet")).collect()
    assert all(r.near == one_error(r.a, r.b) and (r.meet or not r.near) for r in out)


def test_fuzzy_order_and_marks(spark):
    df = spark.createDataFrame([(1, "Refactor the parser"), (2, "refactro the parser"), (3, "the parser, refactor"), (4, "Préfactors: parser of the tests and more"), (5, "parser refactor")], "id long, title string")
    got = fuzzy.fuzzy_titles(df, "refactor parser").collect()
    assert [r.id for r in got] == [5, 3, 1, 4, 2]
    assert [(m.place, m.size) for m in got[2].marks] == [(1, 8), (14, 6)] and [(m.place, m.size) for m in got[4].marks] == [(1, 8), (14, 6)]
    assert [r.id for r in fuzzy.fuzzy_titles(df, "refactor parser", limit=2).collect()] == [5, 3]


def test_names_that_collided_have_keys_of_their_own(spark):
    calls = [("a.b", "c", None, i < 9) for i in range(20)] + [("a", "b.c", None, i < 9) for i in range(20)] + [("odd name", "builtin", "s", i < 9) for i in range(20)]
    calls = spark.createDataFrame(calls, "tool_name string, tool_kind string, mcp_server string, is_error boolean")
    session = rows(spark, SESSION, [{"id": 1}])
    got = [r.key for r in signals.signals(session, calls).collect()]
    assert len(got) == len(set(got)) == 3 and sorted(k.split(".h")[0] for k in got) == ["signal:error:a", "signal:error:a.b", "signal:error:odd-name"]
    renames = {r.old_key: r.key for r in signals.error_renames(calls).collect()}
    assert set(renames) == {"signal:error:odd name.builtin.s"} and set(renames.values()) <= set(got)
    parts = spark.createDataFrame([("linear mcp",), ("linear-mcp",), ("x.h0123456789abcdef",), ("-a-",)], "v string").select(signals.key_part(F.col("v")).alias("k")).collect()
    assert parts[1].k == "linear-mcp" and len({r.k for r in parts}) == 4 and parts[0].k.startswith("linear-mcp.h") and parts[2].k.startswith("x.h0123456789abcdef.h")


def test_life_of_signals(spark):
    state = lambda *r: spark.createDataFrame(list(r), "key string, status string, resolution string, score double")
    now = spark.createDataFrame([("a", 1.0)], "key string, score double")
    old = state(("a", "open", None, 2.0), ("b", "open", None, 1.0), ("c", "implemented", "user", 1.0), ("d", "open", "user", 1.0), ("e", "implemented", "activity", 1.0))
    after = lambda df: {r.key: (r.status, r.resolution) for r in df.collect()}
    assert after(signals.regenerate(old, now))["b"] == ("implemented", "activity")
    assert after(signals.after_hiding(old, now)) == {"a": ("open", None), "c": ("implemented", "user"), "d": ("implemented", "activity"), "e": ("implemented", "activity")}
    moved = signals.migrated(state(("old", "implemented", "user", 1.0), ("new", "open", None, 3.0), ("x", "open", None, 1.0)), spark.createDataFrame([("old", "new")], "old_key string, key string"))
    assert after(moved) == {"new": ("implemented", "user"), "x": ("open", None)}
    marked = signals.mark_implemented(old, "a")
    assert after(marked)["a"] == ("implemented", "user")
    days = rows(spark, SESSION, [{"id": 1, "started_at": "2024-05-01T00:00:00Z"}, {"id": 2, "started_at": "2024-04-01T00:00:01Z"}, {"id": 3, "started_at": "2024-03-01T00:00:00Z"}, {"id": 4, "started_at": None}, {"id": 5, "started_at": "2024-05-02T00:00:00Z"}])
    assert {r.id for r in signals.in_window(days, "2024-05-01T00:00:00Z").collect()} == {1, 2}
