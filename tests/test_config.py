"""Where things are, prices that are kept, and the scan for one field."""

from __future__ import annotations

import transcripts_fixture as fx
from pyspark.sql import functions as F
from sessionloom import config
from sessionloom.functions import cost
from sessionloom.sources import transcripts
from sessionloom.streaming.watch import opened
from test_sync import names


def test_given_then_environment_then_home():
    env = {"SESSIONLOOM_ARCHIVE": "/e/archive", "SESSIONLOOM_CODEX_DIR": "/e/codex"}
    got = config.resolved(second_dir="/g", env=env, home="/h")
    assert (got.archive, got.first_dir, got.second_dir, got.sync) == ("/e/archive", "/h/.claude/projects", "/g", True)
    assert config.resolved(env={}, home="/h").archive == "/h/.sessionloom/archive"
    assert not config.resolved(env={"SESSIONLOOM_NO_SYNC": ""}).sync and not config.resolved(sync=False, env={}).sync


def test_archive_of_the_producers_folders(spark, tmp_path):
    home = tmp_path / "home"
    c = config.resolved(archive=str(tmp_path / "a"), env={}, home=str(home))
    assert config.source_paths(spark, c) == [] and config.index_files(spark, c) == () and opened(spark, c).session.count() == 0
    fx.write(home / ".claude" / "projects" / "p" / "one.jsonl", [fx.user("hello", fx.at(0))])
    (home / ".codex" / "archived_sessions").mkdir(parents=True)
    assert config.source_paths(spark, c) == [f"{home}/.claude/projects", f"{home}/.codex/archived_sessions"]
    assert names(opened(spark, c)) == ["one"]
    # Not read where syncing is off, nor where other sources are given.
    fx.write(home / ".claude" / "projects" / "p" / "two.jsonl", [fx.user("hello", fx.at(0))])
    assert names(opened(spark, config.resolved(archive=c.archive, sync=False, env={}, home=str(home)))) == ["one"]
    assert config.source_paths(spark, config.resolved(sources=("/x",), env={}, home=str(home))) == ["/x"]


def test_prices_of_users_stay(spark):
    ddl = "price_model string, p_input long, p_output long, p_read long, p_write long, p_write_1h long, source string"
    stored = spark.createDataFrame([("gpt-5", 9, 9, 9, 9, 9, "user"), ("claude-opus", 1, 1, 1, 1, 1, "seed"), ("old", 2, 2, 2, 2, 2, "seed"), ("gpt-5.4", 0, 0, 0, 0, 0, None)], ddl)
    table = cost.upsert_prices(stored, cost.prices(spark))
    got = {r.price_model: r for r in table.collect()}
    assert len(got) == table.count() == cost.prices(spark).count() + 1
    assert (got["gpt-5"].p_input, got["gpt-5"].source, got["claude-opus"].p_input, got["old"].p_input, got["gpt-5.4"].p_input) == (9, "user", 5000, 2, 0)
    again = cost.upsert_prices(table, cost.prices(spark))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, table.collect()), key=str)
    used = spark.createDataFrame([("gpt-5", 10, 1), ("claude-opus-4-7", 10, 1), ("nothing", 10, 1)], "model string, input_tokens long, output_tokens long").withColumn("cache_read_tokens", F.lit(0)).withColumn("cache_creation_tokens", F.lit(0))
    assert {r.model: r.cost_nano for r in cost.with_cost(used, table=table).collect()} == {"gpt-5": 99, "claude-opus-4-7": 75_000, "nothing": 0}


def test_scan_for_efforts_alone(spark, tmp_path):
    turn = lambda e, **more: {"type": "turn_context", "timestamp": fx.at(1), "payload": {"effort": e, **more}}
    fx.write(tmp_path / "one.jsonl", [fx.user("a", fx.at(0), effort="High"), fx.user("b", fx.at(1), effort="low"), fx.user('said "effort"', fx.at(2)), fx.user("c", fx.at(3), effort="HIGH")])
    fx.write(tmp_path / "rollout-two.jsonl", [{"type": "other", "payload": {"effort": "low"}}, turn("medium")])
    fx.write(tmp_path / "none.jsonl", [fx.user("a", fx.at(0))])
    with open(tmp_path / "one.jsonl", "a") as f:
        f.write('not json "effort"\n{"\\u0065ffort":"max"}\n')
    got = {r.path.rsplit("/", 1)[1]: (r.reasoning_effort, r.reasoning_effort_levels) for r in transcripts.effort_scan(spark, str(tmp_path)).collect()}
    assert got == {"one.jsonl": ("mixed", ["high", "low", "max"]), "rollout-two.jsonl": ("medium", ["medium"])}
