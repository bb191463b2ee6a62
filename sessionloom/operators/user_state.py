"""What users decide about sessions: archived, visible again, deleted.

Decisions are rows ``(tool, source_session_id, state)`` that outlive the sessions.  A
deleted session leaves a tombstone for itself, for all under it and for the tool uses by
which it spawned others, so that transcripts which come late are refused too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.operators.lineage import below
from sessionloom.staging import staged

#: Stands for a tool in the tombstones of tool uses; no producer has this name.
SPAWN = "__spawn__"
SPAWNERS = ("Task", "Agent")
V = F.col


def identity() -> list[Column]:
    return [V("tool"), V("source_session_id")]


def spawn_key(root: Column, use: Column) -> Column:
    return F.to_json(F.array(root, use))


def direct_states(session: DataFrame, states: DataFrame) -> DataFrame:
    """``(id, state)`` of the sessions that have one themselves."""
    return session.select("id", "tool", "source_session_id").join(states.select("tool", "source_session_id", "state"), ["tool", "source_session_id"]).select("id", "state")


def effective_archived(session: DataFrame, states: DataFrame) -> DataFrame:
    """``(id)`` of the sessions that are archived or under an archived one."""
    return below(session, direct_states(session, states).where("state = 'archived'"))


def deleted_sessions(session: DataFrame, states: DataFrame) -> DataFrame:
    """Sessions that have a tombstone of their own."""
    return session.join(states.where("state = 'deleted'").select("tool", "source_session_id"), ["tool", "source_session_id"], "left_semi").select(session.columns)


def _spawned_by(session: DataFrame, block: DataFrame) -> DataFrame:
    """``(id, key)``: the tool uses by which sessions of the first producer spawn others."""
    own = session.where("tool = 'claude_code' AND root_source_session_id IS NOT NULL").select("id", V("root_source_session_id").alias("root"))
    uses = block.where("type = 'tool_use' AND tool_use_id IS NOT NULL").where(V("tool_name").isin(*SPAWNERS)).select(V("session_id").alias("id"), V("tool_use_id").alias("use"))
    return own.join(uses, "id").select("id", spawn_key(V("root"), V("use")).alias("key")).distinct()


def _upsert(states: DataFrame, rows: DataFrame) -> DataFrame:
    rows = rows.dropDuplicates(["tool", "source_session_id"])
    return states.select("tool", "source_session_id", "state").join(rows, ["tool", "source_session_id"], "left_anti").unionByName(rows)


def set_state(session: DataFrame, block: DataFrame, states: DataFrame, session_id: int, state: str) -> tuple[DataFrame, DataFrame]:
    """The states after the decision, and ``(id)`` of the sessions to remove.

    Archived and visible concern the session alone (those under an archived one are archived
    in effect); deleted concerns all under it.
    """
    if state not in ("archived", "visible", "deleted"):
        raise ValueError(state)
    one = session.where(V("id") == session_id)
    nothing = session.select("id").limit(0)
    if state == "visible":
        return states.join(one.select(*identity()), ["tool", "source_session_id"], "left_anti"), nothing
    if state == "archived":
        return _upsert(states, one.select(*identity(), F.lit(state).alias("state"))), nothing
    doomed = staged(session.join(below(session, one), "id", "left_semi"), "doomed")
    tombs = doomed.select(*identity()).unionByName(_spawned_by(doomed, block).select(F.lit(SPAWN).alias("tool"), V("key").alias("source_session_id")))
    return _upsert(states, tombs.withColumn("state", F.lit("deleted"))), doomed.select("id")


def inherit(session: DataFrame, block: DataFrame, states: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The states with the tombstones that sessions inherit, and the sessions refused.

    A session is refused if it has a tombstone, if its root has one, or if the tool use that
    spawned it has; then those that hang on it are, to a fixpoint.  ``known`` are sessions
    that are there already: they get tombstones as well.
    """
    dead = states.where("state = 'deleted'")
    if dead.isEmpty():
        return states, session.limit(0)
    columns = ["id", "tool", "source_session_id", "root_source_session_id", "spawn_tool_use_id", "is_subagent", "parent_session_id"]
    every = session.select(*columns)
    if known is not None:
        every = every.unionByName(known.select(*columns).join(every.select("id"), "id", "left_anti"))
    every = staged(every.withColumn("key", F.when(V("tool") == "claude_code", spawn_key(V("root_source_session_id"), V("spawn_tool_use_id")))), "lineage")
    spawns = staged(_spawned_by(session, block), "spawns")
    dead = staged(dead.select(*identity()).distinct(), "tombstones")
    rounds = []
    while True:
        by_name = every.join(dead, ["tool", "source_session_id"], "left_semi")
        by_root = every.where("is_subagent").join(dead.withColumnRenamed("source_session_id", "root_source_session_id"), ["tool", "root_source_session_id"], "left_semi").where("root_source_session_id <> source_session_id")
        by_spawn = every.join(dead.where(V("tool") == SPAWN).select(V("source_session_id").alias("key")), "key", "left_semi")
        hits = by_name.select("id").union(by_root.select("id")).union(by_spawn.select("id")).distinct()
        if rounds:
            hits = hits.join(reduce(DataFrame.union, rounds), "id", "left_anti")
        under = every.where("parent_session_id IS NOT NULL").join((reduce(DataFrame.union, rounds) if rounds else hits).select(V("id").alias("parent_session_id")).distinct(), "parent_session_id", "left_semi").select("id")
        hits = hits.union(under if not rounds else under.join(reduce(DataFrame.union, rounds), "id", "left_anti")).distinct()
        new = staged(hits, "refused")
        if new.isEmpty():
            break
        rounds.append(new)
        lost = every.join(new, "id", "left_semi")
        more = lost.select(*identity()).unionByName(spawns.join(new, "id", "left_semi").select(F.lit(SPAWN).alias("tool"), V("key").alias("source_session_id")))
        dead = staged(dead.unionByName(more).distinct(), "tombstones")
    if not rounds:
        return states, session.limit(0)
    refused = session.join(reduce(DataFrame.union, rounds).distinct(), "id", "left_semi")
    return _upsert(states, dead.withColumn("state", F.lit("deleted"))), refused
