"""Lineage of sessions: ancestor closure, visibility, trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.staging import staged


def closure(session: DataFrame, max_depth: int | None = 5) -> DataFrame:
    """``(ancestor_id, descendant_id, depth)``, every session at depth 0 of itself.

    Each level is staged and joined to the links once, until it has nothing new or
    ``max_depth`` (None: no bound) is reached.  A pair is kept at its least depth, so cycles
    end.
    """
    links = session.where("parent_session_id IS NOT NULL AND parent_session_id <> id").select(F.col("parent_session_id").alias("_parent"), F.col("id").alias("_child")).distinct()
    links = staged(links, "session-links")
    itself = session.select(F.col("id").alias("ancestor_id"), F.col("id").alias("descendant_id"), F.lit(0).alias("depth"))
    # A link whose parent isn't there has no ancestor.
    known = session.select(F.col("id").alias("_parent"))
    level = staged(links.join(known, "_parent", "left_semi").select(F.col("_parent").alias("ancestor_id"), F.col("_child").alias("descendant_id"), F.lit(1).alias("depth")), "closure")
    levels = []
    while max_depth is None or len(levels) < max_depth:
        if level.isEmpty():
            break
        levels.append(level)
        if len(levels) == max_depth:
            break
        seen = reduce(DataFrame.unionByName, levels).select("ancestor_id", "descendant_id")
        further = level.join(links, F.col("descendant_id") == F.col("_parent")).select("ancestor_id", F.col("_child").alias("descendant_id")).where("ancestor_id <> descendant_id").distinct()
        level = staged(further.join(seen, ["ancestor_id", "descendant_id"], "left_anti").withColumn("depth", F.lit(len(levels) + 1)), "closure")
    return reduce(DataFrame.unionByName, [itself, *levels])


def below(session: DataFrame, roots: DataFrame) -> DataFrame:
    """``(id)`` of the sessions of ``roots(id)`` and all under them, however deep; cycles end.
    Follows the few roots down, not every session up."""
    links = session.where("parent_session_id IS NOT NULL").select(F.col("parent_session_id").alias("_parent"), F.col("id").alias("_child"))
    level = staged(session.join(roots.select("id").distinct(), "id", "left_semi").select("id"), "below")
    if level.isEmpty():
        return level
    links = staged(links, "session-links")
    levels = []
    while not level.isEmpty():
        levels.append(level)
        seen = reduce(DataFrame.union, levels)
        further = level.join(links, level.id == links["_parent"]).select(F.col("_child").alias("id")).distinct()
        level = staged(further.join(seen, "id", "left_anti"), "below")
    return reduce(DataFrame.union, levels)


def hidden(session: DataFrame, states: DataFrame, include_archived: bool = False) -> DataFrame:
    """``(id)`` of the sessions under a deleted (or archived) one, itself included.
    ``states(id, state)``."""
    return below(session, states.where(F.col("state").isin("deleted", *([] if include_archived else ["archived"]))).select("id"))


def visible(session: DataFrame, states: DataFrame, include_archived: bool = False) -> DataFrame:
    return session.join(hidden(session, states, include_archived), "id", "left_anti")


def scoped(session: DataFrame, date_from: str | None = None, date_to: str | None = None, tool: str | None = None, project_id: int | None = None, states: DataFrame | None = None) -> DataFrame:
    """Sessions of a filter.  Days compare as text, both ends included; malformed days are
    ignored, and sessions without a start are out once a bound is set."""
    day = F.substring("started_at", 1, 10)
    tests: list[Column] = []
    if iso_day(date_from):
        tests.append(day >= date_from)
    if iso_day(date_to):
        tests.append(day <= date_to)
    if tool is not None:
        tests.append(F.col("tool") == tool)
    if project_id is not None:
        tests.append(F.col("project_id") == project_id)
    out = session
    for t in tests:
        out = out.where(t)
    return out if states is None else visible(out, states)


def iso_day(value: str | None) -> str | None:
    """A strict YYYY-MM-DD of the calendar, else None."""
    import datetime
    import re

    if value is None or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
        return None
    try:
        return datetime.date.fromisoformat(value).isoformat()
    except ValueError:
        return None


def subtree_totals(session: DataFrame, max_depth: int | None = 5) -> DataFrame:
    """Per top-level session: sessions and cost of its tree."""
    nodes = session.select(F.col("id").alias("descendant_id"), "cost_nano", "output_tokens")
    top = session.where("NOT is_subagent").select(F.col("id").alias("ancestor_id"))
    tree = closure(session, max_depth).join(top, "ancestor_id", "left_semi").join(nodes, "descendant_id")
    return tree.groupBy(F.col("ancestor_id").alias("session_id")).agg(
        (F.count("*") - 1).alias("subagents"), F.sum("cost_nano").alias("tree_cost_nano"), F.sum("output_tokens").alias("tree_output_tokens"), F.max("depth").alias("max_depth")
    )
