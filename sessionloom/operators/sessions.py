"""What a reader sees of sessions: which are shown, what they are called, what hangs on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.operators.lineage import closure
from sessionloom.staging import staged

V = F.col
# How texts begin that a program wrote, in any case.
WRAPPERS = ("<local-command-caveat>", "<local-command-stdout>", "<local-command-stderr>", "<local-command-output>", "<command-name>")
CONTEXT_TAGS = (
    "<permissions instructions>", "<multi_agent_mode>", "<collaboration_mode>", "<skills_instructions>", "<apps_instructions>", "<plugins_instructions>", "<recommended_plugins>",
)
CONTEXT_STARTS = ("<fork-boilerplate>", "the following is the codex agent history", "use prior reviews as context")
CONTEXT_PARTS = ("<environment_context>", "<INSTRUCTIONS>")
CONTEXT_HEADING = "# AGENTS.md instructions"
TITLE_CHARS, LEVELS = 180, 5
_ANSI = "\\x1b\\[[0-?]*[ -/]*[@-~]"
_SPACE = r"(?U)[\s﻿]+"


def _starts(text: Column, beginnings) -> Column:
    low, out = F.lower(text), F.lit(False)
    for x in beginnings:
        out = out | low.startswith(x)
    return out


def wrapper_only(session: DataFrame, message: DataFrame, block: DataFrame) -> DataFrame:
    """``(id)`` of the first producer's sessions that local commands alone have made: called by
    the caveat, without model, tokens or cost, without any reply and any text of a user's
    own."""
    none = lambda c: F.coalesce(V(c), F.lit(0)) == 0
    odd = session.where((V("tool") == "claude_code") & _starts(F.coalesce("title", F.lit("")), WRAPPERS[:1]) & V("model").isNull() & none("input_tokens") & none("output_tokens") & none("cost_nano")).select("id")
    # Few sessions look like that; only their messages are looked at.
    said = message.select(V("session_id").alias("id"), "seq", "role").join(odd, "id", "left_semi")
    replies = said.where("role = 'assistant'").select("id")
    text = F.ltrim(V("text"))
    own = block.where("type = 'text' AND trim(text) <> ''").where(~_starts(text, WRAPPERS)).select(V("session_id").alias("id"), "seq")
    people = said.where("role = 'user'").join(own, ["id", "seq"], "left_semi").select("id")
    return odd.join(replies.union(people).distinct(), "id", "left_anti")


def shown(session: DataFrame, message: DataFrame, block: DataFrame) -> DataFrame:
    """The sessions without those that local commands alone have made."""
    return session.join(wrapper_only(session, message, block), "id", "left_anti")


# Titles.


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def preview(text: Column, most: int = TITLE_CHARS) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def stripped(text: Column) -> Column:
    """Without terminal codes, and without white space around it."""
    return F.regexp_replace(F.regexp_replace(text, _ANSI, ""), r"^(?U)[\s﻿]+|(?U)[\s﻿]+$", "")


def task_title(text: Column) -> Column:
    """What a subagent was told to do, of the two forms that say so; else null."""
    summary = F.regexp_extract(text, r'(?i)summary="([^"]*)"', 1)
    of_teammate = F.when(F.regexp_like(text, F.lit(r'(?i)summary="[^"]*"')), _flat(summary))
    directive = F.regexp_extract(text, r"(?is)^.*?Your directive:\s*(.*)$", 1)
    # Up to the first heading in capitals after an empty line.
    section = _flat(F.split(F.trim(directive), r"\n\s*\n(?=[A-Z][A-Z /-]{2,}:)")[0])
    of_fork = F.when(F.regexp_like(text, F.lit(r"(?i)Your directive:")) & (section != ""), section)
    title = F.when(F.regexp_like(text, F.lit(r"(?i)^<teammate-message\b")), of_teammate).when(_starts(text, ("<fork-boilerplate>",)), of_fork)
    return preview(title)


def is_context(text: Column) -> Column:
    """Texts in a user's place that no user wrote."""
    at = F.ltrim(text)
    found = _starts(at, WRAPPERS + CONTEXT_TAGS + CONTEXT_STARTS) | at.startswith(CONTEXT_HEADING)
    found = found | F.regexp_like(at, F.lit(r"(?i)^<teammate-message\b")) | F.regexp_like(at, F.lit(r"""(?i)^You are\s+[`'"]?/?root[`'"]?,\s+the primary agent\b"""))
    for x in CONTEXT_PARTS:
        found = found | at.contains(x)
    return found


def readable(text: Column, is_subagent: Column) -> Column:
    """A title from a text; null of one that makes none."""
    plain = stripped(text)
    task = F.when(is_subagent, task_title(plain))
    return F.when(plain != "", F.coalesce(task, F.when(~is_context(plain), preview(_flat(plain)))))


def display_titles(session: DataFrame, message: DataFrame, block: DataFrame) -> DataFrame:
    """``(id, title)`` of all sessions: of the user's texts in order the first that makes one,
    else the title that the transcript gave; null where neither does.

    Summaries after a compaction, texts of developers and, in sessions that aren't subagents,
    copies of a subagent's rows are no user's."""
    s = session.select(V("id").alias("session_id"), F.coalesce("is_subagent", F.lit(False)).alias("sub"), "title")
    human = (V("role") == "user") & (F.coalesce("payload_role", F.lit("user")) == "user") & ~F.coalesce("is_compact_summary", F.lit(False))
    said = message.where(human).select("session_id", "seq", F.coalesce("is_sidechain", F.lit(False)).alias("side"))
    texts = block.where("type = 'text' AND text IS NOT NULL").select("session_id", "seq", "ordinal", "text")
    rows = texts.join(said, ["session_id", "seq"]).join(s.select("session_id", "sub"), "session_id").where("sub OR NOT side")
    rows = rows.select("session_id", "seq", "ordinal", readable(V("text"), V("sub")).alias("own")).where("own IS NOT NULL")
    first = rows.groupBy("session_id").agg(F.min_by("own", F.struct("seq", "ordinal")).alias("own"))
    return s.join(first, "session_id", "left").select(V("session_id").alias("id"), F.coalesce("own", readable(V("title"), V("sub"))).alias("title"))


# What hangs on a session.

_LEAF = ("id", "title", "tool", "agent_id", "agent_type", "spawn_tool_use_id", "spawn_depth", "started_at")


def trees(session: DataFrame, roots: DataFrame | None = None, levels: int = LEVELS) -> DataFrame:
    """``(id, subagents)`` of each session of ``roots(id)``, by default those without a parent
    that is there: its subagents by depth, start and id, each with its own, down to
    ``levels``.  Sessions under more than one of each other's, in a cycle, come once.

    Levels are put together from the lowest up, a join and a group for each."""
    links = staged(closure(session, levels), "tree-links")
    if roots is None:
        there = session.select(V("id").alias("parent_session_id"))
        roots = session.where("parent_session_id IS NULL").select("id").union(session.join(there, "parent_session_id", "left_anti").select("id")).distinct()
    places = links.join(roots.select(V("id").alias("ancestor_id")), "ancestor_id", "left_semi")
    nodes = places.join(session.select(*_LEAF, V("parent_session_id").alias("up")), V("descendant_id") == V("id"))
    below, kind = None, "array<string>"
    for depth in range(levels, 0, -1):
        at = nodes.where(V("depth") == depth)
        if below is None:
            at = at.withColumn("subagents", F.array().cast("array<string>"))
        else:
            at = at.join(below, ["ancestor_id", "id"], "left").withColumn("subagents", F.coalesce("subagents", F.array().cast(kind)))
        order = F.struct(F.coalesce("spawn_depth", F.lit(0)).alias("a"), V("started_at").alias("b"), V("id").alias("c"), F.struct(*_LEAF, "subagents").alias("node"))
        below = at.groupBy("ancestor_id", "up").agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["node"]).alias("subagents")).withColumnRenamed("up", "id")
        kind = below.schema["subagents"].dataType.simpleString()
    top = roots.select("id").distinct().join(session.select("id"), "id", "left_semi")
    own = below.where("ancestor_id = id").select("id", "subagents")
    return top.join(own, "id", "left").select("id", F.coalesce("subagents", F.array().cast(kind)).alias("subagents"))


def detail(session_id: int, message: DataFrame, block: DataFrame, tool_call: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """The session's messages in order, a page of them with ``limit``, each with its blocks;
    results are named by the tool whose call they end."""
    said = message.where(V("session_id") == session_id).select("seq", "role", "timestamp", "model", "context_tokens", "output_tokens", "is_sidechain", "is_boundary", "compact_trigger", "pre_tokens", "is_compact_summary")
    said = said.withColumn("role", F.coalesce("role", F.lit("unknown"))).orderBy("seq")
    if limit:
        said = said.offset(max(0, offset)).limit(limit)
    ends = tool_call.where((V("session_id") == session_id) & V("result_seq").isNotNull()).groupBy(V("result_seq").alias("seq"), V("result_ordinal").alias("ordinal")).agg(F.first("tool_name").alias("of_tool"))
    own = block.where(V("session_id") == session_id).join(ends, ["seq", "ordinal"], "left").withColumn("tool_name", F.coalesce("tool_name", "of_tool"))
    own = own.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("ordinal", "type", "text", "tool_name", "tool_use_id", "tool_input", "tool_result"))).alias("blocks"))
    out = said.join(own, "seq", "left")
    return out.withColumn("blocks", F.coalesce("blocks", F.array().cast(own.schema["blocks"].dataType))).orderBy("seq")


def totals(session: DataFrame, message: DataFrame, tool_call: DataFrame) -> DataFrame:
    """``(id, replies, tool_calls)`` of each session, whatever page of it is shown."""
    replies = message.where("role = 'assistant'").groupBy(V("session_id").alias("id")).agg(F.count("*").alias("replies"))
    calls = tool_call.groupBy(V("session_id").alias("id")).agg(F.count("*").alias("tool_calls"))
    return session.select("id").join(replies, "id", "left").join(calls, "id", "left").fillna(0, ["replies", "tool_calls"])


def outline(message: DataFrame, block: DataFrame, most: int = 240) -> DataFrame:
    """``(session_id, seq, excerpt)``: the first text that isn't blank of each message of a user,
    summaries after a compaction left out."""
    said = message.where((V("role") == "user") & ~F.coalesce("is_compact_summary", F.lit(False))).select("session_id", "seq")
    texts = block.where("type = 'text' AND trim(text) <> ''").select("session_id", "seq", "ordinal", F.substring("text", 1, most).alias("text"))
    return texts.join(said, ["session_id", "seq"], "left_semi").groupBy("session_id", "seq").agg(F.min_by("text", "ordinal").alias("excerpt"))


def rollups(session: DataFrame) -> DataFrame:
    """``(id, subagents, own_nano, all_nano)``: each session's cost with all under it."""
    pairs = staged(closure(session, None), "rollup-links")
    cost = session.select(V("id").alias("descendant_id"), F.coalesce("cost_nano", F.lit(0)).alias("nano"))
    sums = pairs.join(cost, "descendant_id").groupBy(V("ancestor_id").alias("id")).agg((F.count("*") - 1).alias("subagents"), F.sum("nano").cast("long").alias("all_nano"))
    return session.select("id", F.coalesce("cost_nano", F.lit(0)).alias("own_nano")).join(sums, "id")
