"""Lists, pages and reports over a part of an archive: what a reader asks for, and of which
sessions or calls.

Scopes are applied before anything is joined or counted.  A page is cut from narrow rows
first; titles, sums and previews are made for its rows alone.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.functions.cost import usd
from sessionloom.functions.records import preview_head_tail
from sessionloom.operators import lineage, sessions, user_state
from sessionloom.operators.stats import mcp_evidence, nearest_rank
from sessionloom.schema import Archive
from sessionloom.staging import staged

V = F.col
#: Rows of a page where none are asked for, calls on one at most, files of a session's report.
PAGE, MOST_CALLS, HOT_FILES = 50, 100, 25
INPUT_CHARS = 500
OPS = ("read", "edit", "write", "delete")
FACETS = (
    "turn_count", "error_count", "interruption_count", "compaction_count", "sidechain_count", "agent_spawn_count", "skill_count", "command_count", "thinking_count", "thinking_bytes",
    "active_seconds", "outcome", "work_type",
)


@dataclass(frozen=True)
class Scope:
    """Which sessions a read is about; a field of None limits nothing.

    Days are those of the sessions' starts, both ends included.  ``model`` and ``project`` (a
    path) of "" mean sessions without one; ``place`` is a project's name, path or root."""

    date_from: str | None = None
    date_to: str | None = None
    tool: str | None = None
    model: str | None = None
    project: str | None = None
    place: str | None = None
    work_type: str | None = None
    session_id: int | None = None
    include_archived: bool = False
    include_subagents: bool = True


@dataclass(frozen=True)
class CallScope:
    """Which tool calls a read is about.  Days are those of the calls, not of their sessions."""

    date_from: str | None = None
    date_to: str | None = None
    tool: str | None = None
    server: str | None = None
    project: str | None = None
    session_id: int | None = None
    errors_only: bool = False
    least_ms: int | None = None


def _limit(value: int | None, default: int = PAGE, most: int | None = None) -> int:
    """A page's rows: the default for None and for what isn't positive."""
    if value is None or value <= 0:
        return default
    return value if most is None else min(value, most)


def _of_project(session: DataFrame, project: DataFrame, path: str) -> DataFrame:
    if path == "":
        return session.join(project.where("path <> ''").select(V("id").alias("project_id")), "project_id", "left_anti")
    return session.join(project.where(V("path") == path).select(V("id").alias("project_id")), "project_id", "left_semi")


def _hidden(a: Archive, include_archived: bool = False) -> DataFrame:
    """``(id)`` of the sessions that users' decisions hide."""
    return lineage.hidden(a.session, user_state.direct_states(a.session, a.user_state), include_archived)


def _seen(a: Archive, session: DataFrame, hidden: DataFrame) -> DataFrame:
    """Of the sessions those that are shown and not hidden."""
    return sessions.shown(session, a.message, a.block).join(hidden, "id", "left_anti").select(session.columns)


def sessions_in(a: Archive, scope: Scope = Scope(), hidden: DataFrame | None = None) -> DataFrame:
    """The archive's sessions that a scope leaves, as they are stored.  ``hidden``: what the
    decisions hide, if the caller has it already."""
    out = lineage.scoped(a.session, scope.date_from, scope.date_to, scope.tool)
    if scope.session_id is not None:
        out = out.where(V("id") == scope.session_id)
    if scope.model is not None:
        out = out.where(F.coalesce("model", F.lit("")) == scope.model)
    if scope.work_type is not None:
        out = out.where(V("work_type") == scope.work_type)
    if not scope.include_subagents:
        out = out.where("NOT is_subagent")
    if scope.project is not None:
        out = _of_project(out, a.project, scope.project)
    if scope.place is not None:
        here = (V("name") == scope.place) | (V("path") == scope.place) | (F.coalesce("root_path", "path") == scope.place)
        out = out.join(a.project.where(here).select(V("id").alias("project_id")), "project_id", "left_semi")
    return _seen(a, out.select(a.session.columns), _hidden(a, scope.include_archived) if hidden is None else hidden)


def calls_in(a: Archive, scope: CallScope = CallScope(), hidden: DataFrame | None = None) -> DataFrame:
    """The tool calls that a scope leaves, of sessions that are shown; ``hidden`` as above."""
    calls, day = a.tool_call, F.substring("timestamp", 1, 10)
    tests = [
        (scope.tool, lambda x: V("tool_name") == x), (scope.server, lambda x: V("mcp_server") == x), (scope.session_id, lambda x: V("session_id") == x),
        (scope.date_from, lambda x: day >= x), (scope.date_to, lambda x: day <= x), (scope.least_ms, lambda x: V("duration_ms") >= max(0, x)),
    ]
    for value, test in tests:
        if value is not None:
            calls = calls.where(test(value))
    if scope.errors_only:
        calls = calls.where("is_error")
    s = a.session if scope.session_id is None else a.session.where(V("id") == scope.session_id)
    if scope.project is not None:
        s = _of_project(s, a.project, scope.project).select(a.session.columns)
    return calls.join(_seen(a, s, _hidden(a) if hidden is None else hidden).select(V("id").alias("session_id")), "session_id", "left_semi").select(a.tool_call.columns)


# Lists.


def state_columns(a: Archive, session: DataFrame) -> DataFrame:
    """``(id, user_state, is_user_archived)``: what a user decided about the session itself, and
    whether it or one above it is archived."""
    direct = user_state.direct_states(session, a.user_state).withColumnRenamed("state", "user_state")
    archived = user_state.effective_archived(a.session, a.user_state).select("id", F.lit(True).alias("is_user_archived"))
    out = session.select("id").join(direct, "id", "left").join(archived, "id", "left")
    return out.select("id", "user_state", F.coalesce("is_user_archived", F.lit(False)).alias("is_user_archived"))


def session_page(a: Archive, scope: Scope = Scope(include_subagents=False), limit: int | None = None, offset: int = 0, servers: tuple[str, ...] = ()) -> DataFrame:
    """A page of sessions, the newest first, then by id: with titles, projects, states, sums over
    their subagents, issues of their files, and calls to ``servers`` in them and below.

    Sums and texts are looked up for the page's sessions only."""
    order = [V("started_at").desc_nulls_last(), V("id").desc()]
    hidden = _hidden(a, scope.include_archived)
    top = staged(sessions_in(a, scope, hidden).orderBy(*order).offset(max(0, offset)).limit(_limit(limit)), "session-page")
    mine = top.select(V("id").alias("session_id"))
    titles = sessions.display_titles(top, a.message.join(mine, "session_id", "left_semi"), a.block.join(mine, "session_id", "left_semi")).withColumnRenamed("title", "display_title")
    children = a.session.where("is_subagent").join(top.select(V("id").alias("parent_session_id")), "parent_session_id", "left_semi").select(a.session.columns)
    below = _seen(a, children, hidden).groupBy(V("parent_session_id").alias("id"))
    below = below.agg(F.count("*").alias("subagents"), F.sum(F.coalesce("cost_nano", F.lit(0))).alias("subagent_nano"))
    issues = a.issue.join(top.select("source_path").distinct(), "source_path", "left_semi").groupBy("source_path")
    issues = issues.agg(F.count_if(V("code") == "unparsed_line").alias("issues"), F.count_if(V("code") != "unparsed_line").alias("remarks"))
    evidence = mcp_evidence(top, a.tool_call, lineage.closure(a.session), list(servers)) if servers else None
    out = top.join(a.project.select(V("id").alias("project_id"), V("path").alias("project")), "project_id", "left").join(titles, "id", "left").join(below, "id", "left")
    out = out.join(issues, "source_path", "left").join(state_columns(a, top), "id", "left")
    if evidence is not None:
        out = out.join(evidence.withColumnRenamed("session_id", "id"), "id", "left")
    else:
        out = out.withColumn("direct_calls", F.lit(0)).withColumn("tree_calls", F.lit(0))
    counted = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("subagents", "issues", "remarks", "direct_calls", "tree_calls")]
    return out.orderBy(*order).select(
        "id", "tool", "source_session_id", V("display_title").alias("title"), "project", "model", "reasoning_effort", "reasoning_effort_levels", "started_at", "ended_at", "message_count", "input_tokens", "output_tokens",
        F.coalesce("cost_nano", F.lit(0)).alias("cost_nano"), usd(F.coalesce("cost_nano", F.lit(0))).alias("cost_usd"), "user_state", "is_user_archived", "is_archived", "is_subagent", "parent_session_id", "spawn_tool_use_id", "agent_id", "agent_type", "spawn_depth",
        "context_window_tokens", "peak_context_tokens", "compaction_count", *counted, F.coalesce("subagent_nano", F.lit(0)).alias("subagent_nano"), usd(F.coalesce("subagent_nano", F.lit(0))).alias("subagent_cost_usd"),
    )


def session_index(a: Archive) -> DataFrame:
    """All top-level sessions that are shown, the newest first, for a search by title."""
    out = sessions_in(a, Scope(include_subagents=False)).join(a.project.select(V("id").alias("project_id"), V("path").alias("project")), "project_id", "left")
    return out.select("id", "title", "project", "tool", "model", "started_at").orderBy(V("started_at").desc_nulls_last(), V("id").desc())


def containing(session: DataFrame, project: DataFrame, titles: DataFrame, text: str) -> DataFrame:
    """``(id)`` of the sessions that name a text somewhere, in any case, or have a subagent that
    does, however deep; all for a blank text.  ``titles(id, title)``."""
    needle = text.strip().lower()
    if not needle:
        return session.select("id")
    rows = session.drop("title").join(titles.select("id", "title"), "id", "left").join(project.select(V("id").alias("project_id"), V("path").alias("project")), "project_id", "left")
    parts = F.concat(F.array("title", "model", "reasoning_effort", "tool", "project", "agent_type", "agent_id"), F.coalesce("reasoning_effort_levels", F.array().cast("array<string>")))
    named = rows.where(F.exists(parts, lambda p: F.coalesce(F.lower(p).contains(needle), F.lit(False)))).select("id")
    links = session.where("parent_session_id IS NOT NULL").select(V("id").alias("_child"), V("parent_session_id").alias("id"))
    # Upwards from the few that are named.
    found = level = staged(named, "named")
    links = staged(links, "session-links")
    while not level.isEmpty():
        up = level.join(links, level.id == links["_child"]).select(links["id"]).distinct().join(session.select("id"), "id", "left_semi")
        level = staged(up.join(found, "id", "left_anti"), "named")
        found = found.unionByName(level)
    return found


def projects(a: Archive) -> DataFrame:
    """Projects, those without sessions too: top-level sessions, cost with subagents, last end,
    tools, and how many worktrees hang on them."""
    s = sessions_in(a).groupBy("project_id").agg(
        F.count_if(~V("is_subagent")).alias("sessions"), F.sum(F.coalesce("cost_nano", F.lit(0))).alias("nano"), F.max("ended_at").alias("last_active"), F.array_sort(F.collect_set("tool")).alias("tools")
    )
    trees = a.project.where("is_worktree").groupBy(V("root_path").alias("path")).agg(F.count("*").alias("worktrees"))
    out = a.project.join(s, V("id") == V("project_id"), "left").join(trees, "path", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    tools = F.coalesce("tools", F.array().cast("array<string>"))
    out = out.select("id", "path", "name", zero("sessions").alias("sessions"), usd(zero("nano")).alias("cost_usd"), "last_active", "is_worktree", "root_path", "worktree_label", "worktree_tool", "root_source", zero("worktrees").alias("worktrees"), tools.alias("tools"))
    return out.orderBy(V("sessions").desc(), "path")


# Calls and files.


def call_page(a: Archive, scope: CallScope = CallScope(), limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of calls, the latest first, then by id, with their sessions' titles and projects and
    the beginning and end of long inputs."""
    order = [V("timestamp").desc_nulls_last(), V("id").desc()]
    top = calls_in(a, scope).orderBy(*order).offset(max(0, offset)).limit(_limit(limit, PAGE, MOST_CALLS))
    s = a.session.select(V("id").alias("session_id"), V("title").alias("session_title"), "project_id")
    out = top.join(s, "session_id").join(a.project.select(V("id").alias("project_id"), V("path").alias("project")), "project_id", "left")
    return out.orderBy(*order).select(
        "id", "session_id", "session_title", "project", "tool_name", "tool_kind", "mcp_server", preview_head_tail(V("input"), INPUT_CHARS).alias("input_preview"), "input_bytes", "output_preview", "output_bytes", "is_error",
        "has_result", "duration_ms", "timestamp", "seq",
    )


def _call_counts() -> list[Column]:
    return [F.count("*").alias("calls"), F.count_if("is_error").alias("errors"), nearest_rank("duration_ms", 0.5).alias("p50_ms"), nearest_rank("duration_ms", 0.95).alias("p95_ms")]


def call_summary(a: Archive, scope: CallScope = CallScope()) -> DataFrame:
    """One row over all calls of a scope, whatever page of them is shown: how many, failed ones
    as a count and per cent, percentiles of durations, and the tool with most calls."""
    calls = calls_in(a, scope)
    by_tool = calls.where("tool_name IS NOT NULL").groupBy("tool_name").agg(F.count("*").alias("n"))
    # Of tools with as many calls the first by name.
    top = by_tool.agg(F.min_by("tool_name", F.struct(-V("n"), "tool_name")).alias("top_tool"))
    rate = F.when(V("calls") == 0, 0.0).otherwise(V("errors") / V("calls") * 100)
    return calls.agg(*_call_counts()).crossJoin(F.broadcast(top)).select("calls", "errors", F.round(rate, 6).alias("error_pct"), "p50_ms", "p95_ms", "top_tool")  # one row each


def tool_summary(tool_call: DataFrame, session_id: int | None = None) -> DataFrame:
    """A session's calls (or each one's) by tool, kind and server, most calls first; nameless
    ones as (unknown)."""
    calls = tool_call if session_id is None else tool_call.where(V("session_id") == session_id)
    calls = calls.withColumn("tool_name", F.coalesce("tool_name", F.lit("(unknown)")))
    out = calls.groupBy("session_id", "tool_name", "tool_kind", "mcp_server").agg(*_call_counts())
    return out.orderBy("session_id", V("calls").desc(), "tool_name", "tool_kind", V("mcp_server").asc_nulls_first())


def _each(refs: DataFrame, group: str) -> DataFrame:
    """Counts of a key in each session: a file that everyone touches is summed from few rows
    afterwards, and its sessions need no distinct count."""
    key = {"path": F.coalesce("rel_path", "path", F.lit("")), "ext": F.coalesce("ext", F.lit("(none)"))}[group]
    project = V("project") if group == "path" else F.lit(None).cast("string")
    return refs.groupBy(key.alias("key"), project.alias("project"), "session_id").agg(*[F.count_if(V("operation") == op).alias(f"{op}s") for op in OPS], F.max("timestamp").alias("last_touch"))


def _most() -> list[Column]:
    return [(V("reads") + V("edits") + V("writes") + V("deletes")).desc(), V("key").asc(), V("project").asc_nulls_first()]


def _with_project(refs: DataFrame, session: DataFrame, project: DataFrame) -> DataFrame:
    s = session.select(V("id").alias("session_id"), "project_id")
    return refs.join(s, "session_id").join(project.select(V("id").alias("project_id"), V("path").alias("project")), "project_id", "left")


def file_hotspots(a: Archive, group: str = "path", operation: str | None = None, scope: Scope = Scope(), limit: int | None = None) -> DataFrame:
    """Files (by their path within the project, and project) or extensions, most operations
    first, of a scope's sessions."""
    refs = a.file_ref if operation is None else a.file_ref.where(V("operation") == operation)
    each = _each(_with_project(refs.select("session_id", "path", "rel_path", "ext", "operation", "timestamp"), sessions_in(a, scope), a.project), group)
    out = each.groupBy("key", "project").agg(*[F.sum(f"{op}s").alias(f"{op}s") for op in OPS], F.count("*").alias("sessions"), F.max("last_touch").alias("last_touch"))
    return out.orderBy(*_most()).limit(_limit(limit))


def hot_files(a: Archive, session_id: int | None = None) -> DataFrame:
    """The files that a session (or each one) touched most."""
    refs = a.file_ref if session_id is None else a.file_ref.where(V("session_id") == session_id)
    each = _each(_with_project(refs, a.session, a.project), "path")
    rank = F.row_number().over(W.partitionBy("session_id").orderBy(*_most()))
    return each.withColumn("rank", rank).where(V("rank") <= HOT_FILES).select("session_id", "rank", "key", "project", *[f"{op}s" for op in OPS], "last_touch").orderBy("session_id", "rank")


# One session, one day.


def facets(session: DataFrame, session_id: int | None = None) -> DataFrame:
    """The stored counters of a session, or of all."""
    rows = session if session_id is None else session.where(V("id") == session_id)
    return rows.select("id", *FACETS)


def day_totals(a: Archive, day: str, scope: Scope = Scope()) -> DataFrame:
    """One row for the sessions that began on a day; the caller's clock says which is today."""
    s = staged(sessions_in(a, replace(scope, date_from=day, date_to=day)), "day-sessions")
    sums = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "reasoning_tokens", "reasoning_estimate")
    out = s.agg(F.count_if(~V("is_subagent")).alias("sessions"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], usd(F.coalesce(F.sum("cost_nano"), F.lit(0))).alias("cost_usd"))
    of = s.select(V("id").alias("session_id"))
    for name, rows in (("messages", a.message), ("tool_calls", a.tool_call)):
        out = out.crossJoin(F.broadcast(rows.join(of, "session_id", "left_semi").agg(F.count("*").alias(name))))  # one row each
    return out


def issues_of(session: DataFrame, issue: DataFrame, session_id: int) -> DataFrame | None:
    """What the last reading of a session's file found, in order of lines; None if there is no
    such session, no rows if nothing was found or the session has no file."""
    found = session.where(V("id") == session_id).select("source_path").first()
    if found is None:
        return None
    return issue.where(V("source_path") == found["source_path"]).select("code", "line_no", "error", "raw_line").orderBy("line_no", "code")


def outline(message: DataFrame, block: DataFrame, tool_call: DataFrame, servers: tuple[str, ...] = ()) -> DataFrame:
    """``(session_id, seq, ordinal, kind, text)``: prompts (at ordinal -1) and calls to the
    servers, in the order in which a session had them."""
    prompts = sessions.outline(message, block).select("session_id", "seq", F.lit(-1).alias("ordinal"), F.lit("prompt").alias("kind"), V("excerpt").alias("text"))
    calls = tool_call.where((V("tool_kind") == "mcp") & V("mcp_server").isin(*servers))
    name = F.coalesce(F.when(V("mcp_tool") != "", V("mcp_tool")), V("tool_name"))
    return prompts.unionByName(calls.select("session_id", "seq", "ordinal", F.lit("call").alias("kind"), name.alias("text"))).orderBy("session_id", "seq", "ordinal")


def grouped_hits(hits: DataFrame) -> DataFrame:
    """A page of hits ``(rank, session_id, ...)`` with each session's hits together, sessions by
    their first."""
    first = F.min("rank").over(W.partitionBy("session_id"))
    return hits.withColumn("first_rank", first).orderBy("first_rank", "rank")


# Names of servers.  Fixed values: how namespaces begin; a generated id stays as it is.
_CONNECTOR, _PLUGIN, _SEPARATOR = "^claude_ai_", "^plugin_([^_]+)_", "[-_]+"
_GENERATED = "(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def _bare(server: Column) -> Column:
    return F.when(F.regexp_like(server, F.lit(_CONNECTOR)), F.regexp_replace(server, _CONNECTOR, "")).otherwise(F.regexp_replace(server, _PLUGIN, ""))


def server_name(server: Column) -> Column:
    """A server's name as read: without its namespace, words apart and with capitals; "" for
    none."""
    words = F.filter(F.split(_bare(server), _SEPARATOR), lambda w: w != "")
    spoken = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")
    return F.coalesce(F.when(F.regexp_like(_bare(server), F.lit(_GENERATED)), _bare(server)).otherwise(spoken), F.lit(""))


def server_origin(server: Column) -> Column:
    """Where a server comes from: a connector, a plugin (named if it adds something) or local."""
    plugin = F.regexp_extract(server, _PLUGIN, 1)
    of_plugin = F.when(F.lower(plugin) == F.lower(_bare(server)), "plugin").otherwise(F.concat(plugin, F.lit(" plugin")))
    return F.when(F.regexp_like(server, F.lit(_CONNECTOR)), "connector").when(plugin == "", "local").otherwise(of_plugin)


def server_labels(servers: DataFrame) -> DataFrame:
    """``(mcp_server, label)`` of each server there is: its name, with its origin where another
    server has the same name."""
    known = servers.where("mcp_server <> ''").select("mcp_server").distinct().withColumn("name", server_name(V("mcp_server")))
    shared = F.count("*").over(W.partitionBy("name")) > 1
    return known.select("mcp_server", F.when(shared, F.concat("name", F.lit(" ("), server_origin(V("mcp_server")), F.lit(")"))).otherwise(V("name")).alias("label"))
