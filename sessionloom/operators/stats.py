"""Aggregates over sessions, tool calls and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.functions.cost import usd


def nearest_rank(column: str, share: float) -> Column:
    """Nearest-rank percentile of the values that are there, as a whole number."""
    return F.expr(f"cast(percentile_disc({share}) WITHIN GROUP (ORDER BY {column}) AS bigint)")


def totals(session: DataFrame, tool_call: DataFrame) -> DataFrame:
    """One row.  ``sessions`` counts top-level ones; all else includes subagents."""
    s = session.agg(
        F.count_if(~F.col("is_subagent")).alias("sessions"), F.count("*").alias("all_sessions"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("messages"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "error_count")],
        usd(F.coalesce(F.sum("cost_nano"), F.lit(0))).alias("cost_usd"),
    )
    calls = tool_call.join(session.select(F.col("id").alias("session_id")), "session_id", "left_semi").agg(F.count("*").alias("tool_calls"))
    return s.crossJoin(F.broadcast(calls))  # two rows of one


def by_dimension(session: DataFrame, dimension: str, project: DataFrame | None = None) -> DataFrame:
    """Per tool, model, project or day: counts, tokens and cost, most sessions first."""
    if dimension == "project":
        session = session.join(project.select(F.col("id").alias("project_id"), F.col("path").alias("_path")), "project_id", "left")
    key = {"tool": F.col("tool"), "model": F.coalesce("model", F.lit("(unknown)")), "project": F.coalesce("_path", F.lit("(none)")) if dimension == "project" else None, "day": F.coalesce(F.substring("started_at", 1, 10), F.lit(""))}[dimension]
    out = session.groupBy(key.alias("key")).agg(
        F.count_if(~F.col("is_subagent")).alias("sessions"), *[F.sum(c).alias(c) for c in ("message_count", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")], usd(F.sum("cost_nano")).alias("cost_usd")
    )
    return out.orderBy(F.col("sessions").desc(), "key")


def tool_usage(tool_call: DataFrame, errors_only: bool = False, limit: int = 50) -> DataFrame:
    """Per tool: calls, errors, percentiles of the durations there are, last use."""
    out = tool_call.where("tool_name IS NOT NULL").groupBy("tool_name", "tool_kind", "mcp_server").agg(
        F.count("*").alias("calls"), F.count_if(F.col("is_error")).alias("errors"), nearest_rank("duration_ms", 0.5).alias("p50_ms"), nearest_rank("duration_ms", 0.95).alias("p95_ms"), F.max("timestamp").alias("last_used")
    )
    if errors_only:
        out = out.where("errors > 0")
    return out.orderBy(F.col("calls").desc(), "tool_name", "tool_kind", F.col("mcp_server").asc_nulls_first()).limit(limit)


def mcp_usage(tool_call: DataFrame, limit: int = 50) -> DataFrame:
    """Per server: its tools, calls, errors, percentiles of durations, last use."""
    out = tool_call.where("mcp_server IS NOT NULL").groupBy("mcp_server").agg(
        F.countDistinct("tool_name").alias("tools"), F.count("*").alias("calls"), F.count_if(F.col("is_error")).alias("errors"), nearest_rank("duration_ms", 0.5).alias("p50_ms"), nearest_rank("duration_ms", 0.95).alias("p95_ms"), F.max("timestamp").alias("last_used")
    )
    return out.orderBy(F.col("calls").desc(), "mcp_server").limit(limit)


def file_hotspots(file_ref: DataFrame, group: str = "path", operation: str | None = None, limit: int = 50) -> DataFrame:
    """Per path or extension: operations, distinct sessions, last touch."""
    refs = file_ref if operation is None else file_ref.where(F.col("operation") == operation)
    count = lambda op: F.count_if(F.col("operation") == op)
    out = refs.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("key")).agg(
        count("read").alias("reads"), count("edit").alias("edits"), count("write").alias("writes"), count("delete").alias("deletes"), F.countDistinct("session_id").alias("sessions"), F.max("timestamp").alias("last_touch")
    )
    return out.orderBy((F.col("reads") + F.col("edits") + F.col("writes") + F.col("deletes")).desc(), "key").limit(limit)


def activity(session: DataFrame, unit: str, time_zone: str = "UTC") -> DataFrame:
    """Sessions (subagents too) by hour of the day or weekday (0: Sunday), zeros filled in,
    and the first greatest one marked."""
    at = F.from_utc_timestamp(F.try_to_timestamp(F.col("started_at")), time_zone)
    slot = F.hour(at) if unit == "hour" else F.dayofweek(at) - 1
    counts = session.select(slot.alias("slot")).where("slot IS NOT NULL").groupBy("slot").agg(F.count("*").alias("sessions"))
    slots = session.sparkSession.range(24 if unit == "hour" else 7).select(F.col("id").cast("int").alias("slot"))
    out = slots.join(counts, "slot", "left").select("slot", F.coalesce("sessions", F.lit(0)).alias("sessions"))
    first = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("sessions").desc(), "slot")) == 1  # 24 rows
    return out.select("slot", "sessions", (first & (F.col("sessions") > 0)).alias("is_peak"))


def model_sparklines(session: DataFrame) -> DataFrame:
    """Per model its sessions on each day there is, days in order (dense)."""
    rows = session.where("started_at IS NOT NULL").groupBy(F.coalesce("model", F.lit("(unknown)")).alias("model"), F.substring("started_at", 1, 10).alias("day")).agg(F.count("*").alias("n"))
    grid = rows.select("model").distinct().crossJoin(rows.select("day").distinct())  # models by days
    dense = grid.join(rows, ["model", "day"], "left").select("model", F.struct("day", F.coalesce("n", F.lit(0)).alias("n")).alias("x"))
    return dense.groupBy("model").agg(F.array_sort(F.collect_list("x")).alias("x")).select("model", F.array_join(F.transform("x", lambda x: x.n.cast("string")), ",").alias("counts"))


def date_bounds(session: DataFrame) -> DataFrame:
    return session.agg(F.min(F.substring("started_at", 1, 10)).alias("first_day"), F.max(F.substring("started_at", 1, 10)).alias("last_day"))


def list_projects(session: DataFrame, project: DataFrame) -> DataFrame:
    """Projects with their top-level sessions (none: kept), cost, last end and tools."""
    s = session.where("NOT is_subagent").groupBy("project_id").agg(F.count("*").alias("sessions"), F.sum("cost_nano").alias("nano"), F.max("ended_at").alias("last_active"), F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"))
    out = project.join(s, project.id == s.project_id, "left")
    out = out.select("id", "path", "name", F.coalesce("sessions", F.lit(0)).alias("sessions"), usd(F.coalesce("nano", F.lit(0))).alias("cost_usd"), "last_active", F.coalesce("tools", F.lit("")).alias("tools"))
    return out.orderBy(F.col("sessions").desc(), "path")


def list_sessions(session: DataFrame, tree: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of top-level sessions, newest first, with the sums of their trees."""
    top = session.where("NOT is_subagent").orderBy(F.col("started_at").desc_nulls_last(), F.col("id").desc()).offset(offset).limit(limit)
    return top.join(tree, top.id == tree.session_id, "left").select("id", "tool", "model", "project_id", "started_at", "message_count", "subagents", usd(F.col("tree_cost_nano")).alias("tree_cost_usd"))


def list_tool_calls(tool_call: DataFrame, limit: int = 50, offset: int = 0, tool: str | None = None, server: str | None = None, errors_only: bool = False) -> DataFrame:
    calls = _call_filter(tool_call, tool, server, errors_only)
    return calls.orderBy(F.col("timestamp").desc_nulls_last(), F.col("id").desc()).offset(offset).limit(limit).select("id", "session_id", "tool_name", "mcp_server", "is_error", "duration_ms", "timestamp")


def tool_call_summary(tool_call: DataFrame, tool: str | None = None, server: str | None = None, errors_only: bool = False) -> DataFrame:
    calls = _call_filter(tool_call, tool, server, errors_only)
    return calls.agg(F.count("*").alias("calls"), F.count_if(F.col("is_error")).alias("errors"), nearest_rank("duration_ms", 0.5).alias("p50_ms"), nearest_rank("duration_ms", 0.95).alias("p95_ms"))


def _call_filter(calls: DataFrame, tool, server, errors_only) -> DataFrame:
    if tool is not None:
        calls = calls.where(F.col("tool_name") == tool)
    if server is not None:
        calls = calls.where(F.col("mcp_server") == server)
    return calls.where("is_error") if errors_only else calls


def tool_call_status(has_result: Column, is_error: Column) -> Column:
    """OK, Error, Completed (no status given), No result or Unknown."""
    return F.when(is_error, "Error").when(~is_error, "OK").when(has_result, "Completed").when(~has_result, "No result").otherwise("Unknown")


def mcp_evidence(session: DataFrame, tool_call: DataFrame, tree: DataFrame, servers: list[str]) -> DataFrame:
    """Per top-level session: calls to the servers, its own and in its tree."""
    calls = tool_call.where(F.col("mcp_server").isin(*servers)).groupBy(F.col("session_id").alias("descendant_id")).agg(F.count("*").alias("n"))
    top = session.where("NOT is_subagent").select(F.col("id").alias("ancestor_id"))
    found = tree.join(top, "ancestor_id", "left_semi").join(calls, "descendant_id")
    return found.groupBy(F.col("ancestor_id").alias("session_id")).agg(F.sum(F.when(F.col("depth") == 0, F.col("n")).otherwise(0)).alias("direct_calls"), F.sum("n").alias("tree_calls"))


def hot_context(file_ref: DataFrame, n: int = 15) -> DataFrame:
    """Files that are read, by sessions then reads."""
    out = file_ref.groupBy("path").agg(F.count_if(F.col("operation") == "read").alias("reads"), F.count_if(F.col("operation").isin("edit", "write", "delete")).alias("edits"), F.countDistinct("session_id").alias("sessions"))
    return out.where("reads > 0").orderBy(F.col("sessions").desc(), F.col("reads").desc(), "path").limit(n)


def capped_count(rows: DataFrame, cap: int = 1000) -> DataFrame:
    """Rows up to a cap, and whether there are more; reads one more than the cap."""
    n = rows.limit(cap + 1).agg(F.count("*").alias("n"))
    return n.select(F.least("n", F.lit(cap)).cast("long").alias("total"), (F.col("n") > cap).alias("capped"))
