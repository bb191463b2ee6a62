"""Canonical tables over the driver's tables.

The driver's tables hold no transcripts; this mapping gives the analytics something to
run on: users' days are sessions, events are tool calls, conversations are messages,
line items are file references.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.cost import with_cost

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "user_id", "event_type", "value", "props", F.dayofmonth("ts").alias("day"),
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("session_id"), F.date_format("ts", ISO).alias("iso"), F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each user and day; some are subagents of the user's day before."""
    e = _events(spark, sf_dir)
    s = e.groupBy(F.col("session_id").alias("id"), "user_id", "day").agg(
        F.min("iso").alias("started_at"), F.max("iso").alias("ended_at"), F.count("*").alias("message_count"),
        F.sum(F.col("event_id") % 997 + 10).alias("input_tokens"), F.sum(F.col("event_id") % 89 + 1).alias("output_tokens"),
        F.sum(F.col("event_id") % 13 * 100).alias("cache_read_tokens"), F.sum(F.col("event_id") % 7 * 10).alias("cache_creation_tokens"),
        F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).cast("long").alias("error_count"),
        F.max_by("event_type", "event_id").alias("last_event"),
    )
    before = s.select((F.col("id") + 1).alias("id"), F.lit(True).alias("has_parent"))
    s = s.join(before, "id", "left").withColumn("parent_session_id", F.when(F.col("has_parent") & ((F.col("user_id") + F.col("day")) % 5 == 0), F.col("id") - 1))
    s = s.withColumn("is_subagent", F.col("parent_session_id").isNotNull())
    s = s.withColumn("tool", F.when(F.col("user_id") % 2 == 0, "claude_code").otherwise("codex")).withColumn("project_id", F.col("user_id") % 7)
    model = F.when(F.col("user_id") % 4 == 0, "claude-opus-4-7").when(F.col("user_id") % 4 == 1, "claude-sonnet-4-5").when(F.col("user_id") % 4 == 2, "gpt-5.4")
    s = s.withColumn("model", model).withColumn("source_session_id", F.concat(F.lit("u"), F.col("id").cast("string")))
    s = s.withColumn("outcome", F.when(F.col("last_event") == "error", "failed").when(F.col("last_event") == "purchase", "completed").when(F.col("last_event") == "click", "abandoned"))
    return with_cost(s.drop("has_parent", "last_event"))


def event_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    mcp = F.col("event_type").isin("purchase", "signup")
    return e.select(
        F.col("event_id").alias("id"), "session_id", F.col("event_type").alias("tool_name"), F.when(mcp, "mcp").otherwise("builtin").alias("tool_kind"),
        F.when(mcp, F.concat(F.lit("srv"), (F.col("user_id") % 3).cast("string"))).alias("mcp_server"),
        F.when(F.col("k") % 11 != 0, F.col("event_type") == "error").alias("is_error"), F.when(F.col("k") % 10 != 0, F.floor(F.col("value") * 10)).alias("duration_ms"),
        F.col("props").alias("input"), F.octet_length("props").cast("long").alias("input_bytes"), (F.col("event_id") % 4001).alias("output_bytes"), F.col("iso").alias("timestamp"),
    )


def event_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(7).select("id", F.concat(F.lit("/work/p"), F.col("id").cast("string")).alias("path"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"))


def event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 17th session is deleted, every 13th archived."""
    s = _events(spark, sf_dir).select(F.col("session_id").alias("id")).distinct()
    state = F.when(F.col("id") % 17 == 0, "deleted").when(F.col("id") % 13 == 0, "archived")
    return s.select("id", state.alias("state")).where("state IS NOT NULL")


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of one text block each, 90 seconds apart."""
    c = table(spark, sf_dir, "conversations")
    epoch = F.lit(1_704_067_200) + F.col("conv_id") * 3600 + F.col("turn") * 90
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", "text", epoch.alias("epoch"), size.alias("bytes"))


def line_file_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file reference for each line item; the part names the file."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus", "l_shipdate")
    op = F.when(F.col("l_returnflag") == "R", "delete").when(F.col("l_returnflag") == "A", "read").when(F.col("l_linestatus") == "F", "edit").otherwise("write")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("rs", "md", "py", "ts")]), (F.col("p_size") % 4 + 1).cast("int"))
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("session_id"), F.concat_ws("", F.col("p_brand"), F.lit("/f"), F.col("p_partkey").cast("string"), F.lit("."), ext).alias("path"), ext.alias("ext"),
        op.alias("operation"), F.date_format("l_shipdate", ISO).alias("timestamp"),
    )


#: The same tables in DuckDB SQL, for the oracles.
CTE = {
    "ev": """ev AS (SELECT event_id, user_id, event_type, value, props, day(ts) AS day, user_id * 100 + day(ts) AS session_id,
      strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
    "session": """s0 AS (SELECT session_id AS id, user_id, day, min(iso) AS started_at, max(iso) AS ended_at, count(*) AS message_count,
      sum(event_id % 997 + 10)::BIGINT AS input_tokens, sum(event_id % 89 + 1)::BIGINT AS output_tokens, sum(event_id % 13 * 100)::BIGINT AS cache_read_tokens,
      sum(event_id % 7 * 10)::BIGINT AS cache_creation_tokens, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS error_count, max_by(event_type, event_id) AS last_event
      FROM ev GROUP BY ALL),
    session AS (SELECT s0.* EXCLUDE (last_event),
      CASE WHEN (user_id + day) % 5 = 0 AND EXISTS (SELECT 1 FROM s0 p WHERE p.id = s0.id - 1) THEN id - 1 END AS parent_session_id,
      coalesce((user_id + day) % 5 = 0 AND EXISTS (SELECT 1 FROM s0 p WHERE p.id = s0.id - 1), false) AS is_subagent,
      CASE WHEN user_id % 2 = 0 THEN 'claude_code' ELSE 'codex' END AS tool, user_id % 7 AS project_id,
      CASE user_id % 4 WHEN 0 THEN 'claude-opus-4-7' WHEN 1 THEN 'claude-sonnet-4-5' WHEN 2 THEN 'gpt-5.4' END AS model,
      CASE last_event WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'abandoned' END AS outcome,
      CASE user_id % 4 WHEN 0 THEN input_tokens * 5000 + cache_read_tokens * 500 + cache_creation_tokens * 6250
        WHEN 1 THEN input_tokens * 3000 + cache_read_tokens * 300 + cache_creation_tokens * 3750
        WHEN 2 THEN input_tokens * 2500 + cache_read_tokens * 250 + cache_creation_tokens * 2500 ELSE 0 END AS cost_in_nano,
      output_tokens * CASE user_id % 4 WHEN 0 THEN 25000 WHEN 1 THEN 15000 WHEN 2 THEN 15000 ELSE 0 END AS cost_out_nano,
      cost_in_nano + cost_out_nano AS cost_nano FROM s0)""",
    "tool_call": """tool_call AS (SELECT event_id AS id, session_id, event_type AS tool_name,
      CASE WHEN event_type IN ('purchase', 'signup') THEN 'mcp' ELSE 'builtin' END AS tool_kind,
      CASE WHEN event_type IN ('purchase', 'signup') THEN 'srv' || (user_id % 3) END AS mcp_server,
      CASE WHEN k % 11 <> 0 THEN event_type = 'error' END AS is_error, CASE WHEN k % 10 <> 0 THEN floor(value * 10)::BIGINT END AS duration_ms,
      props AS input, strlen(props)::BIGINT AS input_bytes, event_id % 4001 AS output_bytes, iso AS timestamp FROM ev)""",
    "project": "project AS (SELECT range AS id, '/work/p' || range AS path, 'p' || range AS name FROM range(7))",
    "state": "state AS (SELECT id, CASE WHEN id % 17 = 0 THEN 'deleted' ELSE 'archived' END AS state FROM s0 WHERE id % 17 = 0 OR id % 13 = 0)",
    "closure": """closure AS (WITH RECURSIVE c(ancestor_id, descendant_id, depth) AS (
      SELECT id, id, 0 FROM session UNION ALL
      SELECT c.ancestor_id, s.id, c.depth + 1 FROM c JOIN session s ON s.parent_session_id = c.descendant_id) SELECT * FROM c)""",
    "chat": """chat AS (SELECT conv_id AS session_id, turn AS seq, role, text, 1704067200 + conv_id * 3600 + turn * 90 AS epoch,
      coalesce(strlen(text), 0)::BIGINT AS bytes FROM conversations)""",
    "file_ref": """file_ref AS (SELECT l_orderkey AS session_id, p_brand || '/f' || p_partkey || '.' || ['rs', 'md', 'py', 'ts'][p_size % 4 + 1] AS path,
      ['rs', 'md', 'py', 'ts'][p_size % 4 + 1] AS ext,
      CASE WHEN l_returnflag = 'R' THEN 'delete' WHEN l_returnflag = 'A' THEN 'read' WHEN l_linestatus = 'F' THEN 'edit' ELSE 'write' END AS operation,
      strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp FROM lineitem JOIN part ON l_partkey = p_partkey)""",
}
