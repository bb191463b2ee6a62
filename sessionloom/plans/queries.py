"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom import adapters as ad
from sessionloom.functions import commands
from sessionloom.functions.cost import usd
from sessionloom import schema
from sessionloom.operators import activity, context, distill, economics, enrich, export, fuzzy, lineage, reads, search, sessions, signals, stats, trajectory, user_state, worktree
from sessionloom.schema import Archive

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register a query and its SQL over the named canonical tables."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            parts = [ad.CTE[n] for n in needs]
            ORACLES[f.__name__] = (f"WITH {', '.join(parts)} " if parts else "") + sql
        return f

    return register


EV, SE, TC = ("ev",), ("ev", "session"), ("ev", "tool_call")
CALL_STATS = """count(*) AS calls, count(*) FILTER (is_error) AS errors, CAST(quantile_disc(duration_ms, 0.5) AS BIGINT) AS p50_ms,
  CAST(quantile_disc(duration_ms, 0.95) AS BIGINT) AS p95_ms"""
USD = "round(CAST(coalesce(sum(cost_nano), 0) AS DOUBLE) / 1000000000, 6) AS cost_usd"


@query(f"SELECT tool_name, tool_kind, mcp_server, {CALL_STATS}, max(timestamp) AS last_used FROM tool_call GROUP BY ALL ORDER BY calls DESC LIMIT 50", TC)
def tool_usage(spark: SparkSession, d: str) -> DataFrame:
    return stats.tool_usage(ad.event_tool_calls(spark, d))


@query(f"SELECT tool_name, tool_kind, mcp_server, {CALL_STATS}, max(timestamp) AS last_used FROM tool_call GROUP BY ALL HAVING errors > 0", TC)
def tool_usage_errors(spark: SparkSession, d: str) -> DataFrame:
    return stats.tool_usage(ad.event_tool_calls(spark, d), errors_only=True)


@query(f"SELECT mcp_server, count(DISTINCT tool_name) AS tools, {CALL_STATS}, max(timestamp) AS last_used FROM tool_call WHERE mcp_server IS NOT NULL GROUP BY mcp_server", TC)
def mcp_usage(spark: SparkSession, d: str) -> DataFrame:
    return stats.mcp_usage(ad.event_tool_calls(spark, d))


@query(
    f"""SELECT count(*) FILTER (NOT is_subagent) AS sessions, count(*) AS all_sessions, sum(message_count)::BIGINT AS messages, sum(input_tokens)::BIGINT AS input_tokens,
    sum(output_tokens)::BIGINT AS output_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens, sum(cache_creation_tokens)::BIGINT AS cache_creation_tokens,
    sum(error_count)::BIGINT AS error_count, {USD}, (SELECT count(*) FROM ev) AS tool_calls FROM session""",
    SE,
)
def totals(spark: SparkSession, d: str) -> DataFrame:
    return stats.totals(ad.event_sessions(spark, d), ad.event_tool_calls(spark, d))


DIMENSION = f"""count(*) FILTER (NOT is_subagent) AS sessions, sum(message_count)::BIGINT AS message_count, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
  sum(cache_read_tokens)::BIGINT AS cache_read_tokens, sum(cache_creation_tokens)::BIGINT AS cache_creation_tokens, {USD} FROM session"""


@query(f"SELECT tool AS key, {DIMENSION} GROUP BY 1", SE)
def by_dimension_tool(spark: SparkSession, d: str) -> DataFrame:
    return stats.by_dimension(ad.event_sessions(spark, d), "tool")


@query(f"SELECT coalesce(model, '(unknown)') AS key, {DIMENSION} GROUP BY 1", SE)
def by_dimension_model(spark: SparkSession, d: str) -> DataFrame:
    return stats.by_dimension(ad.event_sessions(spark, d), "model")


@query(f"SELECT coalesce(path, '(none)') AS key, {DIMENSION} LEFT JOIN project ON project.id = project_id GROUP BY 1", (*SE, "project"))
def by_dimension_project(spark: SparkSession, d: str) -> DataFrame:
    return stats.by_dimension(ad.event_sessions(spark, d), "project", ad.event_projects(spark, d))


@query(f"SELECT substr(started_at, 1, 10) AS key, {DIMENSION} GROUP BY 1", SE)
def by_dimension_day(spark: SparkSession, d: str) -> DataFrame:
    return stats.by_dimension(ad.event_sessions(spark, d), "day")


HOT = """count(*) FILTER (operation = 'read') AS reads, count(*) FILTER (operation = 'edit') AS edits, count(*) FILTER (operation = 'write') AS writes,
  count(*) FILTER (operation = 'delete') AS deletes, count(DISTINCT session_id) AS sessions, max(timestamp) AS last_touch FROM file_ref"""


@query(f"SELECT path AS key, {HOT} GROUP BY 1 ORDER BY reads + edits + writes + deletes DESC, key LIMIT 50", ("file_ref",))
def file_hotspots_path(spark: SparkSession, d: str) -> DataFrame:
    return stats.file_hotspots(ad.line_file_refs(spark, d))


@query(f"SELECT ext AS key, {HOT} GROUP BY 1", ("file_ref",))
def file_hotspots_ext(spark: SparkSession, d: str) -> DataFrame:
    return stats.file_hotspots(ad.line_file_refs(spark, d), "ext")


def _activity(unit: str, n: int) -> str:
    return f"""SELECT slot, sessions, sessions > 0 AND row_number() OVER (ORDER BY sessions DESC, slot) = 1 AS is_peak FROM (
      SELECT range::INT AS slot, (SELECT count(*) FROM session WHERE {unit}(strptime(substr(started_at, 1, 19), '%Y-%m-%dT%H:%M:%S')) = range) AS sessions FROM range({n}))"""


@query(_activity("hour", 24), SE)
def activity_hour(spark: SparkSession, d: str) -> DataFrame:
    return stats.activity(ad.event_sessions(spark, d), "hour")


@query(_activity("dayofweek", 7), SE)
def activity_weekday(spark: SparkSession, d: str) -> DataFrame:
    return stats.activity(ad.event_sessions(spark, d), "weekday")


@query(
    """SELECT model, string_agg(n::VARCHAR, ',' ORDER BY day) AS counts FROM (
    SELECT m.model, t.day, (SELECT count(*) FROM session s WHERE coalesce(s.model, '(unknown)') = m.model AND substr(started_at, 1, 10) = t.day) AS n
    FROM (SELECT DISTINCT coalesce(model, '(unknown)') AS model FROM session) m, (SELECT DISTINCT substr(started_at, 1, 10) AS day FROM session) t) GROUP BY model""",
    SE,
)
def model_sparklines(spark: SparkSession, d: str) -> DataFrame:
    return stats.model_sparklines(ad.event_sessions(spark, d))


@query("SELECT min(substr(started_at, 1, 10)) AS first_day, max(substr(started_at, 1, 10)) AS last_day FROM session", SE)
def date_bounds(spark: SparkSession, d: str) -> DataFrame:
    return stats.date_bounds(ad.event_sessions(spark, d))


@query(
    f"SELECT count(*) FILTER (NOT is_subagent) AS sessions, {USD} FROM session WHERE substr(started_at, 1, 10) BETWEEN '2024-01-05' AND '2024-01-12' AND tool = 'codex'", SE
)
def scoped_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of a date window and a tool."""
    s = lineage.scoped(ad.event_sessions(spark, d), "2024-01-05", "2024-01-12", tool="codex")
    return s.agg(F.count_if(~F.col("is_subagent")).alias("sessions"), usd(F.coalesce(F.sum("cost_nano"), F.lit(0))).alias("cost_usd"))


@query(
    """SELECT p.id, p.path, p.name, count(s.id) AS sessions, round(coalesce(sum(cost_nano), 0)::DOUBLE / 1000000000, 6) AS cost_usd, max(ended_at) AS last_active,
    coalesce(string_agg(DISTINCT tool, ',' ORDER BY tool), '') AS tools FROM project p LEFT JOIN session s ON s.project_id = p.id AND NOT is_subagent GROUP BY ALL""",
    (*SE, "project"),
)
def list_projects(spark: SparkSession, d: str) -> DataFrame:
    return stats.list_projects(ad.event_sessions(spark, d), ad.event_projects(spark, d))


TREE = """t AS (SELECT ancestor_id, count(*) - 1 AS subagents, sum(cost_nano)::BIGINT AS nano, sum(output_tokens)::BIGINT AS tokens, max(depth) AS max_depth
  FROM closure JOIN session s ON s.id = descendant_id WHERE depth <= 5 GROUP BY 1)"""


@query(
    f""", {TREE} SELECT s.id, tool, model, project_id, started_at, message_count, subagents, round(nano::DOUBLE / 1000000000, 6) AS tree_cost_usd
    FROM session s JOIN t ON ancestor_id = s.id WHERE NOT is_subagent ORDER BY started_at DESC, s.id DESC LIMIT 50 OFFSET 50""",
    (*SE, "closure"),
)
def list_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The second page."""
    s = ad.event_sessions(spark, d)
    return stats.list_sessions(s, lineage.subtree_totals(s), 50, 50)


@query("SELECT id, session_id, tool_name, mcp_server, is_error, duration_ms, timestamp FROM tool_call WHERE is_error ORDER BY timestamp DESC, id DESC LIMIT 50", TC)
def list_tool_calls(spark: SparkSession, d: str) -> DataFrame:
    return stats.list_tool_calls(ad.event_tool_calls(spark, d), errors_only=True)


@query(f"SELECT {CALL_STATS} FROM tool_call WHERE mcp_server = 'srv1'", TC)
def tool_call_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.tool_call_summary(ad.event_tool_calls(spark, d), server="srv1")


@query("SELECT ancestor_id, descendant_id, depth FROM closure WHERE depth <= 5", (*SE, "closure"))
def closure(spark: SparkSession, d: str) -> DataFrame:
    return lineage.closure(ad.event_sessions(spark, d))


@query(f", {TREE} SELECT s.id AS session_id, subagents, nano AS tree_cost_nano, tokens AS tree_output_tokens, max_depth FROM session s JOIN t ON ancestor_id = s.id WHERE NOT is_subagent", (*SE, "closure"))
def subtree_totals(spark: SparkSession, d: str) -> DataFrame:
    return lineage.subtree_totals(ad.event_sessions(spark, d))


@query("SELECT DISTINCT descendant_id AS id FROM closure JOIN state ON state.id = ancestor_id", (*SE, "closure", "state"))
def hidden_lineage(spark: SparkSession, d: str) -> DataFrame:
    return lineage.hidden(ad.event_sessions(spark, d), ad.event_states(spark, d))


@query(
    f"SELECT count(*) FILTER (NOT is_subagent) AS sessions, {USD} FROM session WHERE id NOT IN (SELECT descendant_id FROM closure JOIN state ON state.id = ancestor_id WHERE state = 'deleted')",
    (*SE, "closure", "state"),
)
def visible_totals(spark: SparkSession, d: str) -> DataFrame:
    """Archived sessions count here, deleted trees don't."""
    s = lineage.visible(ad.event_sessions(spark, d), ad.event_states(spark, d), include_archived=True)
    return s.agg(F.count_if(~F.col("is_subagent")).alias("sessions"), usd(F.coalesce(F.sum("cost_nano"), F.lit(0))).alias("cost_usd"))


@query(
    """SELECT ancestor_id AS session_id, count(*) FILTER (depth = 0) AS direct_calls, count(*) AS tree_calls FROM closure JOIN session s ON s.id = ancestor_id
    JOIN tool_call t ON t.session_id = descendant_id WHERE NOT s.is_subagent AND mcp_server IN ('srv0', 'srv2') AND depth <= 5 GROUP BY 1""",
    ("ev", "session", "closure", "tool_call"),
)
def evidence(spark: SparkSession, d: str) -> DataFrame:
    s = ad.event_sessions(spark, d)
    out = stats.mcp_evidence(s, ad.event_tool_calls(spark, d), lineage.closure(s), ["srv0", "srv2"])
    return out.select("session_id", F.col("direct_calls").cast("long").alias("direct_calls"), "tree_calls")


@query(
    "SELECT path, count(*) FILTER (operation = 'read') AS reads, count(*) FILTER (operation <> 'read') AS edits, count(DISTINCT session_id) AS sessions FROM file_ref GROUP BY 1 HAVING reads > 0 ORDER BY sessions DESC, reads DESC, path LIMIT 15",
    ("file_ref",),
)
def hot_context(spark: SparkSession, d: str) -> DataFrame:
    return stats.hot_context(ad.line_file_refs(spark, d))


@query("SELECT least(count(*), 1000) AS total, count(*) > 1000 AS capped FROM ev WHERE event_type = 'click'", EV)
def capped_count(spark: SparkSession, d: str) -> DataFrame:
    return stats.capped_count(ad.event_tool_calls(spark, d).where("tool_name = 'click'"))


@query("SELECT CASE WHEN is_error THEN 'Error' WHEN NOT is_error THEN 'OK' WHEN duration_ms IS NOT NULL THEN 'Completed' ELSE 'No result' END AS status, count(*) AS calls FROM tool_call GROUP BY 1", TC)
def tool_call_status(spark: SparkSession, d: str) -> DataFrame:
    status = stats.tool_call_status(F.col("duration_ms").isNotNull(), F.col("is_error"))
    return ad.event_tool_calls(spark, d).groupBy(status.alias("status")).agg(F.count("*").alias("calls"))


# Messages.


def _context(spark: SparkSession, d: str) -> DataFrame:
    """Context of an assistant message: a quarter of the bytes so far; a user message of
    more than 400 bytes stands for a compaction."""
    from pyspark.sql import Window as W

    m = ad.chat_messages(spark, d)
    before = F.coalesce(F.sum("bytes").over(W.partitionBy("session_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tokens = F.floor(before / 4)
    return m.select("session_id", "seq", "role", (F.col("role") == "user").alias("is_turn"), F.when(tokens > 0, tokens).alias("context_tokens"), ((F.col("role") == "user") & (F.col("bytes") % 7 == 3)).alias("is_boundary"), F.lit(None).cast("long").alias("pre_tokens"))


CTX = """cx0 AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 4 AS t FROM chat),
  cx AS (SELECT session_id, seq, role, CASE WHEN t > 0 THEN t END AS ct, role = 'user' AND bytes % 7 = 3 AS b,
    greatest(1, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq))::BIGINT AS turn,
    sum(CASE WHEN role = 'user' AND bytes % 7 = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS seg FROM cx0)"""


@query(f", {CTX} SELECT session_id, seq, turn, ct AS context_tokens FROM cx WHERE role = 'assistant' AND ct > 0", ("chat",))
def context_points(spark: SparkSession, d: str) -> DataFrame:
    return context.context_points(_context(spark, d))


@query(
    f""", {CTX}, e AS (SELECT session_id, seg, min_by(ct, seq) AS f, max_by(ct, seq) AS l FROM cx WHERE role = 'assistant' AND ct > 0 GROUP BY 1, 2)
    SELECT x.session_id, x.seq, p.l AS pre_tokens, q.f AS post_tokens FROM cx x LEFT JOIN e p ON p.session_id = x.session_id AND p.seg = x.seg - 1 LEFT JOIN e q ON q.session_id = x.session_id AND q.seg = x.seg WHERE b""",
    ("chat",),
)
def compaction_pre_post(spark: SparkSession, d: str) -> DataFrame:
    return context.compaction_segments(_context(spark, d))


@query(
    f""", {CTX} SELECT session_id, count(*) AS points, max(turn) AS turns, max(ct) AS peak_tokens, CASE session_id % 4 WHEN 0 THEN 1000000 WHEN 2 THEN 200000 END::INT AS window_tokens,
    CASE session_id % 4 WHEN 0 THEN round(max(ct)::DOUBLE / 1000000, 6) WHEN 2 THEN round(max(ct)::DOUBLE / 200000, 6) END AS peak_pct FROM cx WHERE role = 'assistant' AND ct > 0 GROUP BY session_id""",
    ("chat",),
)
def context_peaks(spark: SparkSession, d: str) -> DataFrame:
    points = context.context_points(_context(spark, d))
    session = ad.chat_messages(spark, d).select(F.col("session_id").alias("id")).distinct()
    session = session.withColumn("tool", F.when(F.col("id") % 2 == 0, "claude_code").otherwise("codex")).withColumn("model", F.when(F.col("id") % 4 == 0, "claude-opus-4-7").otherwise("claude-opus-4-1")).withColumn("context_window_tokens", F.lit(None).cast("int"))
    return context.peaks(points, session)


@query("SELECT session_id, sum(CASE WHEN g > 0 THEN least(g, 300) ELSE 0 END)::BIGINT AS active_seconds FROM (SELECT session_id, epoch - lag(epoch) OVER (PARTITION BY session_id ORDER BY seq) AS g FROM chat) GROUP BY 1", ("chat",))
def active_seconds(spark: SparkSession, d: str) -> DataFrame:
    return context.active_seconds(ad.chat_messages(spark, d))


@query("SELECT session_id, count(*) FILTER (role = 'assistant' AND bytes > 0) AS assistant_messages, count(*) AS messages, sum(bytes)::BIGINT AS bytes FROM chat GROUP BY 1", ("chat",))
def session_totals(spark: SparkSession, d: str) -> DataFrame:
    m = ad.chat_messages(spark, d)
    return m.groupBy("session_id").agg(F.count_if((F.col("role") == "assistant") & (F.col("bytes") > 0)).alias("assistant_messages"), F.count("*").alias("messages"), F.sum("bytes").alias("bytes"))


@query("SELECT session_id, seq, substr(text, 1, 240) AS excerpt FROM chat WHERE role = 'user' AND trim(text) <> ''", ("chat",))
def session_outline(spark: SparkSession, d: str) -> DataFrame:
    m = ad.chat_messages(spark, d).where("role = 'user' AND trim(text) <> ''")
    return m.select("session_id", "seq", F.substring("text", 1, 240).alias("excerpt"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Assistant messages as three blocks: thinking, text and a tool use."""
    m = ad.chat_messages(spark, d).where("role = 'assistant'")
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(b).alias("bucket"), F.lit(t).alias("is_thinking"), x.alias("bytes")) for i, b, t, x in ((0, "planning", True, F.lit(0).cast("long")), (1, "communicating", False, F.col("bytes")), (2, "code", False, F.col("seq") * 40))]))
    m = m.select("session_id", "seq", F.floor(F.col("bytes") / 2).alias("output_tokens"), parts.alias("p"), (F.col("seq") < 3).alias("is_orientation"))
    return m.select("session_id", "seq", "output_tokens", "is_orientation", "p.*")


GEN = """bl AS (SELECT session_id, seq, bytes // 2 AS out, seq < 3 AS o, bytes AS b1, seq * 40 AS b2 FROM chat WHERE role = 'assistant'),
  g0 AS (SELECT *, greatest(0.0::DOUBLE, out - (b1 + b2) / 4.0::DOUBLE) AS plan, greatest(b1, 1) AS w1, greatest(b2, 1) AS w2 FROM bl),
  g1 AS (SELECT session_id, 'planning' AS bucket, plan AS t, o FROM g0 UNION ALL SELECT session_id, 'communicating', (out - plan) * (w1::DOUBLE / (w1 + w2)), o FROM g0 UNION ALL SELECT session_id, 'code', (out - plan) * (w2::DOUBLE / (w1 + w2)), o FROM g0),
  gen AS (SELECT session_id, bucket, sum(t) AS tokens, sum(CASE WHEN o THEN t ELSE 0 END) AS orientation FROM g1 WHERE t > 0 GROUP BY 1, 2)"""


@query(f", {GEN} SELECT session_id, bucket, round(tokens, 4) AS tokens, round(orientation, 4) AS orientation_tokens FROM gen", ("chat",))
def generation_alloc(spark: SparkSession, d: str) -> DataFrame:
    g = economics.generation(_blocks(spark, d))
    return g.select("session_id", "bucket", F.round("tokens", 4).alias("tokens"), F.round("orientation_tokens", 4).alias("orientation_tokens"))


def _calls_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    bucket = F.when(F.col("tool_name") == "click", "code").when(F.col("tool_name") == "view", "context").when(F.col("tool_name") == "error", "planning").otherwise("communicating")
    return ad.event_tool_calls(spark, d).select("session_id", bucket.alias("bucket"), "output_bytes", (F.col("id") % 3 == 0).alias("is_orientation"))


@query(
    """SELECT session_id, CASE tool_name WHEN 'click' THEN 'code' WHEN 'view' THEN 'context' WHEN 'error' THEN 'planning' ELSE 'communicating' END AS bucket,
    sum(output_bytes)::DOUBLE / 4 AS window_tokens, sum(CASE WHEN id % 3 = 0 THEN output_bytes ELSE 0 END)::DOUBLE / 4 AS orientation_window, count(*) AS calls FROM tool_call GROUP BY 1, 2""",
    TC,
)
def window_use(spark: SparkSession, d: str) -> DataFrame:
    return economics.window_use(_calls_by_bucket(spark, d))


@query(
    f""", {GEN}, b AS (SELECT unnest(['context', 'planning', 'code', 'communicating']) AS bucket),
    w AS (SELECT CASE tool_name WHEN 'click' THEN 'code' WHEN 'view' THEN 'context' WHEN 'error' THEN 'planning' ELSE 'communicating' END AS bucket, sum(output_bytes)::DOUBLE / 4 AS w, count(*) AS calls FROM tool_call GROUP BY 1),
    g AS (SELECT bucket, sum(tokens) AS g FROM gen GROUP BY 1),
    r AS (SELECT bucket, coalesce(g, 0) AS g, coalesce(w, 0) + coalesce(g, 0) AS w, coalesce(calls, 0) AS calls FROM b LEFT JOIN g USING (bucket) LEFT JOIN w USING (bucket)),
    c AS (SELECT sum(cost_in_nano)::DOUBLE AS i, sum(cost_out_nano)::DOUBLE AS o FROM session),
    n AS (SELECT *, o * g / sum(g) OVER () + i * w / sum(w) OVER () AS nano FROM r, c)
    SELECT bucket, floor(g + 0.5)::BIGINT AS generation_tokens, floor(w + 0.5)::BIGINT AS window_tokens, calls AS tool_calls, round(nano / 1e9, 6) AS cost_usd, round(nano / sum(nano) OVER (), 6) AS cost_share FROM n""",
    ("chat", "ev", "session", "tool_call"),
)
def economics_buckets(spark: SparkSession, d: str) -> DataFrame:
    return economics.pooled(economics.generation(_blocks(spark, d)), economics.window_use(_calls_by_bucket(spark, d)), ad.event_sessions(spark, d))


def _latency_blocks(spark: SparkSession, d: str) -> DataFrame:
    m = ad.chat_messages(spark, d)
    return m.select("session_id", "seq", (F.col("epoch") * 1000 + F.col("seq") * F.col("seq") * 30000).alias("epoch_ms"), "role", F.lit("text").alias("type"), F.lit("communicating").alias("bucket"), "bytes")


@query(
    """SELECT session_id, CASE WHEN role = 'user' THEN 'waiting' ELSE 'communicating' END AS bucket, sum(g)::DOUBLE AS ms FROM (
    SELECT *, greatest(0, least(300000, e - lag(e) OVER (PARTITION BY session_id ORDER BY seq))) AS g FROM (SELECT *, epoch * 1000 + seq * seq * 30000 AS e FROM chat)) WHERE g > 0 GROUP BY 1, 2""",
    ("chat",),
)
def latency_buckets(spark: SparkSession, d: str) -> DataFrame:
    return economics.latency(_latency_blocks(spark, d))


@query(f"SELECT coalesce(model, '(unknown)') AS model, sum(cost_in_nano)::BIGINT AS cost_in_nano, sum(cost_out_nano)::BIGINT AS cost_out_nano, {USD} FROM session GROUP BY 1", SE)
def cost_by_model(spark: SparkSession, d: str) -> DataFrame:
    s = ad.event_sessions(spark, d)
    return s.groupBy(F.coalesce("model", F.lit("(unknown)")).alias("model")).agg(F.sum("cost_in_nano").alias("cost_in_nano"), F.sum("cost_out_nano").alias("cost_out_nano"), usd(F.sum("cost_nano")).alias("cost_usd"))


# Parsers' set forms.


@query(
    """SELECT session_id, id AS seq, mcp_server AS request_id, output_bytes AS output_tokens, (mcp_server IS NULL OR row_number() OVER (PARTITION BY session_id, mcp_server ORDER BY output_bytes DESC, id) = 1) AS billed FROM tool_call""",
    TC,
)
def billing_dedupe(spark: SparkSession, d: str) -> DataFrame:
    r = ad.event_tool_calls(spark, d).select("session_id", F.col("id").alias("seq"), F.col("mcp_server").alias("request_id"), F.col("output_bytes").alias("output_tokens"))
    return context.billing_dedupe(r)


@query(
    """, m AS (SELECT user_id AS session_id, event_id AS line_no, CASE event_type WHEN 'view' THEN 'assistant' WHEN 'click' THEN 'tool' WHEN 'purchase' THEN 'user' WHEN 'signup' THEN 'other' END AS role FROM ev),
    a AS (SELECT session_id, line_no, role, max(CASE WHEN role IN ('assistant', 'user') THEN line_no END) OVER (PARTITION BY session_id ORDER BY line_no) AS anchor FROM m)
    SELECT a.session_id, anchor AS seq, max(a.line_no * 10) AS usage FROM a JOIN m ON m.line_no = anchor AND m.session_id = a.session_id WHERE a.role IS NULL AND m.role = 'assistant' GROUP BY 1, 2""",
    EV,
)
def asof_stamp(spark: SparkSession, d: str) -> DataFrame:
    e = ad.table(spark, d, "events")
    role = F.when(F.col("event_type") == "view", "assistant").when(F.col("event_type") == "click", "tool").when(F.col("event_type") == "purchase", "user").when(F.col("event_type") == "signup", "other")
    rows = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("line_no"), F.col("event_id").alias("seq"), role.alias("role"))
    readings = rows.where("role IS NULL").select("session_id", "line_no", (F.col("line_no") * 10).alias("usage"))
    return context.asof_stamp(rows.where("role IS NOT NULL"), readings)


# Search, signals, commands.

_TERMS = "list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@query(
    f"""WITH t AS (SELECT doc_id, {_TERMS} AS terms FROM documents), n AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM t WHERE len(terms) > 0),
    h AS (SELECT doc_id, len(terms) AS length, len(list_filter(terms, lambda x: x = 'the')) AS a, len(list_filter(terms, lambda x: starts_with(x, 'idio'))) AS b FROM t),
    d AS (SELECT count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM h),
    s AS (SELECT doc_id, CASE WHEN ln((n - da + 0.5) / (da + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - da + 0.5) / (da + 0.5)) END AS ia, CASE WHEN ln((n - db + 0.5) / (db + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - db + 0.5) / (db + 0.5)) END AS ib,
      4.0 * a AS ta, 4.0 * b AS tb, 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean) AS k FROM h, n, d WHERE a > 0 AND b > 0)
    SELECT doc_id AS block_id, round(-(ia * ta * 2.2::DOUBLE / (ta + k) + ib * tb * 2.2::DOUBLE / (tb + k)), 6) AS score FROM s ORDER BY score, block_id LIMIT 100"""
)
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    """All terms must be there; the last one is a prefix."""
    docs = ad.table(spark, d, "documents").select(F.col("doc_id").alias("block_id"), "text")
    return search.bm25(search.postings(docs, {"text": 4.0}), "the idio")


@query(
    """, r AS (SELECT count(*) AS n, count(*) FILTER (outcome = 'abandoned') AS a FROM session WHERE outcome IS NOT NULL),
    m AS (SELECT coalesce(model, '(unknown)') AS key, sum(cost_nano) AS c FROM session GROUP BY 1 ORDER BY c DESC, key LIMIT 1), q AS (SELECT sum(cost_nano) AS c FROM session),
    u AS (SELECT tool_name, tool_kind, mcp_server, count(*) AS calls, count(*) FILTER (is_error) AS errors FROM tool_call GROUP BY ALL),
    x AS (SELECT 'signal:error:' || tool_name || '.h' || left(sha256(unhex(regexp_replace(hex('["' || tool_kind || '",' || coalesce('"' || mcp_server || '"', 'null') || ']'), '(..)', '\\100', 'g'))), 16) AS key, round(errors::DOUBLE, 6) AS score FROM u WHERE calls >= 20 AND errors::DOUBLE / calls >= 0.12
      UNION ALL SELECT 'signal:heavy-server:' || mcp_server, 2.0 FROM (SELECT mcp_server, sum(calls) AS calls FROM u WHERE mcp_server IS NOT NULL GROUP BY 1 ORDER BY calls DESC, mcp_server LIMIT 3) WHERE calls >= 50
      UNION ALL SELECT 'signal:heavy-tool:' || tool_name, 2.0 FROM (SELECT * FROM u WHERE tool_kind <> 'mcp' ORDER BY calls DESC, tool_name LIMIT 2) WHERE calls >= 200
      UNION ALL SELECT 'signal:cost-concentration', 5.0 FROM m, q WHERE q.c > 0 AND m.c::DOUBLE / q.c >= 0.4
      UNION ALL SELECT 'signal:abandoned-rate', round(floor(a::DOUBLE / n * 100 + 0.5) / 3, 6) FROM r WHERE n >= 10 AND a::DOUBLE / n > 0.25)
    SELECT key, score FROM x ORDER BY score DESC, key LIMIT 12""",
    ("ev", "session", "tool_call"),
)
def signal_list(spark: SparkSession, d: str) -> DataFrame:
    s, c = ad.event_sessions(spark, d), ad.event_tool_calls(spark, d)
    return signals.signals(s, c)


@query(
    "SELECT path AS key, count(DISTINCT CASE WHEN operation = 'read' THEN session_id END) AS readers, count(DISTINCT CASE WHEN operation <> 'read' THEN session_id END) AS editors FROM file_ref GROUP BY 1 HAVING readers >= 8 AND editors <= 40 ORDER BY readers DESC, key LIMIT 2",
    ("file_ref",),
)
def hot_context_files(spark: SparkSession, d: str) -> DataFrame:
    return signals.hot_context_files(ad.line_file_refs(spark, d), most_editors=40)


@query("SELECT path AS key, count(DISTINCT session_id) AS editors FROM file_ref WHERE operation IN ('edit', 'write') GROUP BY 1 HAVING editors >= 6 ORDER BY editors DESC, key LIMIT 2", ("file_ref",))
def churn(spark: SparkSession, d: str) -> DataFrame:
    return signals.churn_files(ad.line_file_refs(spark, d))


@query("SELECT count(*) AS searches, count(DISTINCT session_id) AS sessions, (SELECT count(*) FROM session) AS in_window FROM tool_call WHERE tool_name IN ('view', 'click')", ("ev", "session", "tool_call"))
def search_heavy(spark: SparkSession, d: str) -> DataFrame:
    return signals.search_counts(ad.event_sessions(spark, d), ad.event_tool_calls(spark, d), ["view", "click"])


@query("SELECT count(*) AS classified, count(*) FILTER (outcome = 'abandoned') AS abandoned FROM session WHERE outcome IS NOT NULL", SE)
def abandoned_rate(spark: SparkSession, d: str) -> DataFrame:
    return signals.abandoned_counts(ad.event_sessions(spark, d))


@cache
def _command_sql() -> str:
    return """ops AS (SELECT o_orderkey % 997 AS session_id, o_orderkey AS ordinal, o_orderstatus = 'F' AS is_error,
      CASE o_orderkey % 6 WHEN 0 THEN 'npm install left-pad' WHEN 1 THEN 'cargo test --all' WHEN 2 THEN 'git status' WHEN 3 THEN 'make build' WHEN 4 THEN 'eslint .' ELSE 'rm -rf node_modules' END AS normalized,
      CASE o_orderkey % 6 WHEN 0 THEN 'setup' WHEN 1 THEN 'test' WHEN 2 THEN 'vcs' WHEN 3 THEN 'build' WHEN 4 THEN 'lint' ELSE 'other' END AS phase FROM orders)"""


def _commands(spark: SparkSession, d: str) -> DataFrame:
    o = ad.table(spark, d, "orders")
    texts = ("npm install left-pad", "cargo test --all", "git status", "make build", "eslint .", "rm -rf node_modules")
    command = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return o.select((F.col("o_orderkey") % 997).alias("session_id"), F.col("o_orderkey").alias("ordinal"), (F.col("o_orderstatus") == "F").alias("is_error"), command.alias("normalized"), commands.phase(command).alias("phase"))


@query(
    f"WITH {_command_sql()} SELECT session_id, ordinal, normalized, phase, is_error, s.sessions_seen, s.success_rate FROM ops JOIN (SELECT normalized, count(DISTINCT session_id) AS sessions_seen, round(1 - sum(is_error::INT)::DOUBLE / count(*), 6) AS success_rate FROM ops GROUP BY 1) s USING (normalized)"
)
def command_timeline(spark: SparkSession, d: str) -> DataFrame:
    return distill.timeline(_commands(spark, d))


@query(
    f"WITH {_command_sql()}, n AS (SELECT count(DISTINCT session_id) AS n FROM ops) SELECT normalized AS command, phase, count(DISTINCT session_id) AS sessions_seen, round(1 - sum(is_error::INT)::DOUBLE / count(*), 6) AS success_rate FROM ops, n GROUP BY normalized, phase, n HAVING sessions_seen >= 2 AND sessions_seen::DOUBLE / n >= 0.25 AND success_rate > 0"
)
def select_lines(spark: SparkSession, d: str) -> DataFrame:
    return distill.select_lines(_commands(spark, d)).drop("place")


@query(
    f"WITH {_command_sql()}, l AS (SELECT *, lag(normalized) OVER (PARTITION BY session_id ORDER BY ordinal) AS before FROM ops) SELECT session_id, ordinal, normalized AS command, phase FROM l WHERE before IS DISTINCT FROM normalized"
)
def exemplar_lines(spark: SparkSession, d: str) -> DataFrame:
    return distill.exemplar(_commands(spark, d))


# State and ingest.


@query(
    """SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'file://' || o_orderkey END IS NOT NULL AS changed, count(*) AS files FROM orders GROUP BY 1"""
)
def incremental_skip(spark: SparkSession, d: str) -> DataFrame:
    """A listing against its manifest: files of which size, time or revision differ."""
    from sessionloom.sources.manifest import changed_files

    o = ad.table(spark, d, "orders")
    listing = o.select(F.concat(F.lit("file://"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderkey").alias("size"), F.col("o_custkey").alias("mtime"))
    known = listing.withColumn("size", F.when(F.col("size") % 5 == 0, F.col("size") - 1).otherwise(F.col("size"))).withColumn("revision", F.lit(1))
    stale = changed_files(listing, known, revision=1).select("path", F.lit(True).alias("stale"))
    return listing.join(stale, "path", "left").groupBy(F.coalesce("stale", F.lit(False)).alias("changed")).agg(F.count("*").alias("files"))


@query(
    """SELECT coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NULL THEN 'open' WHEN b.k IS NULL THEN 'implemented' WHEN a.st = 'implemented' AND a.k % 2 = 0 THEN 'open' ELSE a.st END AS status, coalesce(b.sc, a.sc) AS score
    FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'implemented' ELSE 'open' END AS st, 1.0::DOUBLE AS sc FROM customer WHERE c_custkey % 4 <> 0) a
    FULL JOIN (SELECT c_custkey AS k, c_acctbal AS sc FROM customer WHERE c_custkey % 5 <> 0) b ON a.k = b.k"""
)
def state_merge(spark: SparkSession, d: str) -> DataFrame:
    c = ad.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal")
    status = F.when(F.col("key") % 3 == 0, "implemented").otherwise("open")
    how = F.when(F.col("key") % 3 == 0, F.when(F.col("key") % 2 == 0, "activity").otherwise("user"))
    old = c.where("key % 4 <> 0").select("key", status.alias("status"), how.alias("resolution"), F.lit(1.0).alias("score"))
    new = c.where("key % 5 <> 0").select("key", F.col("c_acctbal").alias("score"))
    return signals.regenerate(old, new).select("key", "status", "score")


@query(
    """, c AS (SELECT session_id, id, input AS use_id, row_number() OVER (PARTITION BY session_id, input ORDER BY id) AS n, count(*) OVER (PARTITION BY session_id, input) AS total FROM tool_call WHERE tool_kind = 'builtin'),
    r AS (SELECT session_id, id, input AS use_id FROM tool_call WHERE tool_kind = 'mcp')
    SELECT 'duplicate_tool_use_id' AS code, count(*) AS n FROM c WHERE n > 1 HAVING n > 0 UNION ALL SELECT 'orphan_tool_result', count(*) FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.session_id = r.session_id AND c.use_id = r.use_id) HAVING count(*) > 0
    UNION ALL SELECT 'duplicate_tool_result', count(*) FROM (SELECT row_number() OVER (PARTITION BY session_id, use_id ORDER BY id) AS n FROM r) WHERE n > 1 HAVING count(*) > 0""",
    TC,
)
def linkage_issues(spark: SparkSession, d: str) -> DataFrame:
    from sessionloom.operators.linkage import linkage_issues as issues

    t = ad.event_tool_calls(spark, d)
    rows = t.select("session_id", F.col("id").cast("int").alias("seq"), F.lit(0).alias("ordinal"), F.when(F.col("tool_kind") == "builtin", "tool_use").otherwise("tool_result").alias("type"), F.col("input").alias("tool_use_id"))
    return issues(rows).groupBy("code").agg(F.count("*").alias("n"))


# Sessions as read: titles, visibility, roll-ups, trajectories, activity, typing errors.


def _filled(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a schema; those that aren't there are null."""
    null = [F.lit(None).cast(f.split(" ", 1)[1]).alias(f.split()[0]) for f in ddl.split(", ") if f.split()[0] not in df.columns]
    return schema.shaped(df.select("*", *null), ddl)


def _chat_archive(spark: SparkSession, d: str) -> Archive:
    """Conversations as an archive: a session each, a message and a text block for each turn.
    Of every sixth session all texts are a command's, and every third has users only."""
    c = ad.chat_messages(spark, d)
    odd, quiet = F.col("session_id") % 6 == 0, F.col("session_id") % 3 == 0
    c = c.withColumn("role", F.when(quiet, "user").otherwise(F.col("role"))).withColumn("text", F.when(odd, "<command-name>/exit").otherwise(F.col("text")))
    at = F.date_format(F.timestamp_seconds("epoch"), ad.ISO)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    c = c.withColumn("seq", F.col("seq").cast("int")).withColumn("output_tokens", F.when(F.col("role") == "assistant", F.floor(size / 2)))
    s = c.groupBy(F.col("session_id").alias("id")).agg(F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"), F.min(at).alias("started_at"))
    s = s.withColumn("tool", F.lit("claude_code")).withColumn("is_subagent", F.lit(False)).withColumn("title", F.when(F.col("id") % 2 == 0, "<local-command-caveat>").otherwise("Chat"))
    s = s.withColumn("cost_in_nano", F.lit(0)).withColumn("cost_out_nano", F.col("output_tokens") * 25_000).withColumn("cost_nano", F.col("cost_out_nano"))
    message = c.select("session_id", "seq", "role", "output_tokens", at.alias("timestamp"))
    block = c.select("session_id", "seq", F.lit(0).alias("ordinal"), F.lit("text").alias("type"), "text")
    none = lambda ddl: spark.createDataFrame([], ddl)
    return Archive(none(schema.PROJECT), _filled(s, schema.SESSION), _filled(message, schema.MESSAGE), _filled(block, schema.BLOCK), none(schema.TOOL_CALL), none(schema.FILE_REF), none(schema.ISSUE), none(schema.USER_STATE))


CHAT = """, ca AS (SELECT session_id, seq, epoch, CASE WHEN session_id % 3 = 0 THEN 'user' ELSE role END AS role, CASE WHEN session_id % 6 = 0 THEN '<command-name>/exit' ELSE text END AS text,
    strftime(to_timestamp(epoch) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ') AS said FROM chat),
  cb AS (SELECT *, coalesce(strlen(text), 0) AS size, CASE WHEN role = 'assistant' THEN coalesce(strlen(text), 0) // 2 END AS out FROM ca)"""


@query(
    f"""{CHAT}, r AS (SELECT session_id, seq, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM cb WHERE role = 'user' AND NOT starts_with(text, '<command-name>')),
    f AS (SELECT session_id, min_by(t, seq) AS t FROM r WHERE t <> '' GROUP BY 1)
    SELECT s AS id, coalesce(CASE WHEN length(t) > 180 THEN left(t, 180) || '…' ELSE t END, CASE WHEN s % 2 = 1 THEN 'Chat' END) AS title FROM (SELECT DISTINCT session_id AS s FROM cb) LEFT JOIN f ON session_id = s""",
    ("chat",),
)
def session_titles(spark: SparkSession, d: str) -> DataFrame:
    """What each conversation is called: the first text of a user's own."""
    a = _chat_archive(spark, d)
    return sessions.display_titles(a.session, a.message, a.block)


@query(
    f"""{CHAT} SELECT session_id AS id FROM cb WHERE session_id % 2 = 0 GROUP BY 1
    HAVING sum(coalesce(out, 0)) = 0 AND count(*) FILTER (role = 'assistant') = 0 AND count(*) FILTER (role = 'user' AND trim(text) <> '' AND NOT starts_with(text, '<command-name>')) = 0""",
    ("chat",),
)
def local_command_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Conversations that nobody but a local command has had."""
    a = _chat_archive(spark, d)
    return sessions.wrapper_only(a.session, a.message, a.block)


@query(
    f"""{CHAT}, fine AS (SELECT session_id FROM cb WHERE trim(text) <> '' AND NOT starts_with(text, '<command-name>') GROUP BY 1 HAVING count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role = 'assistant') > 0),
    o AS (SELECT session_id, role, text AS content, said AS timestamp, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM cb WHERE session_id IN (FROM fine) AND trim(text) <> '' AND role IN ('user', 'assistant') AND NOT (role = 'user' AND starts_with(text, '<command-name>')))
    SELECT session_id, n, role, content, timestamp FROM o UNION ALL SELECT session_id, 0, 'meta', NULL, NULL FROM fine""",
    ("chat",),
)
def trajectory_records(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as trajectories."""
    a = _chat_archive(spark, d)
    return trajectory.trajectories(a.session, a.message, a.block)[0].select("session_id", F.col("n").cast("long").alias("n"), "role", "content", "timestamp")


@query(
    f"""{CHAT}, g AS (SELECT *, least(greatest((epoch - lag(epoch) OVER (PARTITION BY session_id ORDER BY seq)) * 1000, 0), 300000) AS ms FROM cb),
    r AS (SELECT session_id, coalesce(sum(out), 0)::DOUBLE AS generation, coalesce(sum(CASE WHEN role <> 'user' THEN ms END), 0)::DOUBLE AS ms, coalesce(sum(CASE WHEN role = 'user' THEN ms END), 0)::DOUBLE AS waiting_ms FROM g GROUP BY 1)
    SELECT session_id, 'communicating' AS bucket, generation, generation AS generation_o, ms, waiting_ms FROM r WHERE generation > 0 OR ms > 0""",
    ("chat",),
)
def session_activity(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and time of each conversation by what they went into."""
    rows, summary = activity.activity(_chat_archive(spark, d))
    return rows.join(summary.select("session_id", "waiting_ms"), "session_id").where("generation > 0 OR ms > 0").select("session_id", "bucket", "generation", "generation_o", "ms", "waiting_ms")


@query("SELECT ancestor_id AS id, count(*) - 1 AS subagents, sum(s.cost_nano)::BIGINT AS all_nano, any_value(a.cost_nano)::BIGINT AS own_nano FROM closure JOIN session s ON s.id = descendant_id JOIN session a ON a.id = ancestor_id GROUP BY 1", ("ev", "session", "closure"))
def session_rollups(spark: SparkSession, d: str) -> DataFrame:
    """Each session's cost with all under it."""
    return sessions.rollups(ad.event_sessions(spark, d))


@query(
    """WITH t AS (SELECT p_partkey AS id, lower(p_name) AS t FROM part),
    w AS (SELECT DISTINCT id, unnest(string_split_regex(t, '[^a-z0-9]+')) AS v FROM t),
    q AS (SELECT unnest(['bolt', 'lareg']) AS q)
    SELECT id FROM (SELECT id, q FROM t, q WHERE contains(t, q) UNION SELECT id, q FROM w, q WHERE v <> '' AND damerau_levenshtein(v, q) <= 1) GROUP BY id HAVING count(*) = 2"""
)
def fuzzy_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose name holds both words, one of them misspelled."""
    names = ad.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return fuzzy.fuzzy_titles(names, "bolt lareg").select("id")


@query(
    """WITH t AS (SELECT conv_id * 1000 + turn AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS a, list_filter(string_split_regex(lower(role), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS b FROM conversations),
    h AS (SELECT id, len(a) + len(b) AS length, len(list_filter(a, lambda x: x = 'the')) * 4.0 + len(list_filter(b, lambda x: x = 'the')) * 2.0 AS ta, len(list_filter(a, lambda x: starts_with(x, 'us'))) * 4.0 + len(list_filter(b, lambda x: starts_with(x, 'us'))) * 2.0 AS tb FROM t),
    n AS (SELECT count(*) AS n, avg(length) AS mean FROM h WHERE length > 0), df AS (SELECT count(*) FILTER (ta > 0) AS da, count(*) FILTER (tb > 0) AS db FROM h),
    s AS (SELECT id, ta, tb, CASE WHEN ln((n - da + 0.5) / (da + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - da + 0.5) / (da + 0.5)) END AS ia, CASE WHEN ln((n - db + 0.5) / (db + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - db + 0.5) / (db + 0.5)) END AS ib,
      1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean) AS k FROM h, n, df WHERE ta > 0 AND tb > 0)
    SELECT id AS block_id, round(-(ia * ta * 2.2::DOUBLE / (ta + k) + ib * tb * 2.2::DOUBLE / (tb + k)), 6) AS score FROM s ORDER BY score, block_id LIMIT 100"""
)
def bm25_columns(spark: SparkSession, d: str) -> DataFrame:
    """Terms in several columns, each with its weight."""
    c = ad.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("block_id"), "text", F.col("role").alias("tool_name"), F.lit(None).cast("string").alias("tool_input"))
    return search.bm25(search.postings(c, search.WEIGHTS), "the us")


# Reads of a part of an archive.


def _event_archive(spark: SparkSession, d: str) -> Archive:
    """Users' days as an archive: each event is a message and a call, errors are issues too, the
    last two projects are worktrees of the first, and some days are deleted or archived."""
    s = ad.event_sessions(spark, d).withColumn("title", F.concat(F.lit("Day "), F.col("day").cast("string"))).withColumn("source_path", F.col("source_session_id"))
    calls = ad.event_tool_calls(spark, d)
    message = calls.select("session_id", F.col("id").cast("int").alias("seq"), F.lit("tool").alias("role"))
    odd = F.when(F.col("id") % 2 == 0, "unparsed_line").otherwise("orphan_tool_result")
    issue = calls.where("tool_name = 'error'").select(F.concat(F.lit("u"), F.col("session_id").cast("string")).alias("source_path"), "session_id", odd.alias("code"))
    project = ad.event_projects(spark, d).withColumn("is_worktree", F.col("id") >= 5).withColumn("root_path", F.when(F.col("id") >= 5, "/work/p0"))
    states = ad.event_states(spark, d).join(s.select("id", "tool", "source_session_id"), "id")
    none = lambda ddl: spark.createDataFrame([], ddl)
    return Archive(_filled(project, schema.PROJECT), _filled(s, schema.SESSION), _filled(message, schema.MESSAGE), none(schema.BLOCK), _filled(calls, schema.TOOL_CALL), none(schema.FILE_REF), _filled(issue, schema.ISSUE), _filled(states, schema.USER_STATE))


def _order_archive(spark: SparkSession, d: str) -> Archive:
    """Orders as sessions, their line items as file references."""
    o = ad.table(spark, d, "orders")
    s = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "claude_code").otherwise("codex").alias("tool"), (F.col("o_custkey") % 8).alias("project_id"), F.date_format("o_orderdate", ad.ISO).alias("started_at"))
    s = s.withColumn("is_subagent", F.lit(False)).withColumn("source_session_id", F.concat(F.lit("o"), F.col("id").cast("string")))
    refs = ad.line_file_refs(spark, d).withColumn("rel_path", F.when(F.col("ext") != "md", F.split("path", "/")[1]))
    none = lambda ddl: spark.createDataFrame([], ddl)
    return Archive(_filled(ad.event_projects(spark, d), schema.PROJECT), _filled(s, schema.SESSION), none(schema.MESSAGE), none(schema.BLOCK), none(schema.TOOL_CALL), _filled(refs, schema.FILE_REF), none(schema.ISSUE), none(schema.USER_STATE))


SEEN = ("ev", "session", "closure", "state", "project", "tool_call")
VISIBLE = """, vis AS (SELECT * FROM session WHERE id NOT IN (SELECT descendant_id FROM closure JOIN state ON state.id = ancestor_id)),
  kept AS (SELECT * FROM session WHERE id NOT IN (SELECT descendant_id FROM closure JOIN state ON state.id = ancestor_id WHERE state = 'deleted'))"""


@query(
    f"""{VISIBLE}, kids AS (SELECT parent_session_id AS up, count(*) AS n, sum(cost_nano)::BIGINT AS nano FROM kept WHERE is_subagent GROUP BY 1),
    bad AS (SELECT session_id, count(*) FILTER (event_id % 2 = 0) AS issues, count(*) FILTER (event_id % 2 = 1) AS remarks FROM ev WHERE event_type = 'error' GROUP BY 1),
    c AS (SELECT ancestor_id, count(*) FILTER (depth = 0) AS direct, count(*) AS tree FROM closure JOIN tool_call t ON t.session_id = descendant_id WHERE mcp_server = 'srv0' AND depth <= 5 GROUP BY 1)
    SELECT s.id, 'Day ' || day AS title, path AS project, started_at, cost_nano::BIGINT AS cost_nano, state AS user_state, EXISTS (SELECT 1 FROM closure l JOIN state x ON x.id = l.ancestor_id WHERE l.descendant_id = s.id AND x.state = 'archived') AS is_user_archived,
      coalesce(kids.n, 0) AS subagents, coalesce(nano, 0) AS subagent_nano, coalesce(issues, 0) AS issues, coalesce(remarks, 0) AS remarks, coalesce(direct, 0) AS direct_calls, coalesce(tree, 0) AS tree_calls
    FROM kept s LEFT JOIN project p ON p.id = project_id LEFT JOIN state ON state.id = s.id LEFT JOIN kids ON up = s.id LEFT JOIN bad ON bad.session_id = s.id LEFT JOIN c ON ancestor_id = s.id
    WHERE NOT is_subagent AND tool = 'claude_code' AND substr(started_at, 1, 10) >= '2024-01-03' ORDER BY started_at DESC, s.id DESC LIMIT 100 OFFSET 20""",
    SEEN,
)
def session_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of a tool's sessions from a day on, archived ones too."""
    scope = reads.Scope(date_from="2024-01-03", tool="claude_code", include_archived=True, include_subagents=False)
    out = reads.session_page(_event_archive(spark, d), scope, 100, 20, ("srv0",))
    return out.select("id", "title", "project", "started_at", "cost_nano", "user_state", "is_user_archived", "subagents", "subagent_nano", "issues", "remarks", "direct_calls", "tree_calls")


@query(f"{VISIBLE} SELECT v.id, 'Day ' || day AS title, path AS project, tool, model, started_at FROM vis v LEFT JOIN project p ON p.id = project_id WHERE NOT is_subagent", SEEN)
def session_index(spark: SparkSession, d: str) -> DataFrame:
    return reads.session_index(_event_archive(spark, d))


@query(
    "SELECT DISTINCT ancestor_id AS id FROM closure JOIN session s ON s.id = descendant_id LEFT JOIN project p ON p.id = project_id WHERE contains(lower('Day ' || day), 'y 1') OR contains(path, 'y 1') OR contains(model, 'y 1') OR contains(tool, 'y 1')",
    SEEN,
)
def sessions_containing(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that name a text or have a subagent below that does."""
    a = _event_archive(spark, d)
    return reads.containing(a.session, a.project, a.session.select("id", "title"), " Y 1")


@query(
    f"""{VISIBLE} SELECT p.id, p.path, count(v.id) FILTER (NOT is_subagent) AS sessions, round(coalesce(sum(cost_nano), 0)::DOUBLE / 1e9, 6) AS cost_usd, max(ended_at) AS last_active,
    CASE WHEN p.id = 0 THEN 2 ELSE 0 END::BIGINT AS worktrees, coalesce(string_agg(DISTINCT tool, ',' ORDER BY tool), '') AS tools FROM project p LEFT JOIN vis v ON v.project_id = p.id GROUP BY 1, 2""",
    SEEN,
)
def projects_seen(spark: SparkSession, d: str) -> DataFrame:
    """Projects by the sessions that are shown, with their worktrees."""
    out = reads.projects(_event_archive(spark, d))
    return out.select("id", "path", "sessions", "cost_usd", "last_active", "worktrees", F.array_join("tools", ",").alias("tools"))


@query(
    f"""{VISIBLE} SELECT t.id, t.session_id, 'Day ' || day AS session_title, path AS project, tool_name, input AS input_preview, duration_ms, timestamp FROM tool_call t JOIN vis v ON v.id = session_id LEFT JOIN project p ON p.id = project_id
    WHERE mcp_server = 'srv1' AND path = '/work/p3' AND substr(timestamp, 1, 10) BETWEEN '2024-01-02' AND '2024-01-20' AND duration_ms >= 50 ORDER BY timestamp DESC, t.id DESC LIMIT 100""",
    SEEN,
)
def call_page(spark: SparkSession, d: str) -> DataFrame:
    """Slow calls to a server in a project within some days of their own."""
    scope = reads.CallScope("2024-01-02", "2024-01-20", server="srv1", project="/work/p3", least_ms=50)
    return reads.call_page(_event_archive(spark, d), scope, 500).select("id", "session_id", "session_title", "project", "tool_name", "input_preview", "duration_ms", "timestamp")


@query(
    f"""{VISIBLE}, c AS (SELECT t.* FROM tool_call t JOIN vis v ON v.id = session_id WHERE substr(timestamp, 1, 10) >= '2024-01-02')
    SELECT {CALL_STATS}, round(count(*) FILTER (is_error)::DOUBLE / count(*) * 100, 6) AS error_pct, (SELECT tool_name FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_tool FROM c""",
    SEEN,
)
def call_summary(spark: SparkSession, d: str) -> DataFrame:
    """Calls of the sessions that are shown, from a day on."""
    return reads.call_summary(_event_archive(spark, d), reads.CallScope("2024-01-02"))


@query(f"SELECT session_id, tool_name, tool_kind, mcp_server, {CALL_STATS} FROM tool_call GROUP BY ALL", TC)
def session_tools(spark: SparkSession, d: str) -> DataFrame:
    """Tools of each session's report."""
    return reads.tool_summary(ad.event_tool_calls(spark, d))


@query(
    f"""{VISIBLE}, t AS (SELECT * FROM vis WHERE substr(started_at, 1, 10) = '2024-01-10') SELECT count(*) FILTER (NOT is_subagent) AS sessions, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens,
    coalesce(sum(cache_read_tokens), 0)::BIGINT AS cache_read_tokens, coalesce(sum(cache_creation_tokens), 0)::BIGINT AS cache_creation_tokens, 0::BIGINT AS reasoning_tokens, 0::BIGINT AS reasoning_estimate, {USD},
    (SELECT count(*) FROM ev JOIN t ON t.id = session_id) AS messages, (SELECT count(*) FROM ev JOIN t ON t.id = session_id) AS tool_calls FROM t""",
    SEEN,
)
def day_totals(spark: SparkSession, d: str) -> DataFrame:
    """What a reader of that day sees of it."""
    return reads.day_totals(_event_archive(spark, d), "2024-01-10")


@query("SELECT id, error_count, outcome FROM session", SE)
def session_facets(spark: SparkSession, d: str) -> DataFrame:
    return reads.facets(_event_archive(spark, d).session).select("id", "error_count", "outcome")


REFS = """, r AS (SELECT f.*, CASE WHEN ext <> 'md' THEN split_part(path, '/', 2) ELSE path END AS key, o_custkey % 8 AS project_id, o_orderkey % 2 = 0 AS first_tool, o_orderdate FROM file_ref f JOIN orders ON o_orderkey = session_id),
  k AS (SELECT r.* EXCLUDE (path), p.path AS project FROM r LEFT JOIN project p ON p.id = project_id)"""
COUNTED = """count(*) FILTER (operation = 'read') AS reads, count(*) FILTER (operation = 'edit') AS edits, count(*) FILTER (operation = 'write') AS writes, count(*) FILTER (operation = 'delete') AS deletes"""


@query(
    f"""{REFS} SELECT key, project, {COUNTED}, count(DISTINCT session_id) AS sessions, max(timestamp) AS last_touch FROM k WHERE first_tool AND strftime(o_orderdate, '%Y-%m-%d') >= '1994-01-01' AND project_id <> 7
    GROUP BY 1, 2 ORDER BY count(*) DESC, key, project NULLS FIRST LIMIT 200""",
    ("file_ref", "project"),
)
def project_hotspots(spark: SparkSession, d: str) -> DataFrame:
    """Files by project, of a tool's sessions from a day on whose project is known."""
    a = _order_archive(spark, d)
    a.session = a.session.where("project_id <> 7")
    return reads.file_hotspots(a, scope=reads.Scope("1994-01-01", tool="claude_code"), limit=200)


@query(
    f"""{REFS} SELECT ext AS key, {COUNTED}, count(DISTINCT session_id) AS sessions, max(timestamp) AS last_touch FROM k WHERE project IS NULL AND operation IN ('edit') GROUP BY 1""",
    ("file_ref", "project"),
)
def extension_hotspots(spark: SparkSession, d: str) -> DataFrame:
    """Edits by extension in sessions without a project."""
    return reads.file_hotspots(_order_archive(spark, d), "ext", "edit", reads.Scope(project="")).drop("project")


@query(
    f"""{REFS}, e AS (SELECT session_id, key, project, {COUNTED}, max(timestamp) AS last_touch, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, key, project NULLS FIRST) AS rank FROM k GROUP BY session_id, key, project) SELECT * FROM e WHERE rank <= 25""",
    ("file_ref", "project"),
)
def session_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of each session's report."""
    return reads.hot_files(_order_archive(spark, d))


@query(
    """, n AS (SELECT DISTINCT mcp_server AS s, id % 3 AS k FROM tool_call WHERE mcp_server IS NOT NULL AND NOT (mcp_server = 'srv0' AND id % 3 > 0)),
    l AS (SELECT CASE k WHEN 0 THEN s WHEN 1 THEN 'claude_ai_' || s ELSE 'plugin_' || s || '_' || s END AS mcp_server, 'Srv' || right(s, 1) AS name, CASE k WHEN 0 THEN 'local' WHEN 1 THEN 'connector' ELSE 'plugin' END AS origin FROM n)
    SELECT mcp_server, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' (' || origin || ')' ELSE name END AS label FROM l""",
    TC,
)
def server_labels(spark: SparkSession, d: str) -> DataFrame:
    """Servers as registered in three ways, by names that tell them apart."""
    t = ad.event_tool_calls(spark, d).where("NOT (mcp_server = 'srv0' AND id % 3 > 0)")
    name = F.when(F.col("id") % 3 == 0, F.col("mcp_server")).when(F.col("id") % 3 == 1, F.concat(F.lit("claude_ai_"), "mcp_server")).otherwise(F.concat(F.lit("plugin_"), "mcp_server", F.lit("_"), "mcp_server"))
    return reads.server_labels(t.select(name.alias("mcp_server")))


# Documents.


@query(
    f"""{CHAT}, s AS (SELECT session_id, sum(coalesce(out, 0))::BIGINT * 25000 AS nano, min(said) AS began FROM cb GROUP BY 1),
    r AS (SELECT session_id, min_by(trim(regexp_replace(text, '\\s+', ' ', 'g')), seq) AS t FROM cb WHERE role = 'user' AND trim(text) <> '' AND NOT starts_with(text, '<command-name>') GROUP BY 1),
    h AS (SELECT s.*, (nano + 5000000) // 10000000 AS c, CASE WHEN t IS NOT NULL AND length(t) > 180 THEN left(t, 180) || '…' WHEN t IS NOT NULL THEN t WHEN session_id % 2 = 1 THEN 'Chat' ELSE 'chat' || session_id END AS title FROM s LEFT JOIN r USING (session_id))
    SELECT session_id, -1 AS seq, -1 AS ordinal, '# ' || title || chr(10) || chr(10) || '- **tool:** claude_code' || chr(10) || '- **model:** ' || chr(10) || '- **messages:** 0' || chr(10) || '- **est. cost:** $' || (c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0') || chr(10) || '- **started:** ' || began || chr(10) AS text FROM h
    UNION ALL SELECT session_id, seq, -1, '## ' || upper(role) || chr(10) FROM cb UNION ALL SELECT session_id, seq, 0, text || chr(10) FROM cb WHERE text IS NOT NULL""",
    ("chat",),
)
def markdown_export(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as Markdown, in the parts that are written."""
    a = _chat_archive(spark, d)
    s = a.session.withColumn("source_session_id", F.concat(F.lit("chat"), F.col("id").cast("string")))
    return export.markdown(s, a.message, a.block)


@query(
    f"""WITH {_command_sql()} SELECT session_id, ordinal, CASE WHEN is_error THEN '# (errored in original run)' || chr(10) || '# ' || normalized WHEN starts_with(normalized, 'rm') THEN '# REVIEW: destructive (rm -rf)' || chr(10) || '# ' || normalized
      WHEN starts_with(normalized, 'make') THEN 'mkdir -p "$(dirname ''build/' || ordinal || ''')"' || chr(10) || 'cat > ''build/' || ordinal || ''' <<''REPLAY_EOF''' || chr(10) || 'make build' || chr(10) || 'REPLAY_EOF' ELSE normalized END AS text
    FROM (SELECT * REPLACE (is_error AND NOT starts_with(normalized, 'make') AS is_error) FROM ops)"""
)
def replay_lines(spark: SparkSession, d: str) -> DataFrame:
    """Orders' commands as a script for each group of orders; builds are files that they write."""
    c = _commands(spark, d)
    writes = F.col("normalized").startswith("make")
    text = F.to_json(F.when(writes, F.create_map(F.lit("file_path"), F.concat(F.lit("/w/build/"), F.col("ordinal").cast("string")), F.lit("content"), "normalized")).otherwise(F.create_map(F.lit("command"), "normalized")))
    calls = c.select("session_id", F.col("ordinal").cast("int").alias("seq"), F.lit(0).alias("ordinal"), F.when(writes, "Write").otherwise("Bash").alias("tool_name"), text.alias("input"), "is_error")
    session = c.select(F.col("session_id").alias("id")).distinct().withColumn("tool", F.lit("codex")).withColumn("title", F.lit(None).cast("string")).withColumn("cwd", F.lit("/w"))
    return export.replay(session, calls, include_errors=True).where("seq >= 0").select("session_id", F.col("seq").cast("long").alias("ordinal"), "text")


# What transcripts' rows say of sessions.


def _talks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations as messages, blocks and facts of messages: every ninth turn or so is an
    interruption, and first turns begin with what is asked for."""
    a = _chat_archive(spark, d)
    no = F.lit(False)
    message = a.message.withColumn("is_sidechain", no).withColumn("is_compact_summary", no)
    asked = F.element_at(F.array(*[F.lit(t) for t in ASKED]), (F.col("session_id") % len(ASKED) + 1).cast("int"))
    text = F.when((F.col("session_id") * 7 + F.col("seq")) % 9 == 0, enrich.INTERRUPTION + "]").when(F.col("seq") == 0, F.concat(asked, F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    block = a.block.withColumn("text", text)
    return message, block, enrich.block_facts(block)


ASKED = ("Fix: ", "please rename ", "Should we ", "Install ", "write a ", "", "errors2 ")
TALK = f"""{CHAT}, tk AS (SELECT session_id, seq, role, epoch, (session_id * 7 + seq) % 9 = 0 AS cut, CASE WHEN seq = 0 THEN list_extract({list(ASKED)}, session_id % {len(ASKED)} + 1) || coalesce(text, '') ELSE coalesce(text, '') END AS t FROM cb),
  tr AS (SELECT *, NOT cut AND NOT contains(t, '<command-name>') AND trim(t) <> '' AS is_real, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS nth, epoch - lag(epoch) OVER (PARTITION BY session_id ORDER BY seq) AS gap FROM tk)"""


@query(
    f"""{TALK} SELECT session_id, CASE WHEN bool_or(nth <= 3 AND cut) THEN 'abandoned' WHEN max_by(role, seq) FILTER (role IN ('user', 'assistant')) = 'user' THEN 'abandoned' WHEN bool_or(role IN ('user', 'assistant')) THEN 'completed' END AS outcome FROM tr GROUP BY 1""",
    ("chat",),
)
def session_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """How each conversation ended."""
    message, _, facts = _talks(spark, d)
    return enrich.outcomes(message, facts)


@query(
    f"""{TALK} SELECT session_id, count(*) FILTER (role = 'user' AND is_real) AS turn_count, count(*) FILTER (cut) AS interruption_count, count(*) FILTER (NOT cut AND contains(t, '<command-name>')) AS command_count,
    coalesce(sum(CASE WHEN gap > 0 THEN least(gap, 300) END), 0)::BIGINT AS active_seconds FROM tr GROUP BY 1""",
    ("chat",),
)
def session_counters(spark: SparkSession, d: str) -> DataFrame:
    """What happened in each conversation."""
    message, _, facts = _talks(spark, d)
    session = message.select(F.col("session_id").alias("id")).distinct().withColumn("is_subagent", F.lit(False))
    return enrich.facets(message, facts, session).select("session_id", "turn_count", "interruption_count", "command_count", "active_seconds")


def _work_sql() -> str:
    kinds = []
    for kind, keys in enrich.WORK_WORDS:
        tests = [f"list_has_any(regexp_split_to_array(p, '[^\\p{{L}}\\p{{N}}]+'), {[k for k in keys if ' ' not in k]})", *[f"contains(p, '{k}')" for k in keys if " " in k]]
        kinds.append(f"WHEN {' OR '.join(tests)} THEN '{kind}'")
    return f"CASE {' '.join(kinds)} END"


@query(
    f"""{TALK}, w AS (SELECT session_id, substr(lower(min_by(substr(t, 1, 800), seq)), 1, 400) AS p FROM tr WHERE is_real AND role = 'user' GROUP BY 1)
    SELECT s AS session_id, {_work_sql()} AS work_type FROM (SELECT DISTINCT session_id AS s FROM tr) LEFT JOIN w ON session_id = s""",
    ("chat",),
)
def session_work_types(spark: SparkSession, d: str) -> DataFrame:
    """What each conversation was for, by its first prompt."""
    message, block, facts = _talks(spark, d)
    return enrich.work_types(message, block, facts, spark.createDataFrame([], schema.FILE_REF))


@query(
    """WITH u AS (SELECT p_partkey % 500 AS session_id, p_partkey AS seq, p_partkey % 6 AS k, p_brand AS b FROM part)
    SELECT session_id, seq, 0 AS nth, '/w/p/' || b || '/f' || seq || '.PY' AS path, b || '/f' || seq || '.PY' AS rel_path, 'py' AS ext, CASE k WHEN 0 THEN 'read' ELSE 'edit' END AS operation FROM u WHERE k IN (0, 3)
    UNION ALL SELECT session_id, seq, 0, 'src/f' || seq, 'src/f' || seq, NULL, 'edit' FROM u WHERE k = 1 UNION ALL SELECT session_id, seq, 0, '/else/.f' || seq, NULL, NULL, 'write' FROM u WHERE k = 2
    UNION ALL SELECT session_id, seq, 1, 'a' || seq || '.ts', 'a' || seq || '.ts', 'ts', 'write' FROM u WHERE k = 5 UNION ALL SELECT session_id, seq, 3, 'b c.rs', 'b c.rs', 'rs', 'delete' FROM u WHERE k = 5"""
)
def tool_file_refs(spark: SparkSession, d: str) -> DataFrame:
    """Files that tools' inputs name: by a field of theirs, or in a patch."""
    p = ad.table(spark, d, "part").select((F.col("p_partkey") % 500).alias("session_id"), F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 6).alias("k"), "p_brand")
    n = F.col("seq").cast("string")
    inside = F.concat(F.lit("/w/p/"), "p_brand", F.lit("/f"), n, F.lit(".PY"))
    given = lambda key, path: F.to_json(F.create_map(F.lit(key), path))
    patch = F.concat(F.lit('"*** Begin Patch\\n*** Add File: a'), n, F.lit('.ts\\n+x\\n*** Delete File: b c.rs \\n*** End Patch"'))
    path = F.when(F.col("k") == 0, given("file_path", inside)).when(F.col("k") == 1, given("file_path", F.concat(F.lit("src/f"), n))).when(F.col("k") == 2, given("file_path", F.concat(F.lit("/else/.f"), n)))
    path = path.when(F.col("k") == 3, given("notebook_path", inside)).when(F.col("k") == 4, given("file_path", inside)).otherwise(patch)
    name = F.element_at(F.array(*[F.lit(t) for t in ("Read", "Edit", "Write", "NotebookEdit", "Bash", "apply_patch")]), (F.col("k") + 1).cast("int"))
    block = p.select("session_id", "seq", F.lit(0).alias("ordinal"), F.lit("tool_use").alias("type"), F.when(F.col("k") == 5, "codex").otherwise("claude_code").alias("tool"), name.alias("tool_name"), path.alias("tool_input"))
    session = p.select(F.col("session_id").alias("id"), F.lit("/w/p/").alias("cwd")).distinct()
    refs = enrich.file_refs(block, p.select("session_id", "seq", F.lit(None).cast("string").alias("timestamp")), session)
    return refs.select("session_id", "seq", F.col("nth").cast("int").alias("nth"), "path", "rel_path", "ext", "operation")


@query(
    """WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey < 10 THEN 0 ELSE c_custkey % 4 + 1 END AS k, c_custkey % 10 AS r FROM customer)
    SELECT id, k IN (2, 3, 4) AS is_worktree, CASE k WHEN 0 THEN '/w/root' || id WHEN 1 THEN '/w/solo' || id WHEN 4 THEN 'lone' || id ELSE '/w/root' || r END AS root_path, CASE k WHEN 2 THEN 'feat' || id WHEN 3 THEN 't3code-' || id END AS worktree_label,
    CASE k WHEN 2 THEN 'git' WHEN 3 THEN 't3' WHEN 4 THEN 'conductor' END AS worktree_tool, CASE k WHEN 2 THEN 'intree' WHEN 3 THEN 'namematch' WHEN 4 THEN 'synthetic' ELSE 'self' END AS root_source FROM p"""
)
def worktree_roots(spark: SparkSession, d: str) -> DataFrame:
    """Customers as projects: ten roots, others by themselves, copies inside of a root, copies in
    a tool's folder that are named after a root, and such that are named after none."""
    c = ad.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    n, r = F.col("id").cast("string"), (F.col("id") % 10).cast("string")
    paths = [F.concat(F.lit("/w/solo"), n), F.concat(F.lit("/w/root"), r, F.lit("/.worktrees/feat"), n), F.concat(F.lit("/h/.t3-worktrees/root"), r, F.lit("-t3code-"), n), F.concat(F.lit("/h/conductor/workspaces/lone"), n, F.lit("/city"))]
    path = F.when(F.col("id") < 10, F.concat(F.lit("/w/root"), n)).otherwise(F.element_at(F.array(*paths), (F.col("id") % 4 + 1).cast("int")))
    session = ad.table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), F.date_format("o_orderdate", ad.ISO).alias("started_at"))
    out = worktree.with_roots(c.withColumn("path", path), session)
    return out.select("id", "is_worktree", "root_path", "worktree_label", "worktree_tool", "root_source")


@query(
    """SELECT id, CASE WHEN id % 2 = 0 THEN min(id) OVER (PARTITION BY user_id) ELSE id - 1 END AS parent_session_id FROM session QUALIFY is_subagent""",
    SE,
)
def spawned_parents(spark: SparkSession, d: str) -> DataFrame:
    """Subagents' parents: the session that holds the use which spawned them, else their root."""
    s = ad.event_sessions(spark, d)
    root = F.when(F.col("is_subagent"), F.concat(F.lit("u"), (F.col("id") - 1).cast("string")))
    use = F.when(F.col("is_subagent") & (F.col("id") % 2 == 0), F.concat(F.lit("use"), F.col("id").cast("string")))
    s = s.withColumn("root_source_session_id", root).withColumn("spawn_tool_use_id", use)
    first = s.groupBy("user_id").agg(F.min("id").alias("session_id"))
    block = s.where("spawn_tool_use_id IS NOT NULL").join(first, "user_id").select("session_id", F.col("spawn_tool_use_id").alias("tool_use_id"), "tool")
    block = block.withColumn("type", F.lit("tool_use")).withColumn("tool_name", F.lit("Task")).withColumn("seq", F.lit(0)).withColumn("ordinal", F.lit(0)).withColumn("tool_result", F.lit(None).cast("string"))
    return enrich.with_parents(_filled(s, schema.SESSION), block).where("is_subagent").select("id", "parent_session_id")


@query("SELECT DISTINCT descendant_id AS id FROM closure JOIN state ON state.id = ancestor_id WHERE state = 'deleted'", (*SE, "closure", "state"))
def refused_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that come again though they, or one above them, were deleted."""
    a = _event_archive(spark, d)
    return user_state.inherit(a.session, a.block, a.user_state)[1].select("id")
