"""Transcripts of both producers to messages, blocks, tool calls, sessions and issues.

Lines are read by Spark's text source, so a file of any size is split.  One shuffle by
file numbers the lines and counts the messages before each; the parsed records are
staged, and everything else follows from them by column expressions, narrow windows and
joins by session.  JSON is parsed once, as variants.  A record that a variant cannot hold
(over 128 MB, or a key twice in one object) counts as unparsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.functions.cost import is_priceable
from sessionloom.functions.records import bool_at, int_at, is_object, iso_utc, json_text, list_at, millis_between, number_at, part, preview, preview_head_tail, text_at, trimmed
from sessionloom.operators.context import asof_stamp
from sessionloom.sources.manifest import local_path, stem, with_tool
from sessionloom.staging import staged, unstage

# Journal records of the first producer that are no messages.
IGNORED = (
    "agent-name", "last-prompt", "permission-mode", "attachment", "file-history-delta", "file-history-snapshot",
    "frame-link", "inter_agent_communication_metadata", "mode", "pr-link", "queue-operation", "world_state",
)
# Record types with titles; types of calls and outputs of the second producer.
TITLES = ("summary", "ai-title")
CALLS = ("function_call", "custom_tool_call", "tool_search_call", "mcp_tool_call")
OUTPUTS = ("function_call_output", "custom_tool_call_output", "tool_search_output")
SECOND_TYPES = ("session_meta", "turn_context", "response_item", "event_msg", "compacted")
# Labels of reasoning effort whose case doesn't count.
EFFORTS = ("none", "minimal", "low", "medium", "high", "xhigh", "max", "ultra", "mixed")

USAGE = "struct<input: bigint, output: bigint, cache_read: bigint, cache_creation: bigint, cache_creation_1h: bigint, reasoning: bigint>"
TITLE_LENGTH = 120
V = F.col


def _first_usage(v: Column, path: str) -> Column:
    """Token counts of the first producer; what is no whole number counts 0.  Null where the
    usage is no object."""
    n = lambda x: F.coalesce(int_at(v, f"{path}.{x}"), F.lit(0)).cast("bigint")
    counts = F.struct(
        n("input_tokens").alias("input"), n("output_tokens").alias("output"), n("cache_read_input_tokens").alias("cache_read"),
        n("cache_creation_input_tokens").alias("cache_creation"), n("cache_creation.ephemeral_1h_input_tokens").alias("cache_creation_1h"), F.lit(0).cast("bigint").alias("reasoning"),
    )
    return F.when(is_object(v, path), counts)


def _second_usage(v: Column, path: str) -> Column:
    """Token counts of the second producer, whose input includes what was cached and written:
    parts that fit into it are taken out, a written part that doesn't fit counts 0."""
    n = lambda x: F.coalesce(int_at(v, f"{path}.{x}"), F.lit(0)).cast("bigint")
    cached, written = n("cached_input_tokens"), n("cache_write_input_tokens")
    write = F.when(cached + written <= n("input_tokens"), written).otherwise(F.lit(0).cast("bigint"))
    return F.struct(
        F.greatest(F.lit(0), n("input_tokens") - cached - write).cast("bigint").alias("input"), n("output_tokens").alias("output"), cached.alias("cache_read"),
        write.alias("cache_creation"), F.lit(0).cast("bigint").alias("cache_creation_1h"), n("reasoning_output_tokens").alias("reasoning"),
    )


def _mcp_call(v: Column) -> Column:
    """Does an end event of the second producer say all that a call needs?"""
    named = lambda x: F.coalesce(text_at(v, f"$.payload.invocation.{x}") != "", F.lit(False))
    return (text_at(v, "$.payload.type") == "mcp_tool_call_end") & named("server") & named("tool") & text_at(v, "$.payload.call_id").isNotNull()


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """``(path, tool, is_archived, block_start, row, raw)`` of the transcripts under the paths."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("lineSep", "\n").text(list(paths))
    at = found.select(local_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("raw"))
    return with_tool(at)


def typed(found: DataFrame) -> DataFrame:
    """Lines as what they say by themselves: ``(path, tool, is_archived, block_start, row, is_blank,
    raw, v, type, emitted, own_id)``.  ``v`` is null for lines that aren't JSON, whose ``raw``
    is kept; ``emitted`` is how many messages a line makes."""
    v, empty = V("v"), trimmed(V("raw")) == ""
    at = found.withColumn("is_blank", empty).withColumn("v", F.when(~empty, F.try_parse_json("raw"))).withColumn("type", F.coalesce(text_at(v, "$.type"), F.lit("")))
    first = F.when(V("type").isin("result", *TITLES, *IGNORED), 0).otherwise(1)
    second = F.when(V("type").isin("response_item", "compacted"), 1).when((V("type") == "event_msg") & _mcp_call(v), 2).otherwise(0)
    emitted = F.when(v.isNull(), 0).when(V("tool") == "codex", second).otherwise(first)
    named = F.when((V("tool") == "codex") & (V("type") == "session_meta"), text_at(v, "$.payload.id"))
    return at.select("path", "tool", "is_archived", "block_start", "row", "is_blank", F.when(v.isNull(), V("raw")).alias("raw"), "v", "type", emitted.alias("emitted"), named.alias("own_id"))


def records(read: DataFrame) -> DataFrame:
    """One row for each line that isn't blank: ``(path, tool, is_archived, line_no, raw, v, type,
    seq, emitted, source_session_id, session_id)``; ``seq`` is the number of messages of the
    file before the record.

    ``read`` are staged rows of ``typed``.  Lines are numbered within their split of a file, and
    one row for each split says what comes before it, so no task has more than a split,
    however long a transcript is.  A split's lines have consecutive ``row``s."""
    splits = read.groupBy("path", "block_start").agg(
        F.min("row").alias("first_row"), F.count("*").alias("lines"), F.sum("emitted").alias("sent"), F.max_by("own_id", F.when(V("own_id").isNotNull(), V("row"))).alias("own_id")
    )
    order = W.partitionBy("path").orderBy("block_start")
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    named = F.last("own_id", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    splits = splits.select("path", "block_start", "first_row", before("lines").alias("lines_before"), before("sent").alias("sent_before"), named.alias("named"))
    here = W.partitionBy("path", "block_start").orderBy("row").rowsBetween(W.unboundedPreceding, W.currentRow)
    at = read.where("NOT is_blank").drop("own_id").withColumn("sent", F.sum("emitted").over(here) - V("emitted")).join(splits, ["path", "block_start"])
    at = at.withColumn("source_session_id", F.coalesce("named", stem(V("path"))))
    return at.select(
        "path", "tool", "is_archived", (V("lines_before") + V("row") - V("first_row") + 1).cast("int").alias("line_no"), "raw", "v", "type", (V("sent_before") + V("sent")).cast("int").alias("seq"), "emitted", "source_session_id",
        F.xxhash64("tool", "source_session_id").alias("session_id"),
    )


def superseded(recs: DataFrame) -> DataFrame:
    """``(path)`` of the files whose session another file gives as well: the last one in the
    order of the listing (archived files last) stands for it."""
    files = recs.groupBy("session_id", "path").agg(F.max("is_archived").alias("a"))
    nth = F.row_number().over(W.partitionBy("session_id").orderBy(V("a").desc(), V("path").desc()))
    return files.withColumn("nth", nth).where("nth > 1").select("path")


# Messages.


def _joined_text(v: Column, path: str) -> Column:
    """A string, or the texts of an array's items in lines; else empty."""
    items = F.array_join(F.transform(list_at(v, path), lambda x: text_at(x, "$.text")), "\n")
    return F.coalesce(text_at(v, path), items, F.lit(""))


def _source_fields(v: Column) -> list[Column]:
    return [
        F.coalesce(bool_at(v, "$.isSidechain"), F.lit(False)).alias("is_sidechain"), F.coalesce(bool_at(v, "$.isCompactSummary"), F.lit(False)).alias("is_compact_summary"),
        text_at(v, "$.subtype").alias("subtype"), V("type").alias("raw_type"), text_at(v, "$.payload.role").alias("payload_role"),
        text_at(v, "$.compactMetadata.trigger").alias("compact_trigger"), F.when(number_at(v, "$.compactMetadata.preTokens") >= 0, number_at(v, "$.compactMetadata.preTokens")).cast("long").alias("pre_tokens"),
    ]


def _first_messages(recs: DataFrame) -> DataFrame:
    v, kind = V("v"), V("type")
    spoken, replied = kind.isin("user", "assistant"), kind == "assistant"
    kinds = F.transform(list_at(v, "$.message.content"), lambda x: text_at(x, "$.type"))
    has = lambda k: F.coalesce(F.array_contains(kinds, k), F.lit(False))
    role = F.when((kind == "user") & has("tool_result") & ~has("text"), "tool").when(spoken | (kind == "system"), kind).otherwise("other")
    return recs.where("tool = 'claude_code' AND emitted > 0").select(
        "session_id", "path", "tool", "line_no", "seq", role.alias("role"), F.when(replied, text_at(v, "$.message.model")).alias("model"), F.when(replied, text_at(v, "$.message.stop_reason")).alias("stop_reason"),
        text_at(v, "$.timestamp").alias("timestamp"), F.when(replied, _first_usage(v, "$.message.usage")).alias("said_usage"),
        F.when(replied, text_at(v, "$.requestId", "$.request_id")).alias("request_id"), text_at(v, "$.uuid", "$.message.id").alias("source_uuid"), text_at(v, "$.parentUuid", "$.parent_uuid").alias("parent_source_uuid"),
        *_source_fields(v),
    )


def _second_messages(recs: DataFrame) -> DataFrame:
    v = V("v")
    rows = recs.where("tool = 'codex' AND emitted > 0").withColumn("k", F.explode(F.sequence(F.lit(0), V("emitted") - 1)))
    kind, said = text_at(v, "$.payload.type"), text_at(v, "$.payload.role")
    role = (
        F.when(V("type") == "compacted", "system").when(V("type") == "event_msg", F.when(V("k") == 0, "assistant").otherwise("tool"))
        .when(kind == "message", F.when(said.isin("assistant", "system"), said).otherwise("user"))
        .when(kind.isin("reasoning", "web_search_call", *CALLS), "assistant").when(kind.isin(*OUTPUTS), "tool").otherwise("other")
    )
    ended = text_at(v, "$.timestamp")
    took = F.coalesce(int_at(v, "$.payload.duration.secs"), F.lit(0)) * 1000 + F.floor(F.coalesce(int_at(v, "$.payload.duration.nanos"), F.lit(0)) / 1_000_000 + 0.5)
    began = F.coalesce(iso_utc(F.unix_millis(F.try_to_timestamp(ended)) - took.cast("long")), ended)
    none = F.lit(None).cast("string")
    return rows.select(
        "session_id", "path", "tool", "line_no", (V("seq") + V("k")).alias("seq"), role.alias("role"), none.alias("model"), none.alias("stop_reason"),
        F.when((V("type") == "event_msg") & (V("k") == 0), began).otherwise(ended).alias("timestamp"), F.lit(None).cast(USAGE).alias("said_usage"),
        none.alias("request_id"), none.alias("source_uuid"), none.alias("parent_source_uuid"), *_source_fields(v),
    )


def _billed(messages: DataFrame) -> DataFrame:
    """``usage`` of each message.  Records of one request bill once: the earliest with the
    greatest output keeps its usage.  Records without a request keep theirs."""
    again = V("said_usage").isNotNull() & V("request_id").isNotNull()
    nth = F.row_number().over(W.partitionBy("session_id", F.when(again, V("request_id")).otherwise(F.concat(F.lit("\0"), V("seq").cast("string")))).orderBy(V("said_usage.output").desc(), "seq"))
    return messages.withColumn("usage", F.when(~again | (nth == 1), V("said_usage")))


def messages(recs: DataFrame) -> DataFrame:
    """One row for each message, without its content."""
    both = _first_messages(recs).unionByName(_second_messages(recs))
    v = V("v")
    readings = recs.where("tool = 'codex' AND type = 'event_msg'").where(text_at(v, "$.payload.type") == "token_count").where(is_object(v, "$.payload.info.last_token_usage"))
    readings = readings.select("session_id", "line_no", _second_usage(v, "$.payload.info.last_token_usage").alias("usage"))
    second = both.where("tool = 'codex'")
    stamps = asof_stamp(second.select("session_id", "line_no", "seq", "role"), readings).withColumnRenamed("usage", "stamp")
    stamped = second.join(stamps, ["session_id", "seq"], "left").withColumn("usage", V("stamp")).drop("stamp")
    return _billed(both.where("tool = 'claude_code'")).unionByName(stamped)


# Blocks.


def _first_blocks(recs: DataFrame) -> DataFrame:
    v, user, replied = V("v"), V("type") == "user", V("type") == "assistant"
    rows = recs.where("tool = 'claude_code' AND type IN ('user', 'assistant')").withColumn("plain", F.when(user, text_at(v, "$.message.content")))
    none = F.array().cast("array<variant>")
    items = F.when(V("plain").isNotNull(), F.array(F.lit(None).cast("variant"))).otherwise(F.coalesce(list_at(v, "$.message.content"), none))
    rows = rows.select("session_id", "tool", "seq", "type", "plain", F.posexplode(items).alias("ordinal", "p")).withColumn("kind", F.coalesce(text_at(V("p"), "$.type"), F.lit("")))
    p, kind = V("p"), V("kind")
    result = F.when(user & (kind == "tool_result"), True).otherwise(False)
    known = (
        F.when(V("plain").isNotNull() | (kind == "text"), "text").when(result, "tool_result").when(replied & kind.isin("thinking", "tool_use"), kind).otherwise("other")
    )
    rows = rows.withColumn("block_type", known)
    is_a = lambda *kinds: V("block_type").isin(*kinds)
    content = F.transform(list_at(p, "$.content"), lambda x: F.coalesce(text_at(x, "$.text"), json_text(x)))
    told = F.coalesce(text_at(p, "$.content"), F.array_join(content, "\n"), json_text(part(p, "$.content")), F.lit(""))
    text = F.when(V("plain").isNotNull(), V("plain")).when(is_a("text"), F.coalesce(text_at(p, "$.text"), F.lit(""))).when(is_a("thinking"), text_at(p, "$.thinking")).when(is_a("other"), json_text(p))
    return rows.select(
        "session_id", "tool", "seq", "ordinal", V("block_type").alias("type"), text.alias("text"), F.when(is_a("tool_use"), text_at(p, "$.name")).alias("tool_name"),
        F.when(is_a("tool_use"), text_at(p, "$.id")).when(is_a("tool_result"), text_at(p, "$.tool_use_id")).alias("tool_use_id"), F.when(is_a("tool_use"), json_text(part(p, "$.input"))).alias("tool_input"),
        F.when(is_a("tool_result"), told).alias("tool_result"), F.when(is_a("tool_result"), bool_at(p, "$.is_error")).alias("is_error"),
    )


def _mcp_text(v: Column) -> Column:
    """What a result says: its texts, else its structured content, else nothing for a bare
    success; any other result as a whole."""
    whole = F.coalesce(json_text(part(v, "$.payload.result")), F.lit("null"))
    content = list_at(v, "$.payload.result.Ok.content")
    texts = F.filter(F.transform(content, lambda x: F.when(text_at(x, "$.type") == "text", text_at(x, "$.text"))), lambda t: t != "")
    structured = json_text(part(v, "$.payload.result.Ok.structuredContent"))
    told = F.when(F.size(texts) > 0, F.array_join(texts, "\n")).otherwise(F.coalesce(structured, F.when(content.isNotNull(), F.lit("")), whole))
    return F.when(part(v, "$.payload.result.Ok").isNull(), whole).otherwise(told)


def _second_blocks(recs: DataFrame) -> DataFrame:
    v = V("v")
    rows = recs.where("tool = 'codex' AND emitted > 0").withColumn("k", F.explode(F.sequence(F.lit(0), V("emitted") - 1)))
    kind = text_at(v, "$.payload.type")
    event, call = V("type") == "event_msg", V("k") == 0
    known = (
        F.when(V("type") == "compacted", "text").when(event, F.when(call, "tool_use").otherwise("tool_result")).when(kind == "message", "text").when(kind == "reasoning", "thinking")
        .when(kind.isin(*CALLS), "tool_use").when(kind.isin(*OUTPUTS), "tool_result").when(kind == "web_search_call", "web_search").otherwise("other")
    )
    rows = rows.withColumn("block_type", known)
    is_a = lambda *kinds: V("block_type").isin(*kinds)
    summary = trimmed(_joined_text(v, "$.payload.summary"))
    text = (
        F.when(V("type") == "compacted", text_at(v, "$.payload.message")).when(is_a("text"), _joined_text(v, "$.payload.content"))
        .when(is_a("thinking"), F.when(summary != "", summary).otherwise(_joined_text(v, "$.payload.content"))).when(is_a("other"), F.coalesce(json_text(part(v, "$.payload")), F.lit("null")))
    )
    name, space = text_at(v, "$.payload.name"), text_at(v, "$.payload.namespace")
    qualified = F.when((name == "") | F.coalesce(space == "", F.lit(True)) | name.startswith(F.concat(space, F.lit("__"))), name).otherwise(F.concat(space, F.lit("__"), name))
    server, tool = text_at(v, "$.payload.invocation.server"), text_at(v, "$.payload.invocation.tool")
    served = F.concat(F.when(server.startswith("mcp__"), F.lit("")).otherwise(F.lit("mcp__")), server, F.lit("__"), tool)
    given = F.coalesce(part(v, "$.payload.arguments"), part(v, "$.payload.input"))
    output = F.coalesce(text_at(v, "$.payload.output"), json_text(part(v, "$.payload.output")), F.lit(""))
    failed = part(v, "$.payload.result.Err").isNotNull() | F.coalesce(bool_at(v, "$.payload.result.Ok.isError"), F.lit(False))
    out = rows.select(
        "session_id", "tool", (V("seq") + V("k")).alias("seq"), F.lit(0).alias("ordinal"), V("block_type").alias("type"), text.alias("text"),
        F.when(event & call, served).when(is_a("tool_use"), qualified).when(is_a("web_search"), "web_search").alias("tool_name"),
        F.when(is_a("tool_use", "tool_result"), text_at(v, "$.payload.call_id")).alias("tool_use_id"),
        F.when(event & call, json_text(part(v, "$.payload.invocation.arguments"))).when(is_a("tool_use"), json_text(given)).alias("tool_input"),
        F.when(event & ~call, _mcp_text(v)).when(is_a("tool_result"), output).alias("tool_result"), F.when(event & ~call, failed).alias("is_error"), V("type").alias("raw_type"),
    )
    return out.where("NOT (raw_type = 'compacted' AND coalesce(text, '') = '')").drop("raw_type")


def blocks(recs: DataFrame) -> DataFrame:
    """One row for each content part: ``(session_id, tool, seq, ordinal, type, text, tool_name,
    tool_use_id, tool_input, tool_result, is_error)``.  No shuffle."""
    return _first_blocks(recs).unionByName(_second_blocks(recs))


# Calls.


def classify_tool(name: Column) -> dict[str, Column]:
    """``mcp__server__tool`` names, split at the first pair of underscores behind the server."""
    rest = F.substring(name, 6, 1 << 20)
    cut = F.instr(rest, "__")
    mcp = name.startswith("mcp__")
    return {
        "tool_kind": F.when(mcp, "mcp").otherwise("builtin"),
        "mcp_server": F.when(mcp & (cut > 0), F.substring_index(rest, "__", 1)),
        "mcp_tool": F.when(mcp, F.when(cut > 0, F.substring(rest, cut + 2, F.lit(1 << 20))).otherwise(rest)).otherwise(name),
    }


def tool_calls(blks: DataFrame, msgs: DataFrame) -> DataFrame:
    """One row for each tool use, with the last result of its id in the session, if any."""
    at = msgs.select("session_id", "seq", "timestamp")
    placed = blks.where("type IN ('tool_use', 'tool_result')").join(at, ["session_id", "seq"], "left")
    last = placed.where("type = 'tool_result' AND tool_use_id IS NOT NULL").groupBy("session_id", "tool_use_id").agg(
        F.max_by(F.struct("tool_result", "is_error", V("timestamp").alias("ended"), "seq", "ordinal"), F.struct("seq", "ordinal")).alias("r")
    )
    calls = placed.where("type = 'tool_use'").drop("tool_result", "is_error").withColumn("tool_name", F.coalesce("tool_name", F.lit(""))).join(last, ["session_id", "tool_use_id"], "left")
    parts = classify_tool(V("tool_name"))
    return calls.select(
        F.xxhash64("session_id", "seq", "ordinal").alias("id"), "session_id", "seq", "ordinal", "tool_use_id", "tool_name", *[c.alias(k) for k, c in parts.items()], V("tool_input").alias("input"),
        preview_head_tail(F.coalesce("r.tool_result", F.when(V("r").isNotNull(), F.lit(""))), 500).alias("output_preview"), V("r.is_error").alias("is_error"), V("r").isNotNull().alias("has_result"),
        V("r.seq").alias("result_seq"), V("r.ordinal").alias("result_ordinal"), "timestamp", millis_between(V("timestamp"), V("r.ended")).alias("duration_ms"),
        F.octet_length("tool_input").cast("long").alias("input_bytes"), F.octet_length(F.coalesce("r.tool_result", F.when(V("r").isNotNull(), F.lit("")))).cast("long").alias("output_bytes"),
    )


# Sessions.


def _first_of(x: Column) -> Column:
    return F.min_by(x, F.when(x.isNotNull(), V("line_no")))


def _last_of(x: Column) -> Column:
    return F.max_by(x, F.when(x.isNotNull(), V("line_no")))


def effort_scan(spark: SparkSession, *paths: str) -> DataFrame:
    """``(path, reasoning_effort, reasoning_effort_levels)`` of transcripts by that field alone:
    only lines that can name it are parsed, and only they are put in order.  For archives
    that were filled before the field was kept."""
    found = lines(spark, *paths).where(V("raw").contains('"effort"') | V("raw").contains("\\u"))
    v = F.try_parse_json("raw")
    recs = found.select("path", "tool", "block_start", "row", v.alias("v")).where("v IS NOT NULL").withColumn("type", F.coalesce(text_at(V("v"), "$.type"), F.lit("")))
    recs = recs.select(V("path").alias("session_id"), F.struct("block_start", "row").alias("line_no"), "tool", "type", "v")
    return efforts(recs).withColumnRenamed("session_id", "path")


def efforts(recs: DataFrame) -> DataFrame:
    """``(session_id, reasoning_effort, reasoning_effort_levels)``: the labels in the order in
    which they are met; several are ``mixed`` in short."""
    v = V("v")
    path = lambda p: F.coalesce(text_at(v, p), F.when(number_at(v, p).isNotNull(), json_text(part(v, p))))
    raw = F.when(V("tool") == "claude_code", path("$.effort")).when(V("type") == "turn_context", path("$.payload.effort"))
    said = recs.select("session_id", "line_no", trimmed(raw).alias("e")).where("e <> ''")
    said = said.withColumn("e", F.when(F.lower("e").isin(*EFFORTS), F.lower("e")).otherwise(V("e"))).groupBy("session_id", "e").agg(F.min("line_no").alias("at"))
    levels = said.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("at", "e"))).e.alias("reasoning_effort_levels"))
    short = F.when(F.size("reasoning_effort_levels") > 1, "mixed").otherwise(V("reasoning_effort_levels")[0])
    return levels.select("session_id", short.alias("reasoning_effort"), "reasoning_effort_levels")


def estimated_reasoning(msgs: DataFrame, blks: DataFrame) -> DataFrame:
    """``(session_id, reasoning_estimate, any_thinking)`` of the first producer: of each request
    that thinks, the output beyond a quarter of the visible bytes."""
    visible = F.when(V("type") == "text", F.octet_length(F.coalesce("text", F.lit("")))).when(V("type") == "tool_use", F.coalesce(F.octet_length("tool_input"), F.lit(0))).otherwise(0)
    seen = blks.where("tool = 'claude_code'").groupBy("session_id", "seq").agg(F.sum(visible).alias("visible"), F.bool_or(V("type") == "thinking").alias("thinks"))
    replies = msgs.where("tool = 'claude_code' AND role = 'assistant'").select("session_id", "seq", F.coalesce("request_id", F.concat(F.lit("\0"), V("seq").cast("string"))).alias("request"), F.coalesce("said_usage.output", F.lit(0)).alias("output"))
    turns = replies.join(seen, ["session_id", "seq"], "left").groupBy("session_id", "request").agg(
        F.max("output").alias("output"), F.coalesce(F.sum("visible"), F.lit(0)).alias("visible"), F.coalesce(F.bool_or("thinks"), F.lit(False)).alias("thinks")
    )
    beyond = F.greatest(F.lit(0), V("output") - F.floor(V("visible") / 4))
    return turns.where("thinks").groupBy("session_id").agg(F.sum(beyond).cast("long").alias("reasoning_estimate"), F.lit(True).alias("any_thinking"))


def primary_model(msgs: DataFrame) -> DataFrame:
    """``(session_id, primary)``: of the models with a price, or else of all, the most frequent,
    then the first by name."""
    n = msgs.where("model IS NOT NULL").groupBy("session_id", "model").agg(F.count("*").alias("n")).withColumn("priced", is_priceable(V("model")))
    nth = F.row_number().over(W.partitionBy("session_id").orderBy(V("priced").desc(), V("n").desc(), "model"))
    return n.withColumn("nth", nth).where("nth = 1").select("session_id", V("model").alias("primary"))


def _prompt_titles(msgs: DataFrame, blks: DataFrame) -> DataFrame:
    """The first text of the first user message that has any (second producer: any that isn't
    empty)."""
    texts = blks.where("type = 'text'").where("tool = 'claude_code' OR text <> ''").select("session_id", "seq", "ordinal", F.substring(trimmed(V("text")), 1, TITLE_LENGTH + 1).alias("t"))
    said = texts.join(msgs.where("role = 'user'").select("session_id", "seq"), ["session_id", "seq"], "left_semi")
    return said.groupBy("session_id").agg(F.min_by("t", F.struct("seq", "ordinal")).alias("t")).select("session_id", preview(V("t"), TITLE_LENGTH).alias("prompt_title"))


def _said(recs: DataFrame) -> DataFrame:
    """What the records say of their session, one row each."""
    v, kind, first = V("v"), V("type"), V("tool") == "claude_code"
    meta, turn = kind == "session_meta", kind == "turn_context"
    count = (kind == "event_msg") & (text_at(v, "$.payload.type") == "token_count")
    total = F.when(is_object(v, "$.payload.info.total_token_usage"), _second_usage(v, "$.payload.info.total_token_usage")).otherwise(_second_usage(v, "$.payload"))
    spawn = "$.payload.source.subagent.thread_spawn"
    sidechain = first & F.coalesce(bool_at(v, "$.isSidechain"), F.lit(False))
    a, b = lambda c: F.when(first, c), lambda test, c: F.when(~first & test, c)
    stated = recs.where("v IS NOT NULL").select(
        "session_id", "tool", "path", "source_session_id", "is_archived", "line_no", text_at(v, "$.timestamp").alias("at"),
        a(text_at(v, "$.sessionId", "$.session_id")).alias("root"), sidechain.alias("sidechain"), (first & ~sidechain & kind.isin("user", "assistant", "system")).alias("main"),
        a(text_at(v, "$.agentId", "$.agent_id")).alias("agent"), a(text_at(v, "$.cwd")).alias("cwd_first"), a(text_at(v, "$.gitBranch", "$.git_branch")).alias("branch"),
        a(text_at(v, "$.version", "$.cli_version")).alias("version_first"), a(text_at(v, "$.message.model", "$.model")).alias("model_first"),
        F.when(first & (kind == "result"), _first_usage(v, "$.usage")).alias("result"), F.when(first & kind.isin(*TITLES), preview(trimmed(text_at(v, "$.summary", "$.title")), TITLE_LENGTH)).alias("meta_title"),
        b(meta, text_at(v, "$.payload.cwd")).alias("cwd_meta"), b(turn, text_at(v, "$.payload.cwd")).alias("cwd_turn"), b(meta, text_at(v, "$.payload.cli_version")).alias("version_last"),
        b(meta, text_at(v, "$.payload.parent_thread_id", f"{spawn}.parent_thread_id")).alias("thread"), b(meta, part(v, "$.payload.source.subagent").isNotNull()).alias("spawned"),
        b(meta, text_at(v, "$.payload.agent_nickname", f"{spawn}.agent_nickname")).alias("nickname"), b(meta, text_at(v, "$.payload.agent_role", f"{spawn}.agent_role", "$.payload.source.subagent")).alias("role_name"),
        b(meta, int_at(v, f"{spawn}.depth", "$.payload.spawn_depth")).alias("depth"), b(meta, json_text(part(v, "$.payload"))).alias("meta"), b(turn, text_at(v, "$.payload.model")).alias("model_last"),
        b(count, total).alias("reading"), b(count, int_at(v, "$.payload.info.model_context_window")).alias("window"),
    )
    return stated.groupBy("session_id", "tool", "path", "source_session_id").agg(
        F.bool_or("is_archived").alias("is_archived"), _first_of(V("at")).alias("started_at"), _last_of(V("at")).alias("ended_at"), F.bool_or("sidechain").alias("saw_sidechain"), F.bool_or("main").alias("saw_main"),
        F.coalesce(_first_of(V("cwd_first")), _last_of(V("cwd_meta")), _first_of(V("cwd_turn"))).alias("cwd"), F.coalesce(_first_of(V("version_first")), _last_of(V("version_last"))).alias("version"),
        F.coalesce(F.bool_or("spawned"), F.lit(False)).alias("spawned"), *[_first_of(V(c)).alias(c) for c in ("root", "agent", "branch", "model_first", "meta_title")],
        *[_last_of(V(c)).alias(c) for c in ("result", "thread", "nickname", "role_name", "depth", "meta", "model_last", "reading", "window")],
    )


def sessions(recs: DataFrame, msgs: DataFrame, blks: DataFrame, titles: DataFrame | None = None, sidecars: DataFrame | None = None) -> DataFrame:
    """One row for each session.

    Totals are the sums of billed usages or the last ``result`` record's usage; for the second
    producer its last cumulative reading.  ``titles(source_session_id, thread_name)`` is the
    second producer's index, ``sidecars(path, meta)`` what stands beside the first one's files.
    """
    spark = recs.sparkSession
    titles = spark.createDataFrame([], "source_session_id string, thread_name string") if titles is None else titles
    sidecars = spark.createDataFrame([], "path string, meta variant") if sidecars is None else sidecars
    kinds = ("input", "output", "cache_read", "cache_creation", "cache_creation_1h", "reasoning")
    sums = msgs.groupBy("session_id").agg(F.count("*").cast("long").alias("message_count"), F.struct(*[F.coalesce(F.sum(f"usage.{k}"), F.lit(0)).cast("bigint").alias(k) for k in kinds]).alias("sums"))
    s = _said(recs).join(sums, "session_id", "left")
    for more in (primary_model(msgs), efforts(recs), estimated_reasoning(msgs, blks), _prompt_titles(msgs, blks)):
        s = s.join(more, "session_id", "left")
    s = s.join(sidecars.select("path", V("meta").alias("beside"), F.lit(True).alias("has_sidecar")), "path", "left").join(titles.withColumn("_tool", F.lit("codex")), (s.source_session_id == titles.source_session_id) & (s.tool == F.lit("codex")), "left").drop(titles.source_session_id)
    first = V("tool") == "claude_code"
    in_folder = F.array_contains(F.split("path", "/"), "subagents")
    is_subagent = F.when(first, in_folder | F.coalesce("has_sidecar", F.lit(False)) | (V("saw_sidechain") & ~V("saw_main"))).otherwise(V("spawned") | V("thread").isNotNull())
    by_path = F.nullif(F.regexp_extract("path", r"(?:^|/)agent-([^/]*)\.jsonl$", 1), F.lit(""))
    s = s.withColumn("is_subagent", is_subagent)
    s = s.withColumn("agent_id", F.when(first, F.coalesce(by_path, "agent")).otherwise(F.coalesce("nickname", F.when(V("is_subagent"), V("source_session_id")))))
    s = s.withColumn("agent_type", F.when(first, text_at(V("beside"), "$.subagent_type", "$.subagentType", "$.agentType")).otherwise(V("role_name")))
    s = s.withColumn("spawn_tool_use_id", F.when(first, text_at(V("beside"), "$.toolUseId"))).withColumn("spawn_depth", F.when(first, int_at(V("beside"), "$.spawnDepth")).otherwise(V("depth")).cast("int"))
    zero = F.struct(*[F.lit(0).cast("bigint").alias(k) for k in kinds])
    s = s.withColumn("totals", F.coalesce(F.when(first, F.coalesce("result", "sums")).otherwise(V("reading")), zero))
    estimate = F.coalesce("reasoning_estimate", F.lit(0))
    estimate = F.when(~first, 0).when(V("result").isNotNull(), F.least(estimate, V("totals.output"))).otherwise(estimate)
    own = F.struct(V("root").alias("sessionId"), V("is_subagent").alias("isSubagent"), V("agent_id").alias("agentId"), V("agent_type").alias("agentType"), V("spawn_tool_use_id").alias("spawnToolUseId"), V("spawn_depth").alias("spawnDepth"))
    return s.select(
        V("session_id").alias("id"), "tool", "source_session_id", "path", "is_archived", "is_subagent", F.when(first, V("root")).otherwise(V("thread")).alias("root_source_session_id"), "agent_id", "agent_type",
        "spawn_tool_use_id", "spawn_depth", F.when(first, F.coalesce("prompt_title", "meta_title")).otherwise(F.coalesce("thread_name", "prompt_title")).alias("title"), "cwd", V("branch").alias("git_branch"), "version",
        F.when(first, F.coalesce("primary", "model_first")).otherwise(V("model_last")).alias("model"), "reasoning_effort", F.coalesce("reasoning_effort_levels", F.array().cast("array<string>")).alias("reasoning_effort_levels"),
        "started_at", "ended_at", F.coalesce("message_count", F.lit(0)).alias("message_count"), *[V(f"totals.{k}").alias(f"{k}_tokens") for k in kinds], estimate.cast("long").alias("reasoning_estimate"),
        F.when(first, F.when(V("any_thinking"), "inferred").otherwise("none")).otherwise(F.when(V("reading").isNotNull(), "reported").otherwise("none")).alias("reasoning_source"),
        V("window").cast("long").alias("explicit_window_tokens"), F.when(first, F.to_json(own, {"ignoreNullFields": "false"})).otherwise(V("meta")).alias("raw_meta"),
    )


# Issues.


def issues(recs: DataFrame, blks: DataFrame) -> DataFrame:
    """``(source_path, session_id, line_no, code, error, raw_line)``: lines that aren't JSON,
    unknown record types once each, and what is wrong between tool uses and results."""
    from sessionloom.operators.linkage import linkage_issues

    none, line = F.lit(None).cast("string"), lambda c: F.lit(None).cast("int") if c is None else V(c)
    bad = recs.where("v IS NULL").select(V("path").alias("source_path"), "session_id", "line_no", F.lit("unparsed_line").alias("code"), F.lit("the line is not JSON").alias("error"), V("raw").alias("raw_line"))
    known = F.when(V("tool") == "codex", V("type").isin(*SECOND_TYPES)).otherwise(V("type").isin("user", "assistant", "system", "result", *TITLES, *IGNORED))
    odd = recs.where("v IS NOT NULL").where(~known).groupBy("path", "session_id", "tool", "type").agg(F.min("line_no").alias("line_no"), F.count("*").alias("n"))
    fate = F.when(V("tool") == "codex", F.lit("ignored")).otherwise(F.lit('kept as role "other"'))
    said = F.concat(F.lit('unknown record type "'), V("type"), F.lit('" on '), V("n").cast("string"), F.lit(" line(s); "), fate)
    odd = odd.select(V("path").alias("source_path"), "session_id", "line_no", F.lit("unknown_record_type").alias("code"), said.alias("error"), none.alias("raw_line"))
    paths = recs.groupBy("session_id").agg(F.max("path").alias("source_path"))
    names = blks.where("type = 'tool_use' AND tool_use_id IS NOT NULL").groupBy("session_id", "seq", "tool_use_id").agg(F.max_by("tool_name", "ordinal").alias("name"))
    linked = linkage_issues(blks).join(names, ["session_id", "seq", "tool_use_id"], "left").join(paths, "session_id")
    what = (
        F.when(V("code") == "duplicate_tool_use_id", F.concat(F.lit('tool_use id "'), V("tool_use_id"), F.lit('" appears more than once ('), F.coalesce("name", F.lit("unknown tool")), F.lit(")")))
        .when(V("code") == "orphan_tool_result", F.concat(F.lit('tool_result references tool_use id "'), V("tool_use_id"), F.lit('" absent from the session')))
        .otherwise(F.concat(F.lit('tool_use id "'), V("tool_use_id"), F.lit('" received more than one result')))
    )
    linked = linked.select("source_path", "session_id", line(None).alias("line_no"), "code", what.alias("error"), none.alias("raw_line"))
    return bad.unionByName(odd).unionByName(linked)


# Side files.


def sidecars(spark: SparkSession, *paths: str) -> DataFrame:
    """``(path, meta)``: objects in ``<name>.meta.json`` beside ``<name>.jsonl``; others count as absent."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.meta.json").text(list(paths), wholetext=True)
    at = found.select(F.regexp_replace(local_path(F.col("_metadata.file_path")), r"\.meta\.json$", ".jsonl").alias("path"), F.try_parse_json("value").alias("meta"))
    return at.where(is_object(V("meta"), "$"))


def thread_titles(spark: SparkSession, *index_files: str) -> DataFrame:
    """``(source_session_id, thread_name)`` of the second producer's index, the last line of an
    id wins; lines that say nothing are left out."""
    found = spark.read.option("lineSep", "\n").text(list(index_files))
    at = found.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("r"), F.try_parse_json("value").alias("v"))
    named = at.select("f", "b", "r", text_at(V("v"), "$.id").alias("source_session_id"), text_at(V("v"), "$.thread_name").alias("thread_name")).where("source_session_id IS NOT NULL AND thread_name IS NOT NULL")
    return named.groupBy("source_session_id").agg(F.max_by("thread_name", F.struct("f", "b", "r")).alias("thread_name"))


def parsed(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """The staged records of the transcripts, one file for each session, and ``(path,
    session_id)`` of every file that has a record."""
    # Files may grow while they are read: all numbers come from one reading.
    read = staged(typed(lines(spark, *paths)), "lines")
    recs = staged(records(read), "records")
    unstage(read)
    files = staged(recs.select("path", "session_id").distinct(), "files")
    lost = superseded(recs)
    return (recs if lost.isEmpty() else staged(recs.join(lost, "path", "left_anti"), "records")), files
