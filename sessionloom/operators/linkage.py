"""Tool uses, their results, and what is wrong between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def linkage_issues(blocks: DataFrame) -> DataFrame:
    """``blocks(session_id, seq, ordinal, type, tool_use_id)`` -> ``(session_id, code,
    tool_use_id, seq)``: repeated uses, repeated results, results without a use."""
    nth = F.row_number().over(W.partitionBy("session_id", "type", "tool_use_id").orderBy("seq", "ordinal"))
    rows = blocks.where("type IN ('tool_use', 'tool_result') AND tool_use_id IS NOT NULL").withColumn("nth", nth)
    again = rows.where("nth > 1").select("session_id", F.when(F.col("type") == "tool_use", "duplicate_tool_use_id").otherwise("duplicate_tool_result").alias("code"), "tool_use_id", "seq")
    uses = rows.where("type = 'tool_use'").select("session_id", "tool_use_id")
    orphans = rows.where("type = 'tool_result'").join(uses, ["session_id", "tool_use_id"], "left_anti").select("session_id", F.lit("orphan_tool_result").alias("code"), "tool_use_id", "seq")
    return again.unionByName(orphans)


def tool_calls(blocks: DataFrame, messages: DataFrame) -> DataFrame:
    """A call for each tool use, joined to the last result of its id in the session."""
    at = messages.select("session_id", "seq", "timestamp")
    uses = blocks.where("type = 'tool_use'").join(at, ["session_id", "seq"], "left")
    results = blocks.where("type = 'tool_result' AND tool_use_id IS NOT NULL").join(at.withColumnRenamed("timestamp", "ended"), ["session_id", "seq"], "left")
    last = results.groupBy("session_id", "tool_use_id").agg(F.max_by(F.struct("tool_result", "is_error", "ended"), F.struct("seq", "ordinal")).alias("r"))
    joined = uses.drop("is_error", "tool_result").join(last, ["session_id", "tool_use_id"], "left")
    ms = F.unix_millis(F.try_to_timestamp("r.ended")) - F.unix_millis(F.try_to_timestamp("timestamp"))
    mcp = F.col("tool_name").startswith("mcp__")
    server = F.regexp_extract("tool_name", "^mcp__(.*?)__(.*)$", 1)
    is_mcp = F.coalesce(mcp & (server != ""), F.lit(False))
    return joined.select(
        "session_id", "seq", "ordinal", "tool_use_id", "tool_name", F.when(is_mcp, "mcp").otherwise("builtin").alias("tool_kind"), F.when(is_mcp, server).alias("mcp_server"),
        F.when(is_mcp, F.regexp_extract("tool_name", "^mcp__(.*?)__(.*)$", 2)).alias("mcp_tool"), F.col("tool_input").alias("input"), F.col("r.tool_result").alias("output"), F.col("r.is_error").alias("is_error"),
        F.col("r").isNotNull().alias("has_result"), "timestamp", F.when(ms >= 0, ms).alias("duration_ms"), F.octet_length("tool_input").cast("long").alias("input_bytes"), F.octet_length("r.tool_result").cast("long").alias("output_bytes"),
    )
