"""Canonical tables and closed vocabularies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA_VERSION = 23

# Vocabularies of the archive.
TOOLS = ("claude_code", "codex")
ROLES = ("user", "assistant", "system", "tool", "other")
BLOCK_TYPES = ("text", "thinking", "tool_use", "tool_result", "web_search", "image", "other")
OPERATIONS = ("read", "edit", "write", "delete")
BUCKETS = ("context", "planning", "code", "communicating")
PHASES = ("setup", "build", "test", "lint", "run", "deploy", "vcs", "other")

PROJECT = "id long, path string, name string, first_seen_at string, last_seen_at string, is_worktree boolean, root_path string, worktree_label string, worktree_tool string, root_source string"
SESSION = (
    "id long, tool string, source_session_id string, project_id long, source_path string, is_archived boolean, is_subagent boolean, parent_session_id long, root_source_session_id string, "
    "agent_id string, agent_type string, spawn_tool_use_id string, spawn_depth int, title string, cwd string, git_branch string, version string, model string, reasoning_effort string, "
    "reasoning_effort_levels array<string>, started_at string, ended_at string, message_count long, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, "
    "cache_creation_1h_tokens long, reasoning_tokens long, reasoning_estimate long, reasoning_source string, context_window_tokens long, peak_context_tokens long, cost_in_nano long, "
    "cost_out_nano long, cost_nano long, turn_count long, error_count long, interruption_count long, compaction_count long, sidechain_count long, agent_spawn_count long, skill_count long, "
    "command_count long, thinking_count long, thinking_bytes long, active_seconds long, outcome string, work_type string, raw_meta string"
)
MESSAGE = (
    "id long, session_id long, seq int, role string, model string, stop_reason string, timestamp string, request_id string, source_uuid string, parent_source_uuid string, "
    "input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, context_tokens long, is_sidechain boolean, is_compact_summary boolean, is_boundary boolean, "
    "is_turn boolean, subtype string, raw_type string, payload_role string, compact_trigger string, pre_tokens long"
)
BLOCK = "id long, session_id long, seq int, ordinal int, type string, text string, tool_name string, tool_use_id string, tool_input string, tool_result string, is_error boolean"
TOOL_CALL = (
    "id long, session_id long, seq int, ordinal int, tool_use_id string, tool_name string, tool_kind string, mcp_server string, mcp_tool string, input string, output_preview string, "
    "is_error boolean, has_result boolean, result_seq int, result_ordinal int, timestamp string, duration_ms long, input_bytes long, output_bytes long"
)
FILE_REF = "id long, session_id long, seq int, ordinal int, nth int, path string, rel_path string, ext string, operation string, timestamp string"
ISSUE = "source_path string, session_id long, line_no int, code string, error string, raw_line string"
USER_STATE = "tool string, source_session_id string, state string"
SOURCE = "path string, tool string, size long, mtime long, revision int, session_id long, status string"
TABLES = {"project": PROJECT, "session": SESSION, "message": MESSAGE, "block": BLOCK, "tool_call": TOOL_CALL, "file_ref": FILE_REF, "issue": ISSUE, "user_state": USER_STATE}


@dataclass
class Archive:
    """The canonical tables; pure functions of the transcripts, except user_state."""

    project: DataFrame
    session: DataFrame
    message: DataFrame
    block: DataFrame
    tool_call: DataFrame
    file_ref: DataFrame
    issue: DataFrame
    user_state: DataFrame


def shaped(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, in its order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(schema)])


def drift(df: DataFrame, expected: str) -> list[str]:
    """Differences between a table and its schema, one line for each column."""
    want = {f.name: f.dataType for f in StructType.fromDDL(expected)}
    have = {f.name: f.dataType for f in df.schema}
    out = [f"missing column {c}" for c in want if c not in have] + [f"unknown column {c}" for c in have if c not in want]
    return out + [f"{c} is {have[c].simpleString()}, not {t.simpleString()}" for c, t in want.items() if c in have and have[c] != t]
