"""Sessions as documents: Markdown, JSON, trajectories, and scripts that replay them.

A document is rows ``(session_id, seq, ordinal, text)``, its parts in order, so that no session
is ever one value.  Parts end without their last line end, which the file's lines bring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import commands
from sessionloom.functions.records import text_at
from sessionloom.operators import reads, sessions, trajectory
from sessionloom.schema import Archive

V = F.col
#: Stands before what a session or a message begins with, and behind all of it.
FIRST, LAST = -1, 2_147_483_647
FORMS = ("md", "json", "trajectory")
HEREDOC = "REPLAY_EOF"
_KEEP = {"ignoreNullFields": "false"}
_COLUMNS = ("session_id", "seq", "ordinal", "text")


def _titled(session: DataFrame, message: DataFrame, block: DataFrame) -> DataFrame:
    titles = sessions.display_titles(session, message, block).withColumnRenamed("title", "_title")
    return session.join(titles, "id", "left").withColumn("title", F.coalesce("_title", "source_session_id")).drop("_title")


def cents(nano: Column) -> Column:
    """Dollars with two places, halves up, from whole nano-dollars."""
    n = F.floor((F.coalesce(nano, F.lit(0)) + 5_000_000) / F.lit(10_000_000))
    return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def markdown(session: DataFrame, message: DataFrame, block: DataFrame) -> DataFrame:
    """Sessions as Markdown: a head, then each message with its blocks."""
    s = _titled(session, message, block)
    or_nothing = lambda c: F.coalesce(V(c).cast("string"), F.lit(""))
    facts = [("tool", V("tool")), ("model", or_nothing("model")), ("messages", F.coalesce("message_count", F.lit(0)).cast("string")), ("est. cost", F.concat(F.lit("$"), cents(V("cost_nano")))), ("started", or_nothing("started_at"))]
    head = F.concat(F.lit("# "), V("title"), F.lit("\n\n"), *[x for name, value in facts for x in (F.lit(f"- **{name}:** "), value, F.lit("\n"))])
    heads = s.select(V("id").alias("session_id"), F.lit(FIRST).alias("seq"), F.lit(FIRST).alias("ordinal"), head.alias("text"))
    said = message.select("session_id", "seq", F.lit(FIRST).alias("ordinal"), F.concat(F.lit("## "), F.upper(F.coalesce("role", F.lit("unknown"))), F.lit("\n")).alias("text"))
    fenced = lambda kind, c: F.concat(F.lit(f"```{kind}\n"), or_nothing(c), F.lit("\n```\n"))
    body = (
        F.when(V("type") == "text", F.concat("text", F.lit("\n")))
        .when(V("type") == "thinking", F.concat(F.lit("> _thinking:_ "), "text", F.lit("\n")))
        .when(V("type") == "tool_use", F.concat(F.lit("**→ "), or_nothing("tool_name"), F.lit("**\n\n"), fenced("json", "tool_input")))
        .when(V("type") == "tool_result", fenced("", "tool_result"))
        .otherwise(F.concat(F.lit("_["), "type", F.lit("]_\n")))
    )
    blocks = block.select("session_id", "seq", "ordinal", body.alias("text")).where("text IS NOT NULL")
    return heads.unionByName(said).unionByName(blocks)


_SUMMARY = (
    "id", "tool", "source_session_id", "title", "cwd", "model", "reasoning_effort", "reasoning_effort_levels", "started_at", "ended_at", "message_count", "input_tokens", "output_tokens", "cost_nano", "is_archived",
    "is_subagent", "parent_session_id", "spawn_tool_use_id", "agent_id", "agent_type", "spawn_depth", "context_window_tokens", "peak_context_tokens", "compaction_count",
)


def as_json(session: DataFrame, message: DataFrame, block: DataFrame, tool_call: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Sessions as JSON: what they are, their messages with their blocks, their subagents as a
    tree (of ``every`` session there is) and their totals."""
    s = _titled(session, message, block)
    head = F.concat(F.lit('{"summary":'), F.to_json(F.struct(*_SUMMARY), _KEEP), F.lit(',"messages":['))
    heads = s.select(V("id").alias("session_id"), F.lit(FIRST).alias("seq"), F.lit(FIRST).alias("ordinal"), head.alias("text"))
    ends = tool_call.where("result_seq IS NOT NULL").groupBy("session_id", V("result_seq").alias("seq"), V("result_ordinal").alias("ordinal")).agg(F.first("tool_name").alias("of_tool"))
    own = block.join(ends, ["session_id", "seq", "ordinal"], "left").withColumn("tool_name", F.coalesce("tool_name", "of_tool"))
    fields = F.struct("ordinal", "type", "text", "tool_name", "tool_use_id", "tool_input", "tool_result", "is_error")
    own = own.groupBy("session_id", "seq").agg(F.sort_array(F.collect_list(fields)).alias("blocks"))
    said = message.select("session_id", "seq", F.coalesce("role", F.lit("unknown")).alias("role"), "timestamp", "model", "context_tokens", "output_tokens", "is_sidechain", "is_compact_summary").join(own, ["session_id", "seq"], "left")
    said = said.withColumn("blocks", F.coalesce("blocks", F.array().cast(own.schema["blocks"].dataType)))
    first = message.groupBy("session_id").agg(F.min("seq").alias("_first"))
    line = F.concat(F.when(V("seq") > V("_first"), ",").otherwise(""), F.to_json(F.struct(*[c for c in said.columns if c != "session_id"]), _KEEP))
    said = said.join(first, "session_id").select("session_id", "seq", F.lit(FIRST).alias("ordinal"), line.alias("text"))
    every = session if every is None else every
    below = sessions.trees(every, session.select("id"))
    tail = F.concat(F.lit('],"subagents":'), F.to_json("subagents", _KEEP), F.lit(',"totals":'), F.to_json(F.struct("replies", "tool_calls")), F.lit("}"))
    tails = below.join(sessions.totals(session, message, tool_call), "id").select(V("id").alias("session_id"), F.lit(LAST).alias("seq"), F.lit(FIRST).alias("ordinal"), tail.alias("text"))
    return heads.unionByName(said).unionByName(tails)


def as_trajectories(session: DataFrame, message: DataFrame, block: DataFrame) -> DataFrame:
    """Sessions as one array of records each; those without a user's or an assistant's records
    have none."""
    lines = trajectory.as_json(trajectory.trajectories(session, message, block)[0])
    rows = lines.select("session_id", V("n").cast("int").alias("seq"), F.lit(FIRST).alias("ordinal"), F.concat(F.when(V("n") == 0, "[").otherwise(","), V("line")).alias("text"))
    ends = rows.where("seq = 0").select("session_id", F.lit(LAST).alias("seq"), "ordinal", F.lit("]").alias("text"))
    return rows.unionByName(ends)


def write(parts: DataFrame, path: str) -> None:
    """A folder ``session_id=N`` for each session; its files, in order of their names, are its
    document.  A long session is cut over several files and tasks.  Folders of other sessions
    stay."""
    rows = parts.select(*_COLUMNS).repartitionByRange("session_id", "seq", "ordinal").sortWithinPartitions("session_id", "seq", "ordinal")
    rows.select("session_id", "text").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").text(path)


def export_all(a: Archive, path: str, form: str = "md", include_subagents: bool = False) -> tuple[int, int]:
    """All sessions that are shown, as documents of a form under ``path``; how many were written,
    and how many make no document."""
    if form not in FORMS:
        raise ValueError(f"unknown form: {form}")
    s = reads.sessions_in(a, reads.Scope(include_subagents=include_subagents))
    of = s.select(V("id").alias("session_id"))
    message, block = a.message.join(of, "session_id", "left_semi"), a.block.join(of, "session_id", "left_semi")
    if form == "md":
        parts = markdown(s, message, block)
    elif form == "json":
        parts = as_json(s, message, block, a.tool_call.join(of, "session_id", "left_semi"), reads.sessions_in(a))
    else:
        parts = as_trajectories(s, message, block)
    write(parts, path)
    n = s.count()
    written = parts.where(V("seq") == (0 if form == "trajectory" else FIRST)).where(V("ordinal") == FIRST).count()
    return written, n - written


# Replay: what a session did to files and in its shell, as a script to read and then run.

_CONTROL = "[\\p{Cc}  ]"


def in_comment(text: Column) -> Column:
    """A text that can't end the comment it stands in: control characters as their codes."""
    code = lambda c: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0"))
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.regexp_like(c, F.lit(_CONTROL)), code(c)).otherwise(c)), "")
    return F.when(F.regexp_like(text, F.lit(_CONTROL)), spelled).otherwise(text)


def quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def _one_line(text: Column, most: int = 60) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x{FEFF}]+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def _in_project(path: Column, cwd: Column) -> Column:
    root = F.concat(F.regexp_replace(cwd, "/+$", ""), F.lit("/"))
    return F.when(F.coalesce(path.startswith(root), F.lit(False)), F.substr(path, F.length(root) + 1)).otherwise(path)


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is computed once however often it is used."""
    return rows.select(*[c for c in rows.columns if c != name], F.explode(F.array(value)).alias(name))


def replay_ops(session: DataFrame, tool_call: DataFrame) -> DataFrame:
    """``(session_id, seq, ordinal, kind, target, payload, phase, is_error, redacted)``: commands,
    writes, edits and patches of sessions.  Secrets are taken out of commands and contents."""
    rows = tool_call.where("tool_name IS NOT NULL").join(session.select(V("id").alias("session_id"), "cwd"), "session_id")
    rows = rows.withColumn("command", commands.decoded("tool_name", "input"))
    # Rows' own columns, by a generator each, or the inputs are parsed again for each use.
    rows = _once(rows, "v", F.try_parse_json("input"))
    rows = _once(rows, "given", F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string")))
    rows = _once(rows, "v", F.when(V("given").isNotNull(), F.try_parse_json("given")).otherwise(V("v")))
    name, path, secret = V("tool_name"), text_at(V("v"), "$.file_path"), commands.redacted
    book = text_at(V("v"), "$.notebook_path", "$.file_path")
    change = F.concat(F.lit("replace `"), _one_line(text_at(V("v"), "$.old_string")), F.lit("` -> `"), _one_line(text_at(V("v"), "$.new_string")), F.lit("`"))
    op = lambda kind, target, raw: F.struct(F.lit(kind).alias("kind"), target.alias("target"), secret(raw).alias("payload"), raw.alias("raw"))
    found = (
        F.when(V("command").isNotNull(), op("command", commands.normal_form(secret(V("command")), V("cwd")), V("command")))
        .when((name == "apply_patch") & V("given").isNotNull(), op("patch", F.lit("apply_patch"), V("given")))
        .when((name == "Write") & path.isNotNull(), op("file_write", _in_project(path, V("cwd")), F.coalesce(text_at(V("v"), "$.content"), F.lit(""))))
        .when((name == "Edit") & path.isNotNull(), op("file_edit", _in_project(path, V("cwd")), change))
        .when((name == "NotebookEdit") & book.isNotNull(), op("file_edit", _in_project(book, V("cwd")), F.lit("notebook cell edit")))
    )
    rows = _once(rows, "op", found).where("op IS NOT NULL")
    phase = F.when(V("op.kind") == "command", commands.phase(V("op.target"))).otherwise("other")
    return rows.select("session_id", "seq", "ordinal", "op.kind", "op.target", "op.payload", phase.alias("phase"), F.coalesce("is_error", F.lit(False)).alias("is_error"), (V("op.payload") != V("op.raw")).alias("redacted"))


def _script_lines(include_errors: bool) -> Column:
    """An operation as lines of a shell script; null for one that is left out."""
    target, body = V("target"), F.regexp_replace("payload", "\n+$", "")
    note = in_comment(target)
    danger = commands.destructive(target)
    failed = F.concat(F.lit("# (errored in original run)\n# "), note) if include_errors else F.lit(None).cast("string")
    command = F.when(V("is_error"), failed).when(danger.isNotNull(), F.concat(F.lit("# REVIEW: destructive ("), danger, F.lit(")\n# "), note)).otherwise(target)
    unsafe = body.contains(HEREDOC) | target.contains("\n") | target.contains(HEREDOC)
    heredoc = F.concat(F.lit(f" <<'{HEREDOC}'\n"), body, F.lit(f"\n{HEREDOC}"))
    # The path as a JSON string.
    spelled = F.regexp_extract(F.to_json(F.array(target)), r"(?s)^\[(.*)\]$", 1)
    wrote = F.when(unsafe, F.concat(F.lit("# SKIPPED write to "), in_comment(spelled), F.lit(": content or path unsafe for a heredoc, recreate it by hand")))
    wrote = wrote.otherwise(F.concat(F.lit('mkdir -p "$(dirname '), quoted(target), F.lit(')"\ncat > '), quoted(target), heredoc))
    patch = F.when(body.contains(HEREDOC), "# SKIPPED patch: contains the heredoc's delimiter, apply it by hand").otherwise(F.concat(F.lit("git apply"), heredoc))
    edit = F.concat(F.lit("# EDIT "), note, F.lit(": "), in_comment(V("payload")), F.lit(" (apply by hand)"))
    return F.when(V("kind") == "command", command).when(V("kind") == "file_write", wrote).when(V("kind") == "patch", patch).otherwise(edit)


def replay(session: DataFrame, tool_call: DataFrame, include_errors: bool = False) -> DataFrame:
    """Sessions as shell scripts, in the parts of a document.  Commands that failed are left out
    or comments, dangerous ones and edits are comments, writes and patches are heredocs with
    a quoted delimiter, so nothing in them is expanded."""
    head = F.concat(
        F.lit("#!/usr/bin/env bash\n# Replay of "), in_comment(V("tool")), F.lit(" session "), V("id").cast("string"), F.lit(": "), in_comment(F.coalesce("title", F.lit("(untitled)"))),
        F.lit('\n# Review before running.  Assumes the same files at the start; secrets are taken out as far as known.\nset -euo pipefail\nPROJECT_ROOT="${PROJECT_ROOT:-$(git rev-parse --show-toplevel)}"\ncd "$PROJECT_ROOT"\n'),
    )
    heads = session.select(V("id").alias("session_id"), F.lit(FIRST).alias("seq"), F.lit(FIRST).alias("ordinal"), head.alias("text"))
    lines = replay_ops(session, tool_call).select("session_id", "seq", "ordinal", _script_lines(include_errors).alias("text")).where("text IS NOT NULL")
    return heads.unionByName(lines)
