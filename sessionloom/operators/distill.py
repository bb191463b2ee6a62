"""Commands of sessions distilled into lines of a script."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.functions import commands
from sessionloom.schema import PHASES


def command_ops(tool_call: DataFrame, session: DataFrame) -> DataFrame:
    """Shell calls as ``(session_id, ordinal, normalized, phase, is_error, redacted)``."""
    rows = tool_call.join(session.select(F.col("id").alias("session_id"), "cwd"), "session_id")
    rows = rows.withColumn("command", commands.decoded("tool_name", "input")).where("command IS NOT NULL")
    raw = commands.redacted(F.col("command"))
    rows = rows.withColumn("raw", raw).withColumn("redacted", F.col("raw") != F.col("command"))
    rows = rows.withColumn("normalized", commands.normal_form(F.col("raw"), F.col("cwd")))
    order = W.partitionBy("session_id").orderBy("seq", "ordinal")
    return rows.select("session_id", (F.row_number().over(order) - 1).cast("long").alias("ordinal"), "normalized", commands.phase(F.col("normalized")).alias("phase"), F.coalesce("is_error", F.lit(False)).alias("is_error"), "redacted")


def _per_command(ops: DataFrame) -> DataFrame:
    out = ops.groupBy("normalized").agg(F.countDistinct("session_id").alias("sessions_seen"), F.count("*").alias("n"), F.count_if("is_error").alias("failed"), F.min("phase").alias("phase"))
    return out.select("normalized", "phase", "sessions_seen", F.round(1 - F.col("failed") / F.col("n"), 6).alias("success_rate"))


def timeline(ops: DataFrame) -> DataFrame:
    """Each command with the sessions that ran it and its rate of success."""
    return ops.join(_per_command(ops).drop("phase"), "normalized").select("session_id", "ordinal", "normalized", "phase", "is_error", "sessions_seen", "success_rate")


def select_lines(ops: DataFrame, least_share: float = 0.25) -> DataFrame:
    """Commands of two sessions or more and of ``least_share`` of them that ever succeeded, by
    phase, sessions, success and text."""
    n = ops.select("session_id").distinct().agg(F.count("*").alias("_all"))
    place = F.array_position(F.array(*[F.lit(p) for p in PHASES]), F.col("phase"))
    rows = _per_command(ops).crossJoin(F.broadcast(n)).where((F.col("sessions_seen") >= 2) & (F.col("sessions_seen") / F.col("_all") >= least_share) & (F.col("success_rate") > 0))
    return rows.withColumn("place", place).orderBy("place", F.col("sessions_seen").desc(), F.col("success_rate").desc(), "normalized").select(F.col("normalized").alias("command"), "phase", "sessions_seen", "success_rate", "place")


def exemplar(ops: DataFrame) -> DataFrame:
    """A session's commands in order, without immediate repeats."""
    before = F.lag("normalized").over(W.partitionBy("session_id").orderBy("ordinal"))
    return ops.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("normalized"))).select("session_id", "ordinal", F.col("normalized").alias("command"), "phase")


def render_script(lines: list[tuple[str, str]], kind: str = "sh") -> str:
    """``(phase, command)`` lines as a shell script, justfile or makefile.  Dangerous commands
    stand as comments."""
    phases: dict[str, list[str]] = {}
    for phase, command in lines:
        safe = command.replace("\n", " ")
        danger = next((name for part, name in commands._DESTRUCTIVE if part in safe.lower()), None)
        phases.setdefault(phase, []).append(f"# skipped ({danger}): {safe}" if danger else safe)
    if kind == "sh":
        body = ["#!/usr/bin/env bash", "set -euo pipefail"]
        for phase, rows in phases.items():
            body += ["", f"# {phase}", *rows]
        return "\n".join(body) + "\n"
    indent, escape = ("    ", lambda x: x) if kind == "just" else ("\t", lambda x: x.replace("$", "$$"))
    blocks = [f"{phase}:\n" + "\n".join(indent + escape(r) for r in rows) for phase, rows in phases.items()]
    head = "" if kind == "just" else f".PHONY: {' '.join(phases)}\n\n"
    return head + "\n\n".join(blocks) + "\n"
