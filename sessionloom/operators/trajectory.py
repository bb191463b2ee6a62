"""Sessions as trajectories: one record for each block that a reader of conversations needs.

A trajectory has a meta record, then records of users, assistants, reasoning, tool calls
and tool results in the order of the session.  Calls have ids of their own within the
session, results name the call that they answer, every record has a time.  What is left
out is counted.

All of it is windows and joins over blocks: the n-th result with an id answers the n-th
call with that id, so both are numbered and joined; a missing time is the last one before
it.  Only where an id looks like the new name of another one must names be probed in
order; such families of ids, and no others, are walked in Python.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.staging import ship, staged

# Fixed values of the format.
SOURCES = {"claude_code": "claude-code", "codex": "codex"}
NOISE = ("<local-command-caveat>", "<command-name>", "<command-message>", "<local-command-stdout>", "<local-command-stderr>", "<task-notification")
WIRE_ROLES = ("user", "assistant", "tool")
ARGS_MOST, RESULT_MOST = 20_000, 2_500
MARKER = ("\n… [truncated, ", " more chars]")
FIRST_SYNTHETIC, STEP_SECONDS = "2026-01-01T00:00:00.000Z", 15
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
V = F.col
COUNTERS = (
    "noise_user_records_dropped", "orphan_tool_results_dropped", "duplicate_tool_results_dropped", "tool_call_ids_synthesized", "tool_call_ids_renamed", "tool_args_wrapped",
    "tool_results_truncated", "timestamps_filled",
)


def kept_length(length: int, most: int) -> int:
    """Characters that stay beside the marker, whose number has digits of its own; negative
    if the marker doesn't fit."""
    room = most - sum(map(len, MARKER))
    return next((room - d for d in range(1, 20) if len(str(length - (room - d))) <= d), -1)


def truncated(text: str, most: int) -> str:
    """The beginning and the end of a longer text, ``most`` characters with the marker."""
    if len(text) <= most:
        return text
    keep, marker = kept_length(len(text), most), None
    if keep < 0:
        marker = "…"[:most]
        keep = most - len(marker)
    else:
        marker = f"{len(text) - keep}".join(MARKER)
    tail = keep // 2
    return text[: keep - tail] + marker + (text[-tail:] if tail else "")


def truncated_column(text: Column, most: int) -> Column:
    """``truncated`` as an expression."""
    n, room = F.length(text), most - sum(map(len, MARKER))
    keep = F.coalesce(*[F.when(F.length((n - (room - d)).cast("string")) <= d, F.lit(room - d)) for d in range(1, 11)])
    tail = F.floor(keep / 2).cast("int")
    cut = F.concat(F.substring(text, F.lit(1), keep - tail), F.lit(MARKER[0]), (n - keep).cast("string"), F.lit(MARKER[1]), F.substring(text, n - tail + 1, tail))
    return F.when(n <= most, text).otherwise(cut)


# Arguments of calls.


def _number(digits: str):
    x = float(digits)
    return int(x) if x.is_integer() and abs(x) < 1e21 else x


def _none(word: str):
    raise ValueError(word)


def _compact(value) -> str:
    out = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", out)


def _strings(value):
    """``(container, key)`` of every string within."""
    pairs = enumerate(value) if isinstance(value, list) else value.items() if isinstance(value, dict) else ()
    for key, child in pairs:
        if isinstance(child, str):
            yield value, key
        else:
            yield from _strings(child)


def _fitted(value: dict, most: int) -> str | None:
    """The object with its longest strings cut until it fits; None if strings aren't why it
    doesn't."""
    leaves = [(box, key, box[key]) for box, key in _strings(value)]
    out = _compact(value)
    while len(out) > most:
        box, key, whole = max(leaves, key=lambda x: len(x[0][x[1]]), default=(None, None, ""))
        size = len(box[key]) if box is not None else 0
        if size <= sum(map(len, MARKER)) + 1:
            return None
        # As much as is too much, but half at most; half where escapes ate up the gain.
        for target in sorted({max(size // 2, size - (len(out) - most) - 1), size // 2}, reverse=True):
            box[key] = truncated(whole, target)
            shorter = _compact(value)
            if len(shorter) < len(out):
                break
        else:
            return None
        out = shorter
    return out


def arguments(given: str | None, most: int = ARGS_MOST) -> tuple[str, bool]:
    """A call's input as the text of a JSON object, and whether it had to be changed."""
    try:
        value = {} if given is None else json.loads(given, parse_float=_number, parse_constant=_none)
    except (ValueError, RecursionError):
        value = None
    whole = _compact(value) if isinstance(value, dict) else None
    if whole is not None and len(whole) <= most:
        return whole, False
    fitted = _fitted(value, most) if whole is not None else None
    if fitted is not None:
        return fitted, True
    raw, room = whole if whole is not None else given, most - 12
    while True:
        out = _compact({"_raw": truncated(raw, max(2, room))})
        room //= 2
        if len(out) <= most or room <= 2:
            return out, True


def _arguments(given: Column) -> Column:
    @F.pandas_udf("args string, wrapped boolean")
    def shaped(given):
        import pandas as pd

        return pd.DataFrame([arguments(x) for x in given], columns=["args", "wrapped"])

    return shaped(given)


# Ids of calls.

_SUFFIX = r"(__dup\d+)+$"


def _named(calls: DataFrame) -> DataFrame:
    """``calls(session_id, at, original)`` with ``nth`` (the how-manieth with its original id)
    and ``id``, unique within the session: the original, or the original with the first
    number from 2 that is free."""
    own = W.partitionBy("session_id", "original").orderBy("at")
    calls = calls.withColumn("nth", F.row_number().over(own)).withColumn("family", F.regexp_replace("original", _SUFFIX, ""))
    mixed = F.count(F.when(V("original") != V("family"), 1)).over(W.partitionBy("session_id", "family")) > 0
    calls = calls.withColumn("mixed", mixed)
    plain = calls.where("NOT mixed").withColumn("id", F.when(V("nth") == 1, V("original")).otherwise(F.concat("original", F.lit("__dup"), V("nth").cast("string"))))

    def probe(rows):
        rows = rows.sort_values("at", key=lambda s: s.map(lambda a: (a["seq"], a["ordinal"]) if isinstance(a, dict) else tuple(a)))
        used, ids = set(), []
        for original in rows["original"]:
            n, name = 1, original
            while name in used:
                n += 1
                name = f"{original}__dup{n}"
            used.add(name)
            ids.append(name)
        return rows.assign(id=ids)

    columns = "session_id long, at struct<seq:int,ordinal:int>, original string, nth int, family string, mixed boolean, id string"
    names = ["session_id", "at", "original", "nth", "family", "mixed"]
    probed = calls.where("mixed").select(*names).groupBy("session_id", "family").applyInPandas(probe, columns)
    return plain.select(*names, "id").unionByName(probed).select("session_id", "at", "original", "nth", "id")


def iso(raw: Column) -> Column:
    """A time in UTC with milliseconds; null of what is no time.  Times without a zone are
    UTC; a zone of two digits alone is none."""
    zoned = F.regexp_like(raw, F.lit(r"(Z|[+-]\d{2}:?\d{2})$"))
    bare = F.regexp_like(raw, F.lit(r":.*[+-]\d{2}$"))
    is_date = F.regexp_like(raw, F.lit(r"^\d{4}-\d{2}-\d{2}$"))
    at = F.try_to_timestamp(F.when(zoned | is_date, raw).otherwise(F.concat(raw, F.lit("Z"))))
    return F.when(~bare, F.date_format(F.to_utc_timestamp(at, F.current_timezone()), ISO))


def trajectories(session: DataFrame, message: DataFrame, block: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(records, reports)`` of the sessions.

    Records: ``(session_id, n, role, content, tool_calls, tool_call_id, timestamp, source,
    cwd, git_branch, model)``, ``n`` from 0, the meta record.  Reports: a row for each
    session with the counters, ``dropped_blocks`` by kind, ``is_ok`` and, where a session has
    no record of a user or of an assistant and so no records at all, the ``reason``.
    Sessions without messages have a report; blocks without a message are left out."""
    ship(session.sparkSession)
    said = message.select("session_id", "seq", "role", V("timestamp").alias("said_at"))
    blocks = block.join(said, ["session_id", "seq"]).withColumn("at", F.struct("seq", "ordinal"))
    blocks = staged(blocks.drop("id", "is_error"), "trajectory-blocks")
    wire = blocks.where(V("role").isin(*WIRE_ROLES))
    order = W.partitionBy("session_id").orderBy("at")

    calls = wire.where("type = 'tool_use'").withColumn("call", F.row_number().over(order))
    synthetic = F.concat_ws("-", F.lit("call"), V("session_id").cast("string"), V("call").cast("string"))
    calls = calls.withColumn("original", F.coalesce("tool_use_id", synthetic))
    named = staged(_named(calls.select("session_id", "at", "original")), "calls")
    shape = _arguments(V("tool_input"))
    calls = calls.join(named.select("session_id", "at", "id"), ["session_id", "at"]).withColumn("a", shape)
    name = F.when(F.coalesce("tool_name", F.lit("")) == "", "unknown_tool").otherwise(V("tool_name"))
    text, nothing = F.coalesce("text", F.lit("")), F.lit(None).cast("string")
    no_calls = F.lit(None).cast("array<struct<id:string,name:string,args:string>>")
    flag = lambda **on: [F.coalesce(on.get(c, F.lit(False)), F.lit(False)).alias(c) for c in COUNTERS[:-1]]
    key = ["session_id", "at", "said_at"]
    of_calls = calls.select(
        *key, F.lit("assistant").alias("role"), nothing.alias("content"), F.array(F.struct("id", name.alias("name"), V("a.args").alias("args"))).alias("tool_calls"), nothing.alias("tool_call_id"), nothing.alias("dropped"),
        F.lit(True).alias("is_out"), *flag(tool_call_ids_synthesized=V("tool_use_id").isNull(), tool_call_ids_renamed=V("id") != V("original"), tool_args_wrapped=V("a.wrapped")),
    )

    # The n-th result of an id answers the n-th call; more results than calls are duplicates.
    results = wire.where("type = 'tool_result'").withColumn("original", V("tool_use_id"))
    results = results.withColumn("nth", F.row_number().over(W.partitionBy("session_id", "original").orderBy("at")))
    known = named.select("session_id", "original").distinct().withColumn("known", F.lit(True))
    results = results.join(known, ["session_id", "original"], "left").join(named.select("session_id", "original", "nth", "id"), ["session_id", "original", "nth"], "left")
    of_results = results.select(
        *key, F.lit("tool").alias("role"), truncated_column(F.coalesce("tool_result", F.lit("")), RESULT_MOST).alias("content"), no_calls.alias("tool_calls"), V("id").alias("tool_call_id"), nothing.alias("dropped"),
        V("id").isNotNull().alias("is_out"),
        *flag(orphan_tool_results_dropped=V("known").isNull(), duplicate_tool_results_dropped=V("known") & V("id").isNull(), tool_results_truncated=V("id").isNotNull() & (F.length("tool_result") > RESULT_MOST)),
    )

    has_text = F.regexp_like(text, F.lit(r"(?U)[^\s﻿]"))
    started = F.regexp_replace(text, r"^(?U)[\s﻿]+", "")
    noise = F.lit(False)
    for x in NOISE:
        noise = noise | started.startswith(x)
    is_text, is_thought = (V("type") == "text") & has_text, (V("type") == "thinking") & has_text
    is_noise = is_text & (V("role") == "user") & noise
    is_out = is_thought | (is_text & V("role").isin("user", "assistant") & ~is_noise)
    dropped = F.when(is_text & (V("role") == "tool"), "tool_text").when(~is_out & ~is_noise, V("type"))
    rest = wire.where("type NOT IN ('tool_use', 'tool_result')")
    of_rest = rest.select(
        *key, F.when(V("type") == "thinking", "reasoning").otherwise(V("role")).alias("role"), V("text").alias("content"), no_calls.alias("tool_calls"), nothing.alias("tool_call_id"), dropped.alias("dropped"), is_out.alias("is_out"),
        *flag(noise_user_records_dropped=is_noise),
    )
    # Messages of other roles go whole, each counts once.
    others = blocks.where(~V("role").isin(*WIRE_ROLES)).groupBy("session_id", "seq", "role").agg(F.first("said_at").alias("said_at"))
    of_others = others.select("session_id", F.struct("seq", F.lit(0).alias("ordinal")).alias("at"), "said_at", "role", nothing.alias("content"), no_calls.alias("tool_calls"), nothing.alias("tool_call_id"), F.concat("role", F.lit("_message")).alias("dropped"), F.lit(False).alias("is_out"), *flag())
    fates = staged(of_calls.unionByName(of_results).unionByName(of_rest).unionByName(of_others), "fates")

    out = fates.where("is_out").join(session.select(V("id").alias("session_id"), iso(V("started_at")).alias("began")), "session_id")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    own = iso(V("said_at"))
    out = out.withColumn("own", own).withColumn("last", F.last("own", ignorenulls=True).over(so_far)).withColumn("n", F.row_number().over(order))
    ladder = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit(FIRST_SYNTHETIC))) + V("n") * STEP_SECONDS), F.current_timezone()), ISO)
    out = staged(out.withColumn("timestamp", F.coalesce("own", "last", "began", ladder)), "records")

    sums = fates.groupBy("session_id").agg(*[F.sum(V(c).cast("long")).alias(c) for c in COUNTERS[:-1]])
    kinds = fates.where("dropped IS NOT NULL").groupBy("session_id", "dropped").agg(F.count("*").alias("c")).groupBy("session_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dropped", "c")))).alias("dropped_blocks"))
    made = out.groupBy("session_id").agg(F.sum(V("own").isNull().cast("long")).alias("timestamps_filled"), F.count_if(V("role") == "user").alias("users"), F.count_if(V("role") == "assistant").alias("assistants"))
    reports = session.select(V("id").alias("session_id")).join(sums, "session_id", "left").join(made, "session_id", "left").join(kinds, "session_id", "left").fillna(0, [*COUNTERS, "users", "assistants"])
    reason = F.when(V("users") == 0, "missing_user_records").when(V("assistants") == 0, "missing_assistant_records")
    reports = reports.withColumn("reason", reason).withColumn("is_ok", V("reason").isNull())
    reports = staged(reports.select("session_id", "is_ok", "reason", *COUNTERS, F.coalesce("dropped_blocks", F.create_map().cast("map<string,bigint>")).alias("dropped_blocks")), "reports")

    fine = reports.where("is_ok").select("session_id")
    source = F.coalesce(F.create_map(*[F.lit(x) for pair in SOURCES.items() for x in pair])[V("tool")], V("tool"))
    meta = session.withColumnRenamed("id", "session_id").join(fine, "session_id", "left_semi")
    filled = lambda c: F.when(V(c) != "", V(c)).alias(c)
    meta = meta.select("session_id", F.lit(0).alias("n"), F.lit("meta").alias("role"), source.alias("source"), filled("cwd"), filled("git_branch"), filled("model"))
    records = out.join(fine, "session_id", "left_semi").select("session_id", "n", "role", "content", "tool_calls", "tool_call_id", "timestamp")
    return records.unionByName(meta, allowMissingColumns=True), reports


def as_json(records: DataFrame) -> DataFrame:
    """``(session_id, n, line)``: each record as a line of JSON, with the fields that its role
    has."""
    keep = {"ignoreNullFields": "false"}
    call = F.to_json(F.struct("role", "content", "tool_calls", "timestamp"), keep)
    tool = F.to_json(F.struct("role", "tool_call_id", "content", "timestamp"), keep)
    meta = F.to_json(F.struct("role", "source", "cwd", "git_branch", "model"))
    said = F.to_json(F.struct("role", "content", "timestamp"), keep)
    line = F.when(V("role") == "meta", meta).when(V("tool_calls").isNotNull(), call).when(V("role") == "tool", tool).otherwise(said)
    return records.select("session_id", "n", line.alias("line"))


def export(records: DataFrame, path: str) -> None:
    """Lines of JSON, each session's in order in one file; a file may hold several sessions."""
    lines = as_json(records).repartition("session_id").sortWithinPartitions("session_id", "n")
    lines.select("line").write.mode("overwrite").text(path)
