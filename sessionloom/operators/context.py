"""Context window of sessions: points, compaction segments, peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _order():
    return W.partitionBy("session_id").orderBy("seq")


def _so_far():
    return _order().rowsBetween(W.unboundedPreceding, 0)


def context_points(messages: DataFrame) -> DataFrame:
    """``messages(session_id, seq, role, is_turn, context_tokens)`` -> a point for each
    assistant message with usage: its turn is the count of user turns so far, 1 at least."""
    turn = F.greatest(F.sum(F.col("is_turn").cast("int")).over(_so_far()), F.lit(1))
    return messages.withColumn("turn", turn).where("role = 'assistant' AND context_tokens > 0").select("session_id", "seq", "turn", "context_tokens")


def compaction_segments(messages: DataFrame) -> DataFrame:
    """``messages(.., is_boundary, pre_tokens)`` -> a row for each boundary with the context
    before (its own figure, or the last point since the boundary before) and after (the
    first point before the next boundary)."""
    point = F.when((F.col("role") == "assistant") & (F.col("context_tokens") > 0), F.col("context_tokens"))
    rows = messages.withColumn("point", point).withColumn("segment", F.sum(F.col("is_boundary").cast("int")).over(_so_far()))
    # A boundary opens its segment: the points of a segment come after its boundary.
    ends = rows.groupBy("session_id", "segment").agg(F.min_by("point", F.when(F.col("point").isNotNull(), F.col("seq"))).alias("first_point"), F.max_by("point", F.when(F.col("point").isNotNull(), F.col("seq"))).alias("last_point"))
    bounds = rows.where("is_boundary").select("session_id", "segment", "seq", "pre_tokens")
    before = ends.select("session_id", (F.col("segment") + 1).alias("segment"), F.col("last_point").alias("before"))
    after = ends.select("session_id", "segment", F.col("first_point").alias("post_tokens"))
    out = bounds.join(before, ["session_id", "segment"], "left").join(after, ["session_id", "segment"], "left")
    return out.select("session_id", "seq", F.coalesce("pre_tokens", "before").alias("pre_tokens"), "post_tokens")


# Models of the first producer whose window is a million tokens.
WIDE_MODELS = (r"(?:^|-)opus-(?:5|4-(?:6|7|8))(?:-|$)", r"(?:^|-)sonnet-(?:5|4-6)(?:-|$)", r"(?:^|-)fable-5(?:-|$)", r"(?:^|-)mythos-(?:5|preview)(?:-|$)")
NARROW, WIDE = 200_000, 1_000_000


def infer_window(tool, model, seen):
    """200 000 or a million tokens, by the model's name or what was seen in it; for the first
    producer only, and only if anything was seen."""
    name = F.regexp_replace(F.lower(model), r"[._/:]", "-")
    wide = seen > NARROW
    for pattern in WIDE_MODELS:
        wide |= F.coalesce(name.rlike(pattern), F.lit(False))
    return F.when((tool == "claude_code") & (seen > 0), F.when(wide, WIDE).otherwise(NARROW))


def peaks(points: DataFrame, session: DataFrame) -> DataFrame:
    """Per session with points: peak, window (given or inferred), and the share of it."""
    p = points.groupBy("session_id").agg(F.max("context_tokens").alias("peak_tokens"), F.max("turn").alias("turns"), F.count("*").alias("points"))
    s = session.select(F.col("id").alias("session_id"), "tool", "model", "context_window_tokens")
    out = p.join(s, "session_id")
    out = out.withColumn("window_tokens", F.coalesce("context_window_tokens", infer_window(F.col("tool"), F.col("model"), F.col("peak_tokens"))))
    return out.select("session_id", "points", "turns", "peak_tokens", "window_tokens", F.round(F.try_divide(F.col("peak_tokens"), F.col("window_tokens")), 6).alias("peak_pct"))


def context_tokens(*parts):
    """Input, cache reads and cache writes together; null if none is known or nothing is there."""
    total = sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0)))
    return F.when(F.coalesce(*parts).isNotNull() & (total > 0), total)


def main_thread(messages: DataFrame, session: DataFrame) -> DataFrame:
    """Messages of users, assistants and the system, without copied rows of subagents (in a
    subagent's own session they are the thread)."""
    own = messages.where("role IN ('assistant', 'system', 'user')").join(session.select(F.col("id").alias("session_id"), F.col("is_subagent").alias("_sub")), "session_id")
    rows = own.where("NOT is_sidechain OR _sub").drop("_sub")
    return rows.withColumn("is_boundary", F.col("is_boundary") & (F.col("role") == "system"))


def rollups(messages: DataFrame, session: DataFrame) -> DataFrame:
    """``(session_id, context_window_tokens, peak_context_tokens, compaction_count, turn_count)``
    of every session that has messages: what the archive keeps of the curve."""
    thread = main_thread(messages, session)
    seams = compaction_segments(thread).groupBy("session_id").agg(F.max("pre_tokens").alias("most_before"), F.count("*").alias("compaction_count"))
    point = F.when((F.col("role") == "assistant") & (F.col("context_tokens") > 0), F.col("context_tokens"))
    per = thread.groupBy("session_id").agg(F.max(point).alias("peak"), F.count_if("is_turn").alias("turns"))
    s = session.select(F.col("id").alias("session_id"), "tool", "model", F.col("context_window_tokens").alias("given"))
    out = s.join(per, "session_id", "left").join(seams, "session_id", "left")
    peak = F.coalesce("peak", F.lit(0))
    window = F.coalesce(F.when(F.col("given") > 0, F.col("given")), infer_window(F.col("tool"), F.col("model"), F.greatest(peak, F.coalesce("most_before", F.lit(0)))))
    turns = F.greatest(F.coalesce("turns", F.lit(0)), F.when(peak > 0, 1).otherwise(0))
    return out.select("session_id", window.cast("long").alias("context_window_tokens"), peak.cast("long").alias("peak_context_tokens"), F.coalesce("compaction_count", F.lit(0)).alias("compaction_count"), turns.cast("long").alias("turn_count"))


def active_seconds(messages: DataFrame, most: int = 300) -> DataFrame:
    """``messages(session_id, seq, epoch)`` -> the sum of positive gaps, each ``most`` at most."""
    gap = F.col("epoch") - F.lag("epoch").over(_order())
    return messages.where("epoch IS NOT NULL").withColumn("gap", gap).groupBy("session_id").agg(F.sum(F.when(F.col("gap") > 0, F.least("gap", F.lit(most))).otherwise(0)).cast("long").alias("active_seconds"))


def asof_stamp(messages: DataFrame, readings: DataFrame) -> DataFrame:
    """Readings go to the nearest assistant message before them, over tool and other
    messages but not over user and system ones; of several the last stays.

    ``messages(session_id, line_no, seq, role)``, ``readings(session_id, line_no, usage)`` ->
    ``(session_id, seq, usage)``.
    """
    rows = messages.where("role NOT IN ('tool', 'other')").select("session_id", "line_no", F.struct("seq", "role").alias("m"), F.lit(None).cast(readings.schema["usage"].dataType).alias("usage"))
    both = rows.unionByName(readings.select("session_id", "line_no", F.lit(None).cast(rows.schema["m"].dataType).alias("m"), "usage"))
    order = W.partitionBy("session_id").orderBy("line_no", F.col("usage").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("at", F.last("m", ignorenulls=True).over(order)).where("usage IS NOT NULL AND at.role = 'assistant'")
    return found.groupBy("session_id", F.col("at.seq").alias("seq")).agg(F.max_by("usage", "line_no").alias("usage"))


def billing_dedupe(records: DataFrame) -> DataFrame:
    """``records(session_id, seq, request_id, output_tokens, ..)`` with ``billed``: of the
    records of a request only the earliest with the greatest output keeps its usage;
    records without a request or usage keep what they have."""
    first = F.row_number().over(W.partitionBy("session_id", "request_id").orderBy(F.col("output_tokens").desc_nulls_last(), "seq"))
    keep = F.col("request_id").isNull() | F.col("output_tokens").isNull() | (first == 1)
    return records.withColumn("billed", keep & F.col("output_tokens").isNotNull())
