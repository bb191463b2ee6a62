"""Where the tokens, costs and time of real sessions went, by activity and phase.

A session's activity is a row for each of the four buckets: output tokens, tokens that
tool results put into the context, calls and time, each with the part that belongs to the
orientation before the session's first edit.  Such rows follow from blocks once for each
session and are kept; reports pool them over any set of sessions, allocate costs to the
pooled rows, round, and sum the rounded rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom import schema, store
from sessionloom.functions import commands
from sessionloom.operators.economics import half_up
from sessionloom.schema import BUCKETS, Archive
from sessionloom.staging import ship, staged, unstage

#: Longest gap between messages that counts as time, in milliseconds.
MOST_MS = 300_000
#: What kept rows are made by; others are made anew.
VERSION = 2
V = F.col
_PARTS = ("generation", "window", "ms")
ACTIVITY = "session_id long, bucket string, generation double, generation_o double, window double, window_o double, ms double, ms_o double, calls long"
SUMMARY = "session_id long, started_at string, cost_in_nano long, cost_out_nano long, billed long, waiting_ms double"


def block_rows(block: DataFrame, message: DataFrame, tool_call: DataFrame) -> DataFrame:
    """``(session_id, seq, ordinal, role, type, output_tokens, timestamp, tool_name, tool_input,
    bytes)``: blocks with what their message says.  Results take the tool and input of the
    call that they end; a use's size is that of name and input, a result's its own, any
    other block's its text."""
    ends = tool_call.where("result_seq IS NOT NULL").groupBy("session_id", V("result_seq").alias("seq"), V("result_ordinal").alias("ordinal"))
    ends = ends.agg(F.first("tool_name").alias("of_tool"), F.first("input").alias("of_input"))
    said = message.select("session_id", "seq", "role", "output_tokens", "timestamp")
    rows = block.select("session_id", "seq", "ordinal", "type", "text", "tool_name", "tool_input", "tool_result").join(said, ["session_id", "seq"]).join(ends, ["session_id", "seq", "ordinal"], "left")
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    name, given = F.coalesce("tool_name", "of_tool"), F.when(V("type").isin("tool_use", "tool_result", "web_search"), F.coalesce("tool_input", "of_input"))
    use = size(name) + 1 + size(given)
    return rows.select("session_id", "seq", "ordinal", "role", "type", "output_tokens", "timestamp", name.alias("tool_name"), given.alias("tool_input"), F.when(V("type") == "tool_use", use).when(V("type") == "tool_result", size(V("tool_result"))).otherwise(size(V("text"))).alias("bytes"))


def first_edits(rows: DataFrame) -> DataFrame:
    """``(session_id, boundary)``: the message of the first use of a tool that edits files."""
    edits = rows.where("type = 'tool_use'").where(commands.is_code_edit(V("tool_name"), V("command")))
    return edits.groupBy("session_id").agg(F.min("seq").alias("boundary"))


def _is_early():
    """Before the first edit; all of a session that never edits."""
    return F.coalesce(V("seq") < V("boundary"), V("seq").isNotNull() & V("boundary").isNull())


def epoch_ms(timestamp):
    """Milliseconds of a time that ends with Z; null of others."""
    at = F.try_to_timestamp(F.when(timestamp.endswith("Z") & timestamp.contains("T"), timestamp))
    return F.unix_millis(at)


def activity(archive: Archive) -> tuple[DataFrame, DataFrame]:
    """``(rows, summaries)`` of all sessions of the archive: ``ACTIVITY``, buckets that a
    session doesn't touch left out, and ``SUMMARY``."""
    ship(archive.session.sparkSession)
    rows = block_rows(archive.block, archive.message, archive.tool_call).withColumn("command", commands.decoded("tool_name", "tool_input"))
    rows = rows.withColumn("bucket", commands.block_bucket(V("type"), V("tool_name"), V("command")))
    rows = staged(rows.drop("tool_input"), "activity-blocks")
    edits = staged(first_edits(rows), "first-edits")
    rows = rows.join(edits, "session_id", "left").withColumn("is_o", _is_early()).withColumn("weight", F.greatest(V("bytes"), F.lit(1)))
    thinks = V("type") == "thinking"
    message = W.partitionBy("session_id", "seq")

    # Output by message, where messages say how much; by session where they don't.
    s = archive.session.select(V("id").alias("session_id"), "tool", "output_tokens", "reasoning_tokens", "reasoning_estimate")
    by_message = rows.where("output_tokens > 0").select("session_id").distinct().join(s.where("tool <> 'codex'").select("session_id"), "session_id", "left_semi")
    said = rows.join(by_message, "session_id", "left_semi").where("output_tokens > 0")
    said = said.withColumn("visible", F.sum(F.when(~thinks, V("bytes")).otherwise(0)).over(message)).withColumn("thoughts", F.sum(thinks.cast("int")).over(message))
    said = said.withColumn("all_weight", F.sum(F.when(~thinks, V("weight")).otherwise(0)).over(message))
    planning = F.when(V("thoughts") > 0, F.greatest(F.lit(0.0), V("output_tokens") - V("visible") / 4)).otherwise(0.0)
    share = F.when(thinks, planning / V("thoughts")).otherwise((V("output_tokens") - planning) * F.try_divide(V("weight"), V("all_weight")))
    made = said.select("session_id", "bucket", "is_o", share.alias("generation"))

    rest = s.join(by_message, "session_id", "left_anti").withColumn("planned", F.least(F.coalesce("output_tokens", F.lit(0)), F.coalesce(F.when(V("reasoning_tokens") != 0, V("reasoning_tokens")), V("reasoning_estimate"), F.lit(0))))
    spoken = rows.where((V("role") == "assistant") & ~thinks)
    sums = spoken.groupBy("session_id").agg(F.sum("weight").alias("all_weight"), F.sum(F.when(V("is_o"), V("weight")).otherwise(0)).alias("o_weight"))
    rest = staged(rest.join(sums, "session_id", "left"), "aggregate-sessions")
    spread = spoken.join(rest.select("session_id", V("output_tokens").alias("out"), "planned", "all_weight"), "session_id")
    spread = spread.select("session_id", "bucket", "is_o", ((V("out") - V("planned")) * V("weight") / V("all_weight")).alias("generation"))
    early = F.coalesce(V("o_weight") / V("all_weight"), F.lit(0.0))
    phases = F.explode(F.array(F.struct(F.lit(True).alias("is_o"), early.alias("part")), F.struct(F.lit(False).alias("is_o"), (1 - early).alias("part"))))
    plans = rest.select("session_id", "planned", phases.alias("p")).select("session_id", F.lit("planning").alias("bucket"), V("p.is_o").alias("is_o"), (V("planned") * V("p.part")).alias("generation"))
    generation = made.unionByName(spread).unionByName(plans).where("generation > 0")

    # What results put into the context, by call.
    calls = archive.tool_call.withColumn("command", commands.decoded("tool_name", "input")).join(edits, "session_id", "left")
    window = F.coalesce(V("output_bytes"), F.lit(0)) / 4.0
    calls = calls.select("session_id", commands.tool_bucket(V("tool_name"), V("command")).alias("bucket"), _is_early().alias("is_o"), window.alias("window"), F.lit(1).alias("calls"))

    # Time between messages that have blocks, by the blocks of the later one.
    timed = rows.withColumn("at", epoch_ms(V("timestamp"))).where("at IS NOT NULL")
    gaps = timed.groupBy("session_id", "seq").agg(F.first("at").alias("at"), F.sum("weight").alias("all_weight"))
    gap = F.least(F.greatest(V("at") - F.lag("at").over(W.partitionBy("session_id").orderBy("seq")), F.lit(0)), F.lit(MOST_MS))
    gaps = gaps.withColumn("gap", gap).where("gap > 0").select("session_id", "seq", "gap", "all_weight")
    timed = timed.join(gaps, ["session_id", "seq"]).withColumn("ms", V("gap") * V("weight") / V("all_weight"))
    waits = (V("role") == "user") & (V("type") == "text")
    waiting = timed.where(waits).groupBy("session_id").agg(F.sum("ms").alias("waiting_ms"))
    timed = timed.where(~F.coalesce(waits, F.lit(False))).select("session_id", "bucket", "is_o", "ms")

    every = generation.unionByName(calls, allowMissingColumns=True).unionByName(timed, allowMissingColumns=True)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    parts = [x for c in _PARTS for x in (total(V(c)).alias(c), total(F.when(V("is_o"), V(c))).alias(f"{c}_o"))]
    out = every.groupBy("session_id", "bucket").agg(*parts, F.coalesce(F.sum("calls"), F.lit(0)).cast("long").alias("calls"))
    billed = sum((F.coalesce(V(c), F.lit(0)) for c in ("input_tokens", "cache_read_tokens", "cache_creation_tokens")), F.lit(0)).cast("long")
    summary = archive.session.select(V("id").alias("session_id"), "started_at", "cost_in_nano", "cost_out_nano", billed.alias("billed")).join(waiting, "session_id", "left").fillna(0, ["cost_in_nano", "cost_out_nano", "waiting_ms"])
    return schema.shaped(out, ACTIVITY), schema.shaped(summary, SUMMARY)


def with_billed_window(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """Rows whose windows also hold the input that each session was billed for, shared by what
    its buckets put into the context; a session without any has it all in ``context``."""
    weight, early = V("generation") + V("window"), V("generation_o") + V("window_o")
    whole = rows.groupBy("session_id").agg(F.sum(weight).alias("all_weight"))
    s = summary.select("session_id", "billed").join(whole, "session_id", "left")
    grid = s.withColumn("bucket", F.explode(F.array(*map(F.lit, BUCKETS))))
    full = grid.join(rows, ["session_id", "bucket"], "left").fillna(0, [f.split()[0] for f in ACTIVITY.split(", ")[2:]])
    is_context = V("bucket") == "context"
    into = F.when(V("all_weight") > 0, V("billed") * weight / V("all_weight")).otherwise(F.when(is_context, V("billed")).otherwise(0.0))
    part = F.when(weight > 0, early / weight).otherwise(F.when(is_context, 1.0).otherwise(0.0))
    full = full.withColumn("into", into).withColumn("window_o", V("window_o") + V("into") * part).withColumn("window", V("window") + V("into"))
    return schema.shaped(full.where("generation > 0 OR window > 0 OR ms > 0 OR calls > 0"), ACTIVITY)


_AMOUNTS = ("generation_tokens", "context_window_tokens", "estimated_cost_usd", "active_ms")


def report(rows: DataFrame, summary: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """A row for each scope and bucket, in their order, and one named ``total``.

    ``scope(scope_id, session_id)`` says which sessions belong together; without it all do,
    as scope 0.  Costs are allocated to the pooled buckets: output cost by generated tokens,
    input cost by window, which holds what was generated as well.  The total sums the
    rounded rows; it alone has the costs, the waiting time and the attributed time."""
    if scope is None:
        scope = summary.select(F.lit(0).cast("long").alias("scope_id"), "session_id")
    touched = (V("generation") > 0) | (V("calls") > 0) | (V("window") > 0)
    mine = scope.join(rows, "session_id")
    sums = mine.groupBy("scope_id", "bucket").agg(*[F.sum(c).alias(c) for p in _PARTS for c in (p, f"{p}_o")], F.sum("calls").alias("calls"), F.count_distinct(F.when(touched, V("session_id"))).alias("sessions"))
    costs = scope.join(summary, "session_id").groupBy("scope_id").agg(F.sum("cost_in_nano").alias("into"), F.sum("cost_out_nano").alias("out"), F.sum("waiting_ms").alias("waiting"))
    grid = costs.withColumn("b", F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(b).alias("bucket")) for i, b in enumerate(BUCKETS)]))).select("*", "b.*").drop("b")
    full = grid.join(sums, ["scope_id", "bucket"], "left").fillna(0)
    full = full.withColumn("window", V("window") + V("generation")).withColumn("window_o", V("window_o") + V("generation_o"))
    whole = W.partitionBy("scope_id")
    share = lambda x, c: F.coalesce(F.try_divide(V(x), F.sum(c).over(whole)), F.lit(0.0))
    cost = lambda g, w: (V("out") * share(g, "generation") + V("into") * share(w, "window")) / 1e9
    full = full.withColumn("cost", cost("generation", "window")).withColumn("cost_o", cost("generation_o", "window_o"))
    full = full.withColumn("cost_share", F.coalesce(F.try_divide(V("cost"), F.sum("cost").over(whole)), F.lit(0.0)))
    pairs = (("generation", "generation_tokens"), ("window", "context_window_tokens"), ("cost", "estimated_cost_usd"), ("ms", "active_ms"))
    shown = lambda c, x: x if c == "cost" else half_up(x)
    columns = [shown(c, V(c)).alias(n) for c, n in pairs]
    columns += [shown(c, V(f"{c}_o")).alias(f"orientation_{n}") for c, n in pairs] + [shown(c, V(c) - V(f"{c}_o")).alias(f"implementation_{n}") for c, n in pairs]
    by = full.select("scope_id", "place", "bucket", *columns, V("calls").cast("long").alias("tool_calls"), V("sessions").cast("long").alias("sessions"), "cost_share", "into", "out", "waiting")
    names = [f"{phase}{n}" for phase in ("", "orientation_", "implementation_") for n in _AMOUNTS]
    total = by.groupBy("scope_id").agg(*[F.sum(n).alias(n) for n in names], F.sum("tool_calls").alias("tool_calls"), F.first("into").alias("into"), F.first("out").alias("out"), F.first("waiting").alias("waiting"))
    total = total.withColumn("waiting_on_user_ms", half_up(V("waiting"))).withColumn("attributed_ms", V("active_ms") + V("waiting_on_user_ms"))
    total = total.withColumn("input_cost_usd", V("into") / 1e9).withColumn("output_cost_usd", V("out") / 1e9).withColumn("bucket", F.lit("total")).withColumn("place", F.lit(len(BUCKETS)))
    out = by.drop("into", "out", "waiting").unionByName(total.drop("into", "out", "waiting"), allowMissingColumns=True)
    usd = [n for n in out.columns if n.endswith("_usd") or n == "cost_share"]
    return out.withColumns({n: F.round(n, 9) for n in usd}).orderBy("scope_id", "place").drop("place")


def session_reports(rows: DataFrame, summary: DataFrame, closure: DataFrame) -> DataFrame:
    """``report`` of each session with all under it, ``closure(ancestor_id, descendant_id)``;
    windows hold what was billed."""
    return report(with_billed_window(rows, summary), summary, closure.select(V("ancestor_id").alias("scope_id"), V("descendant_id").alias("session_id")).distinct())


# Rows that are kept.

MARKS = f"{SUMMARY}, mark long, version int"


def refresh(spark: SparkSession, path: str, archive_path: str, version: int = VERSION) -> int:
    """Bring the kept rows at ``path`` in step with an archive.  Sessions whose file has
    changed since, or whose rows another version made, are derived again, and their folders
    alone are written.  Returns how many sessions were."""
    from sessionloom import ingest
    from sessionloom.operators.search import session_marks

    at, source_at = store.manifest(spark, path), store.manifest(spark, archive_path)
    archive = ingest.load(spark, archive_path, source_at)
    marks = staged(session_marks(store.read(spark, archive_path, "source", schema.SOURCE, source_at)), "marks")
    kept = store.read(spark, path, "summary", MARKS, at)
    fine = kept.where(V("version") == version).join(marks, ["session_id", "mark"], "left_semi").select("session_id")
    stale = staged(marks.join(fine, "session_id", "left_anti"), "stale")
    gone = staged(kept.join(marks, "session_id", "left_anti").select("session_id"), "gone")
    n = stale.count()
    if n or not gone.isEmpty():
        ids = stale.select("session_id")
        only = lambda df, key="session_id": df.join(ids.withColumnRenamed("session_id", key), key, "left_semi")
        part = Archive(archive.project, only(archive.session, "id"), only(archive.message), only(archive.block), only(archive.tool_call), archive.file_ref, archive.issue, archive.user_state)
        rows, summary = activity(part)
        change = store.Change(spark, path, at)
        touched = staged(ids.union(gone), "touched")
        folders = sorted(r.k for r in touched.select(store.folder_of(V("session_id"), at.folders).alias("k")).distinct().collect()) if at.tables else None
        for name, ddl, new in (("activity", ACTIVITY, rows), ("summary", MARKS, summary.join(stale, "session_id").withColumn("version", F.lit(version)))):
            before = store.read(spark, path, name, ddl, at, folders)
            change.put(name, before.join(touched, "session_id", "left_anti").select(before.columns).unionByName(schema.shaped(new, ddl)), ddl, "session_id", folders)
        change.commit()
        unstage(touched)
    for df in (marks, stale, gone):
        unstage(df)
    return n


def kept(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, summaries)`` as kept."""
    at = store.manifest(spark, path)
    return store.read(spark, path, "activity", ACTIVITY, at), store.read(spark, path, "summary", SUMMARY, at)
