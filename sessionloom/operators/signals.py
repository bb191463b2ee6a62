"""Threshold signals and their lifecycle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

V = F.col

#: A busy tool or server alone is no problem: this score is below every other signal's.
USAGE_SCORE = 2.0


#: Days that signals look back, characters of a name in a key.
WINDOW_DAYS, KEY_MOST = 30, 120


def digest(value: Column) -> Column:
    """The first 16 hexadecimal digits of the name's SHA-256, as UTF-16."""
    return F.substring(F.sha2(F.encode(value, "UTF-16LE"), 256), 1, 16)


def key_part(value: Column) -> Column:
    """A name as a part of a key.  Letters, digits and a few marks stay; a name that has
    anything else, is too long or looks like one with a digest carries its digest, so
    different names have different parts."""
    clean = F.regexp_replace(F.substring(F.regexp_replace(value, "[^A-Za-z0-9._:/-]+", "-"), 1, KEY_MOST), "^-+|-+$", "")
    plain = (clean == value) & ~F.regexp_like(value, F.lit(r"\.h[0-9a-f]{16}$"))
    return F.when(plain, clean).otherwise(F.concat(clean, F.lit(".h"), digest(value)))


def in_window(session: DataFrame, now: str, days: int = WINDOW_DAYS) -> DataFrame:
    """Sessions that began within so many days before ``now``; those without a start are out."""
    began = F.try_to_timestamp(V("started_at"))
    return session.where((began >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(days))) & (began <= F.to_timestamp(F.lit(now))))


def hot_context_files(file_ref: DataFrame, least_readers: int = 8, most_editors: int = 2, n: int = 2) -> DataFrame:
    who = lambda *ops: F.countDistinct(F.when(F.col("operation").isin(*ops), F.col("session_id")))
    out = file_ref.where("path IS NOT NULL").groupBy(F.col("path").alias("key")).agg(who("read").alias("readers"), who("edit", "write", "delete").alias("editors"))
    return out.where((F.col("readers") >= least_readers) & (F.col("editors") <= most_editors)).orderBy(F.col("readers").desc(), "key").limit(n)


def churn_files(file_ref: DataFrame, least: int = 6, n: int = 2) -> DataFrame:
    out = file_ref.where("path IS NOT NULL AND operation IN ('edit', 'write')").groupBy(F.col("path").alias("key")).agg(F.countDistinct("session_id").alias("editors"))
    return out.where(F.col("editors") >= least).orderBy(F.col("editors").desc(), "key").limit(n)


def search_counts(session: DataFrame, tool_call: DataFrame, tools: list[str]) -> DataFrame:
    found = tool_call.where(F.col("tool_name").isin(*tools)).join(session.select(F.col("id").alias("session_id")), "session_id", "left_semi").agg(F.count("*").alias("searches"), F.countDistinct("session_id").alias("sessions"))
    return found.crossJoin(F.broadcast(session.agg(F.count("*").alias("in_window"))))  # one row each


def abandoned_counts(session: DataFrame) -> DataFrame:
    return session.where("outcome IS NOT NULL").agg(F.count("*").alias("classified"), F.count_if(F.col("outcome") == "abandoned").alias("abandoned"))


def signals(session: DataFrame, tool_call: DataFrame, file_ref: DataFrame | None = None, issue: DataFrame | None = None, search_tools: list[str] | None = None, n: int = 12) -> DataFrame:
    """``(key, score)`` of the signals that hold, the highest scores first."""
    usage = tool_call.groupBy("tool_name", "tool_kind", "mcp_server").agg(F.count("*").alias("calls"), F.count_if("is_error").alias("errors"))
    key = lambda kind, *parts: F.concat(F.lit(f"signal:{kind}:"), *parts)
    rate = F.col("errors") / F.col("calls")
    out = [usage.where((F.col("calls") >= 20) & (rate >= 0.12)).select(key("error", key_part(V("tool_name")), F.lit(".h"), digest(F.to_json(F.array("tool_kind", "mcp_server")))).alias("key"), F.round(F.col("errors").cast("double"), 6).alias("score"))]
    servers = usage.where("mcp_server IS NOT NULL").groupBy("mcp_server").agg(F.sum("calls").alias("calls")).orderBy(F.col("calls").desc(), "mcp_server").limit(3)
    out.append(servers.where("calls >= 50").select(key("heavy-server", key_part(V("mcp_server"))).alias("key"), F.lit(USAGE_SCORE).alias("score")))
    tools = usage.where("tool_kind <> 'mcp'").orderBy(F.col("calls").desc(), "tool_name").limit(2)
    out.append(tools.where("calls >= 200").select(key("heavy-tool", key_part(V("tool_name"))).alias("key"), F.lit(USAGE_SCORE).alias("score")))
    models = session.groupBy("model").agg(F.sum("cost_nano").alias("nano")).agg(F.max("nano").alias("top"), F.sum("nano").alias("nano"))
    out.append(models.where("nano > 0 AND top / nano >= 0.4").select(F.lit("signal:cost-concentration").alias("key"), F.lit(5.0).alias("score")))
    share = F.col("abandoned") / F.col("classified")
    ended = abandoned_counts(session).where((F.col("classified") >= 10) & (share > 0.25))
    out.append(ended.select(F.lit("signal:abandoned-rate").alias("key"), F.round(F.floor(share * 100 + 0.5) / 3, 6).alias("score")))
    if file_ref is not None:
        out.append(hot_context_files(file_ref).select(key("hot-context", key_part(V("key"))).alias("key"), F.col("readers").cast("double").alias("score")))
        out.append(churn_files(file_ref).select(key("churn", key_part(V("key"))).alias("key"), (F.col("editors") * 1.5).cast("double").alias("score")))
    if search_tools:
        ratio = F.col("searches") / F.col("in_window")
        found = search_counts(session, tool_call, search_tools).where((F.col("in_window") >= 20) & (F.col("sessions") > 0) & (ratio >= 5))
        out.append(found.select(F.lit("signal:search-heavy").alias("key"), (ratio * 2).alias("score")))
    if issue is not None:
        bad = session.join(issue.where("code <> 'unparsed_line'").select("source_path").distinct(), "source_path", "left_semi").agg(F.count("*").alias("bad"))
        bad = bad.crossJoin(F.broadcast(session.agg(F.count("*").alias("n")))).where("n >= 15 AND bad > 0 AND bad / n >= 0.1")
        out.append(bad.select(F.lit("signal:ingest-health").alias("key"), (F.col("bad") * 2.0).alias("score")))
    return reduce(DataFrame.unionByName, out).orderBy(F.col("score").desc(), "key").limit(n)


def regenerate(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old state ``(key, status, resolution, score)`` and the signals that hold now ``(key,
    score)`` -> the new state.

    New signals open; open ones that no longer hold are implemented by activity, and open
    again if they come back; what a user marked stays.
    """
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col("a.key") == F.col("b.key"), "full")
    back = (F.col("a.status") == "implemented") & (F.col("a.resolution") == "activity") & F.col("b.key").isNotNull()
    gone = (F.col("a.status") == "open") & F.col("b.key").isNull()
    status = F.when(F.col("a.key").isNull() | back, "open").when(gone, "implemented").otherwise(F.col("a.status"))
    resolution = F.when(F.col("a.key").isNull() | back, F.lit(None).cast("string")).when(gone, "activity").otherwise(F.col("a.resolution"))
    return both.select(F.coalesce("a.key", "b.key").alias("key"), status.alias("status"), resolution.alias("resolution"), F.coalesce("b.score", "a.score").alias("score"))


def mark_implemented(state: DataFrame, key: str) -> DataFrame:
    hit = F.col("key") == key
    return state.withColumn("status", F.when(hit, "implemented").otherwise(F.col("status"))).withColumn("resolution", F.when(hit, "user").otherwise(F.col("resolution")))


def migrated(state: DataFrame, renames: DataFrame) -> DataFrame:
    """The state with keys as ``renames(old_key, key)`` say.  Where a signal has rows under both
    keys, what a user marked stands, then what is resolved, then the row of the new key."""
    known = renames.select(V("old_key").alias("_old"), V("key").alias("_new")).dropDuplicates(["_old"])
    rows = state.join(known, V("key") == V("_old"), "left").withColumn("_is_new", V("_old").isNull()).withColumn("key", F.coalesce("_new", "key"))
    weight = F.struct((F.coalesce(V("resolution"), F.lit("")) == "user").alias("u"), (V("status") != "open").alias("s"), V("_is_new").alias("n"))
    columns = [c for c in state.columns if c != "key"]
    best = rows.groupBy("key").agg(F.max_by(F.struct(*columns), weight).alias("r"))
    return best.select("key", *[V(f"r.{c}").alias(c) for c in columns]).select(*state.columns)


def error_renames(tool_call: DataFrame) -> DataFrame:
    """``(old_key, key)`` of error signals from when their names were joined by dots.  A key that
    two tools shared says nothing about either and goes to neither."""
    tools = tool_call.select("tool_name", "tool_kind", "mcp_server").distinct()
    old = F.concat(F.lit("signal:error:"), F.concat_ws(".", "tool_name", "tool_kind", "mcp_server"))
    new = F.concat(F.lit("signal:error:"), key_part(V("tool_name")), F.lit(".h"), digest(F.to_json(F.array("tool_kind", "mcp_server"))))
    pairs = tools.select(old.alias("old_key"), new.alias("key")).distinct()
    return pairs.groupBy("old_key").agg(F.count("*").alias("n"), F.first("key").alias("key")).where("n = 1").select("old_key", "key")


def after_hiding(old: DataFrame, new: DataFrame) -> DataFrame:
    """The state after sessions were hidden or shown: that a signal's evidence is hidden doesn't
    mean that anything was done about it, so open ones that no user has touched go, and come
    back with their evidence.  All else stays, as in ``regenerate``."""
    state = regenerate(old, new)
    untouched = old.where((V("status") == "open") & V("resolution").isNull()).join(new.select("key"), "key", "left_anti").select("key")
    return state.join(untouched, "key", "left_anti")
