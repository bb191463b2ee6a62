"""Tokens, cost and time of activity buckets.

Everything is long form ``(session_id, bucket, ..)`` until the end: sessions pool first,
costs are allocated to the pooled buckets, rows are rounded, and totals sum the rounded
rows.  Costs of sessions do not add up to pooled costs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.schema import BUCKETS


def half_up(c):
    return F.floor(c + 0.5).cast("long")


def generation(blocks: DataFrame) -> DataFrame:
    """Output tokens of each message split over its blocks.

    ``blocks(session_id, seq, ordinal, bucket, is_thinking, bytes, output_tokens,
    is_orientation)`` of assistant messages with usage -> ``(session_id, bucket, tokens,
    orientation_tokens)``.  Thinking takes what visible bytes / 4 do not explain; the rest
    goes to the other blocks by weight (bytes, 1 at least), and is lost without any.
    """
    message = W.partitionBy("session_id", "seq")
    visible = F.when(~F.col("is_thinking"), F.col("bytes")).otherwise(0)
    rows = blocks.withColumn("visible", F.sum(visible).over(message)).withColumn("thinks", F.max(F.col("is_thinking").cast("int")).over(message) == 1)
    planning = F.when(F.col("thinks"), F.greatest(F.lit(0.0), F.col("output_tokens") - F.col("visible") / 4)).otherwise(0.0)
    rows = rows.withColumn("planning", planning)
    weight = F.when(F.col("is_thinking"), 0).otherwise(F.greatest(F.col("bytes"), F.lit(1)))
    rows = rows.withColumn("weight", weight).withColumn("all_weight", F.sum("weight").over(message))
    thoughts = F.sum(F.col("is_thinking").cast("int")).over(message)
    share = F.when(F.col("is_thinking"), F.col("planning") / thoughts).otherwise((F.col("output_tokens") - F.col("planning")) * F.try_divide(F.col("weight"), F.col("all_weight")))
    rows = rows.withColumn("tokens", share).where("tokens > 0")
    bucket = F.when(F.col("is_thinking"), "planning").otherwise(F.col("bucket"))
    return rows.groupBy("session_id", bucket.alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.sum(F.when(F.col("is_orientation"), F.col("tokens")).otherwise(0.0)).alias("orientation_tokens"))


def aggregate_generation(session: DataFrame, blocks: DataFrame) -> DataFrame:
    """The same for producers that give sums only: ``session(session_id, output_tokens,
    reasoning_tokens)``, ``blocks(session_id, bucket, is_thinking, bytes, is_orientation)``
    of assistant messages.  Without blocks planning is implementation and the rest is lost."""
    weighed = blocks.where("NOT is_thinking").withColumn("weight", F.greatest("bytes", F.lit(1)))
    per = weighed.groupBy("session_id", "bucket").agg(F.sum("weight").alias("weight"), F.sum(F.when(F.col("is_orientation"), F.col("weight")).otherwise(0)).alias("orientation"))
    whole = per.groupBy("session_id").agg(F.sum("weight").alias("all"), F.sum("orientation").alias("oriented"))
    s = session.select("session_id", "output_tokens", F.least("output_tokens", F.coalesce("reasoning_tokens", F.lit(0))).alias("planning"))
    rest = per.join(whole, "session_id").join(s, "session_id")
    tokens = (F.col("output_tokens") - F.col("planning")) * F.col("weight") / F.col("all")
    spread = rest.select("session_id", "bucket", tokens.alias("tokens"), (tokens * F.col("orientation") / F.col("weight")).alias("orientation_tokens"))
    plans = s.join(whole, "session_id", "left").select("session_id", F.lit("planning").alias("bucket"), F.col("planning").cast("double").alias("tokens"), (F.col("planning") * F.coalesce(F.col("oriented") / F.col("all"), F.lit(0.0))).alias("orientation_tokens"))
    return spread.unionByName(plans).where("tokens > 0").groupBy("session_id", "bucket").agg(F.sum("tokens").alias("tokens"), F.sum("orientation_tokens").alias("orientation_tokens"))


def window_use(calls: DataFrame) -> DataFrame:
    """``calls(session_id, bucket, output_bytes, is_orientation)`` -> output bytes / 4 and the
    number of calls of each bucket, in both phases."""
    tokens = F.coalesce("output_bytes", F.lit(0)) / 4
    return calls.groupBy("session_id", "bucket").agg(F.sum(tokens).alias("window_tokens"), F.sum(F.when(F.col("is_orientation"), tokens).otherwise(0.0)).alias("orientation_window"), F.count("*").alias("calls"))


def latency(blocks: DataFrame, most_ms: int = 300_000) -> DataFrame:
    """``blocks(session_id, seq, epoch_ms, role, type, bucket, bytes)`` -> milliseconds of each
    bucket, user text as ``waiting``: a message's gap (0 to ``most_ms``) split by weight."""
    message = blocks.where("epoch_ms IS NOT NULL").groupBy("session_id", "seq").agg(F.first("epoch_ms").alias("epoch_ms"), F.sum(F.greatest("bytes", F.lit(1))).alias("weight"))
    gap = F.col("epoch_ms") - F.lag("epoch_ms").over(W.partitionBy("session_id").orderBy("seq"))
    message = message.withColumn("gap", F.greatest(F.lit(0), F.least(gap, F.lit(most_ms)))).where("gap > 0").select("session_id", "seq", "gap", "weight")
    rows = blocks.join(message, ["session_id", "seq"])
    bucket = F.when((F.col("role") == "user") & (F.col("type") == "text"), "waiting").otherwise(F.col("bucket"))
    ms = F.col("gap") * F.greatest("bytes", F.lit(1)) / F.col("weight")
    return rows.groupBy("session_id", bucket.alias("bucket")).agg(F.sum(ms).alias("ms"))


def pooled(tokens: DataFrame, windows: DataFrame, session: DataFrame) -> DataFrame:
    """A row for each bucket: generated tokens, window tokens, calls, and the cost allocated
    to the pooled buckets (output cost by generation, input cost by window)."""
    spark = tokens.sparkSession
    g = tokens.groupBy("bucket").agg(F.sum("tokens").alias("generation"))
    w = windows.groupBy("bucket").agg(F.sum("window_tokens").alias("window"), F.sum("calls").alias("calls"))
    rows = spark.createDataFrame([(b, i) for i, b in enumerate(BUCKETS)], "bucket string, place int").join(g, "bucket", "left").join(w, "bucket", "left").fillna(0)
    rows = rows.withColumn("window", F.col("window") + F.col("generation"))
    costs = session.agg(F.coalesce(F.sum("cost_in_nano"), F.lit(0)).alias("into"), F.coalesce(F.sum("cost_out_nano"), F.lit(0)).alias("out"))
    all_ = W.partitionBy(F.lit(0))  # four rows
    rows = rows.crossJoin(F.broadcast(costs))
    nano = F.coalesce(F.try_divide(F.col("out") * F.col("generation"), F.sum("generation").over(all_)), F.lit(0.0)) + F.coalesce(F.try_divide(F.col("into") * F.col("window"), F.sum("window").over(all_)), F.lit(0.0))
    rows = rows.withColumn("nano", nano).withColumn("share", F.round(F.coalesce(F.try_divide(F.col("nano"), F.sum("nano").over(all_)), F.lit(0.0)), 6))
    return rows.orderBy("place").select("bucket", half_up(F.col("generation")).alias("generation_tokens"), half_up(F.col("window")).alias("window_tokens"), F.col("calls").cast("long").alias("tool_calls"), F.round(F.col("nano") / 1e9, 6).alias("cost_usd"), F.col("share").alias("cost_share"))
