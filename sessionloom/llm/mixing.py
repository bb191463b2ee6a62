"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame
functions only.

Each document draws the exponential key -ln(u) / quality from a hash of its id.  A
source that should give more words than it has gives whole epochs first; the rest of
its budget is filled by the documents with the smallest keys.  Where that budget ends is
found by counting words in key ranges, each finer than the one before, until few enough
documents are left to sort; so one source with most of the rows costs no more than
others.  What comes out is one row for each source, and each document's share follows
from its own row and its source's: texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.llm.common import WORD, staged, unstage

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Ranges that a source's keys, or those of the range in which its budget ends, are cut into.
BUCKETS = 4096
#: Documents of one source that are sorted in one task, at most.
SORTED = 50_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def default_quality(text: Column, size: Column) -> Column:
    """Between 0 and 1, highest where words are 5.5 characters long on average; texts of
    glued or chopped words count less."""
    mean = F.coalesce(F.length(text), F.lit(0)) / F.greatest(size, F.lit(1))
    return 1 / (1 + F.abs(mean - 5.5) / 5.5)


def _keyed(docs: DataFrame, quality: Column | None, seed: str, *kept: Column) -> DataFrame:
    """``(id, skey, size, key)`` of each row, and the columns ``kept``."""
    size = word_count(F.col("text"))
    worth = default_quality(F.col("text"), size) if quality is None else quality
    draw = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    return docs.select(F.col("doc_id").alias("id"), skey.alias("skey"), size.alias("size"), (-F.log(draw) / worth).alias("key"), *kept)


def _shares(ranges: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """``(skey, source_size, target, epochs, rest)``: one row for each source."""
    sources = ranges.groupBy("skey").agg(F.sum("words").alias("source_size"))
    everything = W.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("skey") == "", F.col("skey"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    sources = sources.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), F.col("skey") == "", F.col("skey")).rowsBetween(W.unboundedPreceding, -1)
    sources = sources.withColumn(
        "level",  # words for each unit of weight, if just the sources before are at their caps
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))),
    )
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    sources = sources.withColumn("target", F.coalesce(F.least(F.col("cap"), F.max(free).over(everything) * F.col("weight")), F.col("cap")))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0)
    sources = sources.withColumn("epochs", epochs.cast("long"))
    return sources.select("skey", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))


def _ends(ranges: DataFrame, sources: DataFrame) -> DataFrame:
    """``(skey, rest, before, low, high, n)``: the range of keys in which a source's budget
    ends, and the words before it.  ``ranges(skey, at, words, n, low, high, ahead)``."""
    so_far = W.partitionBy("skey").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    found = ranges.withColumn("before", F.col("ahead") + F.coalesce(F.sum("words").over(so_far), F.lit(0))).join(sources.select("skey", "rest"), "skey")
    return found.where("before < rest AND before + words >= rest").select("skey", "rest", "before", "low", "high", "n")


def _plan(keyed: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """One row for each source: its size, target, whole epochs, and where the rest of its
    budget ends: ``low`` (all keys below are taken), ``cut`` (key, id and size of the last
    row that is taken; of ``cut_rows`` equal ones ``cut_taken`` are) or ``whole``."""
    counted = (F.sum("size").alias("words"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    # A key below any bound falls into a lower bucket than a key above it.
    first = F.floor((1 - F.exp(-F.col("key"))) * BUCKETS).cast("int").alias("at")
    ranges = staged(keyed.groupBy("skey", first).agg(*counted).withColumn("ahead", F.lit(0).cast("long")), "mix-ranges")
    sources = staged(_shares(ranges, weights, max_epochs), "mix-sources")
    ends = staged(_ends(ranges, sources), "mix-ends")
    unstage(ranges)
    while (ends.where("low < high").agg(F.max("n")).first()[0] or 0) > SORTED:
        # Ends: equal keys stay together, and a range with two keys is cut between them.
        finer = F.when(F.col("low") < F.col("high"), F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * BUCKETS)).otherwise(0).cast("int")
        inside = keyed.join(ends.drop("n", "rest"), "skey").where("key BETWEEN low AND high").select("skey", "size", "key", "before", finer.alias("at"))
        ranges = inside.groupBy("skey", "at").agg(*counted, F.first("before").alias("ahead"))
        after = staged(_ends(ranges, sources), "mix-ends")
        unstage(ends)
        ends = after
    # Rows of one key, id and size are interchangeable: they stand in one line.
    lines = keyed.join(ends.drop("n"), "skey").where("key BETWEEN low AND high").groupBy("skey", F.struct("key", "id", "size").alias("cut")).agg(F.count("*").alias("cut_rows"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    so_far = W.partitionBy("skey").orderBy("cut").rowsBetween(W.unboundedPreceding, -1)
    words = F.col("cut_rows") * F.col("cut.size")
    lines = lines.withColumn("before", F.col("before") + F.coalesce(F.sum(words).over(so_far), F.lit(0)))
    # A document is taken if that brings the source nearer to its target than leaving it.
    over = F.expr("2 * rest - (2 * before + cut.size)")
    lines = lines.withColumn("cut_taken", F.when(over < 0, 0).otherwise(F.least(F.col("cut_rows"), F.coalesce(F.floor(F.try_divide(over, F.expr("2 * cut.size"))) + 1, F.col("cut_rows")))).cast("long"))
    last = lines.where("cut_taken > 0").groupBy("skey").agg(F.max(F.struct("cut", "cut_rows", "cut_taken")).alias("l")).select("skey", "l.*")
    # Without an end nothing is left over (rest is 0), or rounding took it past all documents.
    plan = sources.join(ends.select("skey", "low"), "skey", "left").join(last, "skey", "left")
    plan = staged(plan.withColumn("whole", F.expr("low IS NULL AND rest > 0 AND rest >= source_size")), "mix-plan")
    unstage(ends)
    unstage(sources)
    return plan


def _with_times(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows with their source's plan and ``times``, how often each is taken.

    Each row is decided by itself.  Only where some, not all, of several equal rows at the
    end of a budget are taken are these rows counted, by the partition they lie in."""
    at_cut = F.struct("key", "id", "size").eqNullSafe(F.col("cut"))
    rows = keyed.join(plan, "skey")
    below = (F.col("key") < F.col("low")) | (F.col("cut").isNotNull() & (F.struct("key", "id", "size") < F.col("cut")))
    all_equal = at_cut & (F.col("cut_taken") == F.col("cut_rows"))
    sure = rows.withColumn("times", F.col("epochs") + F.coalesce(below | all_equal | F.col("whole"), F.lit(False)).cast("long"))
    if plan.where("cut_taken < cut_rows").isEmpty():
        return sure
    some = F.coalesce(at_cut & (F.col("cut_taken") < F.col("cut_rows")), F.lit(False))
    ties = staged(rows.where(some).withColumn("_row", F.monotonically_increasing_id()), "mix-ties").withColumn("_part", F.shiftright("_row", 33))
    parts = ties.groupBy("skey", "_part").agg(F.count("*").alias("_n"))
    ahead = W.partitionBy("skey").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("skey", "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    nth = F.row_number().over(W.partitionBy("skey", "_part").orderBy("_row"))
    ties = ties.withColumn("_nth", nth).join(parts, ["skey", "_part"]).withColumn("times", F.col("epochs") + (F.col("_ahead") + F.col("_nth") <= F.col("cut_taken")).cast("long"))
    return sure.where(~some).unionByName(ties.drop("_row", "_part", "_nth", "_ahead"))


def mixture(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    quality: Column | None = None,
    seed: str = SEED,
) -> DataFrame:
    """One row ``(doc_id, source, size, source_size, target, taken)`` for each row of ``docs``.

    Sources weigh ``weights``, repeating, in code point order with null last.  The words
    of all documents are shared out by weight; a target stops at ``max_epochs`` times its
    source's size and the excess is shared again by weight.  ``taken`` is a multiple of
    the document's size, at most ``max_epochs`` times; a source misses its target by half
    of one document at most.  Documents without words take 0.  ``quality`` may replace
    the quality weight (an expression over ``docs``, positive).  Ties of keys break by
    doc_id (null first), then size; rows equal in all three are interchangeable.  Reruns
    give equal results.  An empty table gives an empty result; other columns are ignored.
    """
    keyed = staged(_keyed(docs, quality, seed, F.col("source")), "mix-keys")
    out = _with_times(keyed, _plan(keyed, weights, max_epochs))
    return out.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, quality: Column | None = None, seed: str = SEED) -> DataFrame:
    """``docs`` as the mix has them, with all their columns: a document taken k times stands
    k times, one taken 0 times is gone, as is one without words.

    The plan is one row for each source, so each row of ``docs`` is decided where it lies.
    Nulls, ties, repeated rows and empty tables: as ``mixture`` has them."""
    keyed = staged(_keyed(docs, quality, seed), "mix-keys")
    plan = _plan(keyed, weights, max_epochs)
    unstage(keyed)
    rows = _keyed(docs, quality, seed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = _with_times(rows, plan).where("times > 0 AND size > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"))
    return taken.select("row.*")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
    length(coalesce(text, '')) AS chars,
    (CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / (1 / (1 + abs(chars::DOUBLE / greatest(size, 1) - 5.5::DOUBLE) / 5.5::DOUBLE)) AS key FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM d GROUP BY source),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER () AS all_weight FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER w, 0)) / (all_weight - coalesce(sum(weight) OVER w, 0)) AS level FROM c
  WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, coalesce(least(cap, max(CASE WHEN level * weight <= cap THEN level END) OVER () * weight), cap) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN rest > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
