"""Titles found in spite of a typing error.

A word and the word that was meant differ by one letter that is too many, too few, wrong
or swapped with its neighbour.  Take one letter out of both in every way, or none: two such
words then have a form in common.  So words of the query meet words of the titles by a
join on these forms, and only what meets is compared; no pair of words is ever looked at
that shares none.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.operators.search import fold

V = F.col
#: Shorter words must be spelled right.
SPELLED = 3


def forms(word: Column) -> Column:
    """The word, and the word less each of its letters."""
    n = F.length(word)
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.array_distinct(F.concat(F.array(word), F.when(n >= SPELLED, less).otherwise(F.array().cast("array<string>"))))


def is_near(a: Column, b: Column) -> Column:
    """One letter inserted, left out, replaced, or two neighbours swapped, at most."""
    n = F.length(a)
    swapped = F.exists(
        F.when((n == F.length(b)) & (n > 1), F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)) == b,
    )
    return (F.levenshtein(a, b) <= 1) | swapped


def fuzzy_titles(titles: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """``(id, exact, boundary, phrase, span, length, marks)`` of the titles that hold each word
    of the query, as it is, within a word, or with one typing error.

    First come those with most words as they are, then those whose words most often begin or
    end where a word does, the whole query in one piece, the words closest together, the
    shortest title, the smallest id.  ``marks``: for each word of the query the place
    (from 1) and length of what matched.  ``titles(id, title)``; null titles hold nothing, a
    query without words finds nothing."""
    spark = titles.sparkSession
    words = list(dict.fromkeys(w for w in re.split(r"[\W_]+", query.lower()) if w))
    rows = titles.where("title IS NOT NULL").select("id", fold(V("title")).alias("folded")).select("id", F.explode(F.array("folded")).alias("folded"))
    if not words:
        return rows.limit(0).select("id", *[F.lit(0).alias(c) for c in ("exact", "boundary", "phrase", "span", "length")], F.array().cast("array<struct<place:int,size:int>>").alias("marks"))
    asked = spark.createDataFrame(list(enumerate(words)), "nth int, raw string").select("nth", fold(V("raw")).alias("word"))
    asked = asked.where("word <> ''")

    # As it is: the first place, with a point for each side at which a word begins or ends.
    letter = r"[\p{L}\p{N}]"
    pairs = rows.withColumn("q", F.explode(F.array(*[F.struct(F.lit(i).alias("nth"), fold(F.lit(w)).alias("word")) for i, w in enumerate(words)]))).select("id", "folded", "q.*").where("word <> ''")
    at = F.instr(V("folded"), V("word"))
    before, after = F.substring(V("folded"), at - 1, F.lit(1)), F.substring(V("folded"), at + F.length("word"), F.lit(1))
    sides = F.when((at == 1) | ~F.regexp_like(before, F.lit(letter)), 1).otherwise(0) + F.when((at + F.length("word") > F.length("folded")) | ~F.regexp_like(after, F.lit(letter)), 1).otherwise(0)
    exact = pairs.where(at > 0).select("id", "nth", F.lit(1).alias("is_exact"), sides.alias("points"), at.alias("place"), F.length("word").alias("size"))

    # With an error: words of titles and of the query meet by their forms.
    spoken = rows.select("id", "folded", F.explode(F.array_distinct(F.filter(F.split("folded", r"[^\p{L}\p{N}]+"), lambda w: w != ""))).alias("said"))
    meant = asked.where(F.length("word") >= SPELLED).withColumn("form", F.explode(forms(V("word"))))
    met = spoken.withColumn("form", F.explode(forms(V("said")))).join(F.broadcast(meant), "form").select("id", "folded", "said", "nth", "word").distinct()
    near = met.where((V("said") != V("word")) & is_near(V("said"), V("word")))
    near = near.select("id", "nth", F.lit(0).alias("is_exact"), F.lit(0).alias("points"), F.instr(V("folded"), V("said")).alias("place"), F.length("said").alias("size"))

    best = exact.unionByName(near).groupBy("id", "nth").agg(F.max_by(F.struct("is_exact", "points", "place", "size"), F.struct("is_exact", "points", -V("place"))).alias("m"))
    whole = best.groupBy("id").agg(
        F.count("*").alias("found"), F.sum("m.is_exact").cast("int").alias("exact"), F.sum("m.points").cast("int").alias("boundary"),
        (F.max(F.when(V("m.is_exact") == 1, V("m.place") + V("m.size"))) - F.min(F.when(V("m.is_exact") == 1, V("m.place")))).alias("span"),
        F.transform(F.sort_array(F.collect_list(F.struct("nth", V("m.place").alias("place"), V("m.size").alias("size")))), lambda x: F.struct(x["place"].alias("place"), x["size"].alias("size"))).alias("marks"),
    )
    phrase = fold(F.lit(" ".join(query.split())))
    out = whole.where(V("found") == len(words)).join(rows, "id").select("id", "exact", "boundary", V("folded").contains(phrase).cast("int").alias("phrase"), F.coalesce("span", F.lit(2**31 - 1)).alias("span"), F.length("folded").alias("length"), "marks")
    out = out.orderBy(F.desc("exact"), F.desc("boundary"), F.desc("phrase"), "span", "length", "id")
    return out if limit is None else out.limit(limit)
