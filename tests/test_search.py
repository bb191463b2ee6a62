"""Phrases, prefixes, folding, weights and visibility of the search."""

import os
import random
import time

import transcripts_fixture as fx
from pyspark.sql import functions as F
from sessionloom import ingest, schema, store
from sessionloom.operators import search
from sessionloom.staging import staged


def found(spark, rows, query, **more):
    blocks = spark.createDataFrame(rows, "block_id long, text string, tool_name string, tool_input string")
    index = search.postings(blocks, {"text": 4.0, "tool_name": 2.0, "tool_input": 1.0})
    return [r.block_id for r in search.bm25(index, query, **more).collect()]


ROWS = [
    (1, "alpha beta", None, None),
    (2, "beta gap alpha", None, None),
    (3, "erdő alphabet", "", "alpha"),
    (4, None, "alpha", "beta"),
    (5, "alpha x alpha beta", None, None),
    (6, "", None, None),
]


def test_quoted_words_are_neighbours_in_one_column(spark):
    assert sorted(found(spark, ROWS, '"alpha beta"')) == [1, 5]
    assert sorted(found(spark, ROWS, "alpha beta")) == [1, 2, 4, 5]
    assert sorted(found(spark, ROWS, "alpha-beta")) == [1, 5]  # one word, two terms


def test_last_phrase_is_a_prefix(spark):
    assert sorted(found(spark, ROWS, '"alpha b"')) == [1, 5]
    assert sorted(found(spark, ROWS, "alphab")) == [3]
    assert sorted(found(spark, ROWS, "alph beta")) == []


def test_marks_fold_on_both_sides(spark):
    assert found(spark, ROWS, "erdő") == found(spark, ROWS, "ERDO") == [3]


def test_heavier_columns_come_first(spark):
    rows = [(1, None, None, "needle"), (2, None, "needle", None), (3, "needle", None, None)] + [(i, "hay", None, None) for i in range(4, 12)]
    assert found(spark, rows, "needle") == [3, 2, 1]


def test_visibility_and_pages_come_after_scoring(spark):
    visible = spark.createDataFrame([(1,), (2,)], "block_id long")
    assert sorted(found(spark, ROWS, "alpha beta", visible=visible)) == [1, 2]
    every = found(spark, ROWS, "alpha beta")
    assert found(spark, ROWS, "alpha beta", limit=2, offset=1) == every[1:3]


def test_nothing_to_find(spark):
    assert found(spark, ROWS, "") == found(spark, ROWS, '"" --') == found(spark, [], "alpha") == []


def test_parts_of_a_query():
    assert search.parse_query('"a b" c\\"d "e') == [(("a", "b"), False), (("c", "d"), False), (("e",), True)]


def test_a_text_is_taken_apart_once(spark):
    blocks = spark.createDataFrame([(1, "word " * 20_000, None, None)], "block_id long, text string, tool_name string, tool_input string")
    rows, lengths = search.postings(blocks, search.WEIGHTS)
    plan = rows.groupBy("term").count()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == len(search.WEIGHTS)
    took = time.time()
    assert rows.count() == 20_000 and lengths.collect() == [(1, 20_000)]
    assert time.time() - took < 20


WORDS = ["alpha", "beta", "gamma", "delta", "erdő", "al", "alp", "zeta-eta", "x1", "café"]


def some_blocks(spark, seed, n, sessions):
    r = random.Random(seed)
    rows = [(i, i % sessions, 0, 0, "text", " ".join(r.choices(WORDS, k=r.randint(0, 9))) or None, r.choice([None, "Bash", "alpha"]), None, r.choice([None, '{"a":"beta"}']), None, None) for i in range(n)]
    return spark.createDataFrame(rows, schema.BLOCK)


def test_kept_index_equals_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "SEGMENTS", 3)
    path, block = str(tmp_path / "index"), some_blocks(spark, 1, 60, 12)
    marks = spark.range(12).select(F.col("id").alias("session_id"), F.lit(1).cast("long").alias("mark"))
    assert search.refresh(spark, path, block, marks) == 12 and search.refresh(spark, path, block, marks) == 0
    for turn in range(2, 6):  # sessions change, one goes; segments are merged on the way
        fresh = some_blocks(spark, turn, 60, 12)
        some = F.col("session_id") % 4 == turn % 4
        block = staged(block.where(~some).unionByName(fresh.where(some)).where(F.col("session_id") != turn), "blocks")
        marks = staged(marks.where(F.col("session_id") != turn).withColumn("mark", F.when(some, turn).otherwise(F.col("mark")).cast("long")), "marks")
        assert search.refresh(spark, path, block, marks) <= 12
        built = search.postings(block.select(F.col("id").alias("block_id"), *search.WEIGHTS), search.WEIGHTS)
        for query in ("alpha", '"alpha beta"', "gamma al", "erdo", "zeta-eta x", "cafe beta", "nothing"):
            got = search.page(spark, path, query, block, limit=100)
            assert [(r.block_id, r.score) for r in got.rows.collect()] == [tuple(r) for r in search.bm25(built, query).collect()]
    assert len(search._segments(store.manifest(spark, path))) <= 4


def test_a_query_reads_the_folders_of_its_terms(spark, tmp_path):
    path, block = str(tmp_path / "index"), some_blocks(spark, 3, 40, 4)
    search.refresh(spark, path, block, spark.range(4).select(F.col("id").alias("session_id"), F.lit(1).cast("long").alias("mark")))
    files = {f for f in search.kept_postings(spark, path, search.parse_query("alpha gam")).inputFiles() if "postings-" in f}
    at = store.manifest(spark, path)
    whole = {f for f in search.kept_postings(spark, path, search.parse_query("a")).inputFiles() if "postings-" in f}
    assert {f.split("folder=")[1].split("/")[0] for f in files} == {str(r.k) for r in spark.createDataFrame([("alp",), ("gam",)], "b string").select(store.folder_of(F.col("b"), at.folders).alias("k")).collect()}
    assert files < whole


def test_totals_are_capped_and_pages_follow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "COUNTED", 10)
    path, block = str(tmp_path / "index"), some_blocks(spark, 5, 80, 4)
    search.refresh(spark, path, block, spark.range(4).select(F.col("id").alias("session_id"), F.lit(1).cast("long").alias("mark")))
    got = search.page(spark, path, "alpha", block, limit=7)
    assert (got.total, got.is_capped) == (10, True) and got.rows.count() == 7
    few = search.page(spark, path, "alpha", block, visible=block.where("id < 9").select(F.col("id").alias("block_id")))
    assert not few.is_capped and few.total == few.rows.count() < 10
    nothing = search.page(spark, path, '""', block)
    assert (nothing.total, nothing.rows.count()) == (0, 0)


def test_snippets_show_phrases(spark):
    long = "w " * 30 + "the Alpha-Beta then Erdő ends " + "v " * 30
    rows = spark.createDataFrame([(1, long), (2, "none here"), (3, None)], "i int, text string")
    show = lambda q: [r[0] for r in rows.orderBy("i").select(search.snippet(F.col("text"), search.parse_query(q))).collect()]
    assert show('"alpha beta" x')[0] == "w w w w w the [Alpha-Beta] then Erdő ends v v"
    assert show('"erdo en"')[0] == "w w w the Alpha-Beta then [Erdő] [ends] v v v v"
    assert show("alpha")[1:] == [None, None]
    both = rows.select("i", search.matching_snippet([F.lit("first words"), F.col("text")], search.parse_query("alpha")).alias("s")).orderBy("i").collect()
    assert "[Alpha-Beta]" in both[0].s and [r.s for r in both[1:]] == ["first words", "first words"]


def test_index_of_an_archive(spark, tmp_path):
    logs, out, index = tmp_path / "logs", str(tmp_path / "archive"), str(tmp_path / "index")
    fx.write(logs / "a.jsonl", [fx.user("find the needle", fx.at(0), sessionId="a")])
    fx.write(logs / "b.jsonl", [fx.user("hay", fx.at(1), sessionId="b")])
    ingest.sync(spark, out, str(logs))
    assert search.archive_index(spark, index, out) == 2
    fx.write(logs / "b.jsonl", [fx.user("hay", fx.at(1), sessionId="b"), fx.user("needles", fx.at(2), sessionId="b")])
    os.utime(logs / "b.jsonl", (1_800_000_000, 1_800_000_000))
    ingest.sync(spark, out, str(logs))
    assert search.archive_index(spark, index, out) == 1 and search.archive_index(spark, index, out) == 0
    found = search.page(spark, index, "needle", ingest.load(spark, out).block)
    assert sorted(r.snippet for r in found.rows.collect()) == ["[needles]", "find the [needle]"]
