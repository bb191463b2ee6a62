"""Which files a sync has to read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REVISION = 2


def local_path(uri: Column) -> Column:
    """The path of a local file; other stores keep their URI."""
    return F.regexp_replace(uri, "^file:/+", "/")


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file's name without its last extension."""
    return F.regexp_replace(name_of(path), r"(?<=.)\.[^.]*$", "")


def listing(spark: SparkSession, *paths: str) -> DataFrame:
    """``(path, size, mtime, tool, is_archived)`` of the transcripts under the paths, each once.
    Files are listed, not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(list(paths))
    rows = found.select(local_path(F.col("_metadata.file_path")).alias("path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime")).dropDuplicates(["path"])
    return with_tool(rows)


def with_tool(files: DataFrame) -> DataFrame:
    """Transcripts only: side files are left out; rollouts belong to the second producer, those
    in a folder ``archived_sessions`` are archived."""
    name = name_of(F.col("path"))
    rows = files.where(name.endswith(".jsonl") & ~name.isin("session_index.jsonl", "journal.jsonl"))
    rows = rows.withColumn("tool", F.when(name.startswith("rollout-"), "codex").otherwise("claude_code"))
    return rows.withColumn("is_archived", (F.col("tool") == "codex") & F.array_contains(F.split("path", r"[\\/]+"), "archived_sessions"))


def changed_files(files: DataFrame, manifest: DataFrame, revision: int = REVISION) -> DataFrame:
    """Files that the manifest ``(path, size, mtime, revision)`` doesn't know as they are."""
    same = manifest.where(F.col("revision") == revision).select("path", "size", "mtime")
    return files.join(same, ["path", "size", "mtime"], "left_anti")


def content_facts(spark: SparkSession, *paths: str) -> DataFrame:
    """``(path, hash, line_count)``: SHA-256 of the content, and its lines without one for a
    last line end.  Files up to 2 GB."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(list(paths))
    text = F.col("content").cast("string")
    ends = F.regexp_count(text, F.lit("\n"))
    count = F.when(F.octet_length("content") == 0, 0).when(text.endswith("\n"), ends).otherwise(ends + 1)
    return found.select(local_path(F.col("_metadata.file_path")).alias("path"), F.sha2("content", 256).alias("hash"), count.cast("long").alias("line_count"))
