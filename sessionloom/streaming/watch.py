"""Transcripts kept in step with an archive by Structured Streaming.

Transcripts grow in place, and Spark's file source looks at a path once: it never sees
what is appended to a file that it knows.  So the stream carries ticks, one micro-batch at
each trigger, and each batch syncs: files whose size or time differ from the archive's
own listing are read again.  Ticks that pass while a sync runs are one tick, which is all
that a debounce would do.  The checkpoint keeps the tick's offset; what has been read is
kept by the archive itself, in the same change as the rows, so a batch that is repeated
after a failure reads nothing twice and loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sessionloom import ingest
from sessionloom.config import Config, index_files, source_paths

#: Seconds between two looks at the files.
EVERY = 45


def ticks(spark: SparkSession) -> DataFrame:
    """A row for each micro-batch."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()


def watch(
    spark: SparkSession,
    path: str,
    *sources: str,
    checkpoint: str,
    every: int | None = EVERY,
    index_files: tuple[str, ...] = (),
    on_report: Callable[[int, ingest.SyncReport], None] | None = None,
) -> StreamingQuery:
    """Keep the archive at ``path`` in step with the transcripts under ``sources``.

    A look every ``every`` seconds until the query is stopped; with None, one look and an
    end.  ``on_report`` gets the number of each batch and what its sync did."""

    def look(_: DataFrame, batch: int) -> None:
        report = ingest.sync(spark, path, *sources, index_files=index_files)
        if on_report is not None:
            on_report(batch, report)

    out = ticks(spark).writeStream.foreachBatch(look).option("checkpointLocation", checkpoint)
    out = out.trigger(availableNow=True) if every is None else out.trigger(processingTime=f"{every} seconds")
    return out.start()


def refreshed(spark: SparkSession, path: str, *sources: str, sync: bool = True):
    """The archive for a read, synced before unless that is switched off."""
    if sync:
        ingest.sync(spark, path, *sources)
    return ingest.load(spark, path)


def opened(spark: SparkSession, config: Config):
    """The archive that a configuration names, synced before if it says so and there is
    anything to read."""
    paths = source_paths(spark, config) if config.sync else []
    if paths:
        ingest.sync(spark, config.archive, *paths, index_files=index_files(spark, config))
    return ingest.load(spark, config.archive)
