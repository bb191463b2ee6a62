"""Shared pieces of the training-data operators: staging, shipping, text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionloom.staging import make_dir, scratch_path, shared_dir, ship, staged, unstage

__all__ = ["WORD", "make_dir", "scratch_path", "shared_dir", "ship", "staged", "table", "unstage"]

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
