"""Intermediate tables that outlive lost executors: written to the folder that driver
and executors share, and read back."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session.  Only a local session without
    that setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.environ.get("SESSIONLOOM_SCRATCH") or tempfile.mkdtemp(prefix="sessionloom-")
    os.environ["SESSIONLOOM_SCRATCH"] = own
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(own)
    return f"file://{own}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/sessionloom/{uuid.uuid4().hex}-{label}"


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    files, p = _file_system(spark, path)
    return files.exists(p)


def make_dir(spark: SparkSession, path: str) -> str:
    """Make a folder that may stay empty."""
    files, p = _file_system(spark, path)
    files.mkdirs(p)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a
    lost executor costs a re-read instead of a re-computation."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    path = getattr(df, "_staged_at", None)
    if path:
        files, p = _file_system(df.sparkSession, path)
        files.delete(p, True)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_sessionloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    zipped = Path(tempfile.mkdtemp(prefix="sessionloom-code-")) / "sessionloom_code.zip"
    with zipfile.ZipFile(zipped, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("sessionloom") / p.relative_to(root))
    sc.addPyFile(str(zipped))
    sc._sessionloom_shipped = True
