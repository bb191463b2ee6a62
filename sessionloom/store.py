"""Tables on disk that change as a whole or not at all.

A store is a folder of tables.  A table's rows lie in folders by a hash of their key, each
folder in a generation: ``table/store_generation=G/store_folder=K``.  A manifest names the generation
in which each folder is valid.  A change writes new folders beside the old ones and then
one new manifest; until that is there, readers see the store as it was, and whatever a
change left behind that ended early is never read.  Folders that neither the newest
manifest nor the one before it names are deleted after a change, so readers that began
under the former manifest can finish.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.schema import shaped
from sessionloom.staging import _file_system

#: Folders of a new store, and keys of a folder on average before their number is doubled.
FOLDERS, KEYS_PER_FOLDER = 64, 512
#: Files that a folder's rows are written to at most by one change.
PARTS = 8
MANIFESTS = "_manifest"


class Conflict(RuntimeError):
    """Another change was completed meanwhile."""


@dataclass
class Manifest:
    """``tables``: by table and folder, the generation that holds it."""

    number: int = 0
    folders: int = FOLDERS
    tables: dict[str, dict[str, str]] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    files, p = _file_system(spark, f"{path}/{MANIFESTS}")
    if not files.exists(p):
        return []
    names = [s.getPath().getName() for s in files.listStatus(p)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def manifest(spark: SparkSession, path: str) -> Manifest:
    """The newest manifest; an empty one where there is no store yet."""
    known = _numbers(spark, path)
    if not known:
        return Manifest()
    return _read(spark, path, known[-1])


def _read(spark: SparkSession, path: str, number: int) -> Manifest:
    files, p = _file_system(spark, f"{path}/{MANIFESTS}/{number:08d}.json")
    stream = files.open(p)
    try:
        return Manifest(**json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def folder_of(key: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(folders)).cast("int")


def read(spark: SparkSession, path: str, name: str, ddl: str, at: Manifest | None = None, folders: list[int] | None = None) -> DataFrame:
    """A table's rows; with ``folders``, only those folders are listed and read."""
    at = manifest(spark, path) if at is None else at
    valid = at.tables.get(name, {})
    names = [f"{path}/{name}/store_generation={g}/store_folder={k}" for k, g in sorted(valid.items()) if folders is None or int(k) in folders]
    if not names:
        return spark.createDataFrame([], ddl)
    found = spark.read.schema(f"{ddl}, store_generation string, store_folder int").option("basePath", f"{path}/{name}").parquet(*names)
    return shaped(found, ddl)


class Change:
    """New folders of some tables, which one commit makes valid together."""

    def __init__(self, spark: SparkSession, path: str, at: Manifest | None = None, folders: int | None = None):
        self.spark, self.path = spark, path
        self.before = manifest(spark, path) if at is None else at
        self.folders = folders or self.before.folders
        self.generation = f"{self.before.number + 1:08d}-{uuid.uuid4().hex[:8]}"
        self.tables = {name: dict(valid) for name, valid in self.before.tables.items()}
        self.facts = dict(self.before.facts)

    def put(self, name: str, rows: DataFrame, ddl: str, key: str | None = None, folders: list[int] | None = None, sort: list[str] | None = None, spread: str | None = None) -> None:
        """``rows`` in the place of the table's ``folders``, or of the whole table; a table
        without a key is one folder.  Folders that get no rows are empty from now on.  Rows
        of a folder are dealt to ``PARTS`` files by ``spread`` (the key, if it isn't named),
        and sorted in each if ``sort`` says how."""
        rows = shaped(rows, ddl)
        at = rows.withColumn("store_folder", folder_of(F.col(key), self.folders) if key else F.lit(0))
        if key:
            at = at.repartition("store_folder", F.pmod(F.xxhash64(spread or key, F.lit(1)), F.lit(PARTS)))
            if sort:
                at = at.sortWithinPartitions("store_folder", *sort)
        target = f"{self.path}/{name}/store_generation={self.generation}"
        at.write.partitionBy("store_folder").parquet(target)
        files, p = _file_system(self.spark, target)
        written = {s.getPath().getName().removeprefix("store_folder="): self.generation for s in files.listStatus(p) if s.isDirectory()}
        kept = {} if folders is None else {k: g for k, g in self.tables.get(name, {}).items() if int(k) not in folders}
        self.tables[name] = kept | written

    def commit(self) -> Manifest:
        """Make the change valid, then delete what nobody reads any more."""
        out = Manifest(self.before.number + 1, self.folders, self.tables, self.facts)
        files, final = _file_system(self.spark, f"{self.path}/{MANIFESTS}/{out.number:08d}.json")
        _, part = _file_system(self.spark, f"{self.path}/{MANIFESTS}/.{out.number:08d}.{uuid.uuid4().hex}")
        stream = files.create(part)
        try:
            stream.write(bytearray(json.dumps(out.__dict__).encode()))
        finally:
            stream.close()
        if files.exists(final) or not files.rename(part, final):
            files.delete(part, False)
            raise Conflict(f"{self.path}: change {out.number} was completed by another")
        _clean(self.spark, self.path, out, self.before)
        return out


def _clean(spark: SparkSession, path: str, *valid: Manifest) -> None:
    for name in {n for m in valid for n in m.tables}:
        used = {f"store_generation={g}" for m in valid for g in m.tables.get(name, {}).values()}
        files, p = _file_system(spark, f"{path}/{name}")
        for s in files.listStatus(p) if files.exists(p) else ():
            g = s.getPath().getName()
            if g.startswith("store_generation=") and g not in used:
                files.delete(s.getPath(), True)
            elif g.startswith("store_generation="):
                live = {f"store_folder={k}" for m in valid for k, x in m.tables.get(name, {}).items() if g == f"store_generation={x}"}
                for f in files.listStatus(s.getPath()):
                    if f.getPath().getName().startswith("store_folder=") and f.getPath().getName() not in live:
                        files.delete(f.getPath(), True)
    keep = {m.number for m in valid}
    for n in _numbers(spark, path):
        if n not in keep and n < max(keep):
            files, p = _file_system(spark, f"{path}/{MANIFESTS}/{n:08d}.json")
            files.delete(p, False)


def grown(folders: int, keys: int) -> int:
    """The number of folders for so many keys: doubled until a folder has few enough."""
    while keys > folders * KEYS_PER_FOLDER:
        folders *= 2
    return folders
