"""Where the archive and the transcripts are."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession

from sessionloom.staging import exists

# Where the producers keep their transcripts, in the user's home.
FIRST_HOME, SECOND_HOME = (".claude", "projects"), (".codex",)
SECOND_FOLDERS, SECOND_INDEX = ("sessions", "archived_sessions"), "session_index.jsonl"


@dataclass(frozen=True)
class Config:
    """Folders; ``sources`` that are given stand for the producers' own."""

    archive: str
    first_dir: str
    second_dir: str
    sources: tuple[str, ...] = ()
    sync: bool = True


def resolved(archive: str | None = None, first_dir: str | None = None, second_dir: str | None = None, sources: tuple[str, ...] = (), sync: bool = True, env: Mapping[str, str] | None = None, home: str | None = None) -> Config:
    """What is given, else what the environment says, else the folders in the user's home.  Reads
    sync first unless that is switched off by either."""
    env = os.environ if env is None else env
    home = home or os.path.expanduser("~") or "."
    place = lambda given, name, *parts: given if given is not None else env.get(name, os.path.join(home, *parts))
    return Config(
        place(archive, "SESSIONLOOM_ARCHIVE", ".sessionloom", "archive"),
        place(first_dir, "SESSIONLOOM_CLAUDE_DIR", *FIRST_HOME),
        place(second_dir, "SESSIONLOOM_CODEX_DIR", *SECOND_HOME),
        tuple(sources),
        sync and "SESSIONLOOM_NO_SYNC" not in env,
    )


def source_paths(spark: SparkSession, config: Config) -> list[str]:
    """The folders to list: those given, or of the producers' own those that are there."""
    if config.sources:
        return list(config.sources)
    return [p for p in (config.first_dir, *(f"{config.second_dir}/{f}" for f in SECOND_FOLDERS)) if exists(spark, p)]


def index_files(spark: SparkSession, config: Config) -> tuple[str, ...]:
    """The second producer's titles, if it keeps any."""
    path = f"{config.second_dir}/{SECOND_INDEX}"
    return (path,) if exists(spark, path) else ()
