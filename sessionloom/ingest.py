"""Transcripts to an archive of canonical tables, whole or by what has changed.

The tables lie in folders by a hash of the session, so a sync rewrites the folders of the
sessions it has read again and no others; their number doubles as the archive grows.  A
sync writes beside what is there and then swaps one manifest (``store``), so one that ends
early leaves the archive as it was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom import schema, store
from sessionloom.functions.cost import with_cost
from sessionloom.operators import context, enrich, user_state, worktree
from sessionloom.schema import Archive, shaped
from sessionloom.sources import manifest, transcripts
from sessionloom.staging import staged, unstage

_BY_SESSION = {"message": schema.MESSAGE, "block": schema.BLOCK, "tool_call": schema.TOOL_CALL, "file_ref": schema.FILE_REF, "issue": schema.ISSUE}
V = F.col


@dataclass
class Extracted:
    """Tables of single files, before sessions are linked."""

    session: DataFrame
    message: DataFrame
    block: DataFrame
    tool_call: DataFrame
    file_ref: DataFrame
    issue: DataFrame
    #: ``(path, session_id)`` of all files read, those too whose session another file gives.
    files: DataFrame | None = None


def empty_states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schema.USER_STATE)


def extract(spark: SparkSession, *paths: str, side_folders: tuple[str, ...] = (), index_files: tuple[str, ...] = ()) -> Extracted:
    """The tables that follow from each transcript by itself.

    ``side_folders`` are searched for the first producer's side files, ``index_files`` are
    the second producer's title indexes.
    """
    recs, files = transcripts.parsed(spark, *paths)
    said = staged(transcripts.messages(recs), "messages")
    blks = staged(transcripts.blocks(recs), "blocks")
    titles = transcripts.thread_titles(spark, *index_files) if index_files else None
    beside = transcripts.sidecars(spark, *side_folders) if side_folders else None
    session = staged(transcripts.sessions(recs, said, blks, titles, beside), "sessions")
    facts = staged(enrich.block_facts(blks), "block-facts")
    refs = staged(enrich.file_refs(blks, said, session), "file-refs")

    subs = session.select(V("id").alias("session_id"), "is_subagent")
    usage = [V(f"usage.{k}") for k in ("input", "cache_read", "cache_creation")]
    message = said.join(facts.select("session_id", "seq", "has_real_text"), ["session_id", "seq"], "left").join(subs, "session_id")
    message = message.select(
        F.xxhash64("session_id", "seq").alias("id"), "session_id", "seq", "role", "model", "stop_reason", "timestamp", "request_id", "source_uuid", "parent_source_uuid", usage[0].alias("input_tokens"),
        V("usage.output").alias("output_tokens"), usage[1].alias("cache_read_tokens"), usage[2].alias("cache_creation_tokens"), context.context_tokens(*usage).alias("context_tokens"), "is_sidechain", "is_compact_summary",
        enrich.is_boundary().alias("is_boundary"), enrich.is_turn(V("is_subagent")).alias("is_turn"), "subtype", "raw_type", "payload_role", "compact_trigger", "pre_tokens",
    )
    message = staged(shaped(message, schema.MESSAGE), "message")

    curve = context.rollups(message, session.withColumn("context_window_tokens", V("explicit_window_tokens")))
    s = session.join(enrich.facets(said, facts, session).drop("turn_count", "compaction_count"), session.id == V("session_id"), "left").drop("session_id")
    for more in (curve, enrich.outcomes(said, facts), enrich.work_types(said, blks, facts, refs)):
        s = s.join(more.withColumnRenamed("session_id", "_sid"), V("id") == V("_sid"), "left").drop("_sid")
    counts = ("error_count", "interruption_count", "sidechain_count", "agent_spawn_count", "skill_count", "command_count", "thinking_count", "thinking_bytes", "active_seconds", "turn_count", "compaction_count", "peak_context_tokens")
    s = with_cost(s.fillna(0, list(counts))).withColumn("project_id", F.when(V("cwd").isNotNull(), F.xxhash64("cwd"))).withColumn("parent_session_id", F.lit(None).cast("long")).withColumnRenamed("path", "source_path")
    blks = blks.withColumn("id", F.xxhash64("session_id", "seq", "ordinal"))
    return Extracted(
        staged(shaped(s, schema.SESSION), "session"), message, shaped(blks, schema.BLOCK), staged(shaped(transcripts.tool_calls(blks, said), schema.TOOL_CALL), "tool-call"), shaped(refs, schema.FILE_REF),
        staged(shaped(transcripts.issues(recs, blks), schema.ISSUE), "issue"), files,
    )


def projects(session: DataFrame, git_files: DataFrame | None = None) -> DataFrame:
    """One row for each working folder, with the root it belongs to."""
    p = session.where("project_id IS NOT NULL").groupBy("project_id").agg(F.first("cwd").alias("path"), F.min("started_at").alias("first_seen_at"), F.max("ended_at").alias("last_seen_at"))
    p = p.select(V("project_id").alias("id"), "path", worktree.base_name(V("path")).alias("name"), "first_seen_at", "last_seen_at")
    return shaped(worktree.with_roots(p, session, git_files), schema.PROJECT)


def build(spark: SparkSession, *paths: str, side_folders: tuple[str, ...] = (), index_files: tuple[str, ...] = (), states: DataFrame | None = None, git_files: DataFrame | None = None) -> Archive:
    """An archive of all transcripts under the paths.  Deleted sessions (``states``) and what
    hangs on them are refused."""
    x = extract(spark, *paths, side_folders=side_folders, index_files=index_files)
    states = empty_states(spark) if states is None else states
    x, states = _admitted(x, states)
    session = staged(shaped(enrich.with_parents(x.session, _with_tool(x.block, x.session)), schema.SESSION), "session")
    return Archive(projects(session, git_files), session, x.message, x.block, x.tool_call, x.file_ref, x.issue, states)


def _with_tool(block: DataFrame, session: DataFrame) -> DataFrame:
    uses = block.where("type IN ('tool_use', 'tool_result')").select("session_id", "seq", "ordinal", "type", "tool_name", "tool_use_id", "tool_result")
    return uses.join(session.select(V("id").alias("session_id"), "tool"), "session_id")


def _admitted(x: Extracted, states: DataFrame, known: DataFrame | None = None) -> tuple[Extracted, DataFrame]:
    """What isn't deleted, and the states with the tombstones that late sessions inherit."""
    states, refused = user_state.inherit(x.session, x.block, states, known)
    if refused.isEmpty():
        return x, states
    out = refused.select(V("id").alias("session_id"))
    keep = lambda df: df.join(out, "session_id", "left_anti")
    session = x.session.join(out, x.session.id == out.session_id, "left_anti")
    return Extracted(session, keep(x.message), keep(x.block), keep(x.tool_call), keep(x.file_ref), keep(x.issue), x.files), states


# Archives on disk.

_ALL = {**_BY_SESSION, "session": schema.SESSION}
_KEYS = dict.fromkeys(_BY_SESSION, "session_id") | {"session": "id", "link": "id", "source": "path"}
LINK = "id long, parent_session_id long, spawn_tool_use_id string"


def load(spark: SparkSession, path: str, at: store.Manifest | None = None) -> Archive:
    at = store.manifest(spark, path) if at is None else at
    tables = {name: store.read(spark, path, name, ddl, at) for name, ddl in schema.TABLES.items()}
    links = store.read(spark, path, "link", LINK, at)
    s = tables["session"].drop("parent_session_id").withColumnRenamed("spawn_tool_use_id", "_own")
    s = s.join(links, "id", "left").withColumn("spawn_tool_use_id", F.coalesce("_own", "spawn_tool_use_id"))
    return Archive(**{**tables, "session": shaped(s, schema.SESSION)})


def save(archive: Archive, path: str, folders: int | None = None) -> None:
    """Write a whole archive; it replaces what is there, at once."""
    spark = archive.session.sparkSession
    change = store.Change(spark, path, folders=folders)
    known = store.read(spark, path, "source", schema.SOURCE, change.before)
    for name, ddl in schema.TABLES.items():
        change.put(name, getattr(archive, name), ddl, _KEYS.get(name))
    change.put("link", archive.session, LINK, "id")
    if folders and change.before.tables.get("source"):
        change.put("source", known, schema.SOURCE, "path")
    change.commit()


@dataclass
class SyncReport:
    """What a sync did with the files that it found: ``scanned`` is ``ingested`` (read; of
    two files with one session both are), ``skipped`` (known as they are), ``refused``
    (deleted by the user) and ``empty`` (lines without anything).  Files of no bytes are not
    listed: they are read once something is in them."""

    scanned: int = 0
    ingested: int = 0
    skipped: int = 0
    refused: int = 0
    empty: int = 0
    issues: int = 0
    issues_by_code: dict[str, int] | None = None


def _folders_of(ids: DataFrame, column: str, folders: int) -> list[int]:
    """The folders of the keys, as many as there are folders at most."""
    return sorted(r.folder for r in ids.select(store.folder_of(V(column), folders).alias("folder")).distinct().collect())


def sync(spark: SparkSession, path: str, *sources: str, index_files: tuple[str, ...] = (), git_files: DataFrame | None = None) -> SyncReport:
    """Read the transcripts that are new or have changed, and put their sessions in the place
    of the former ones, all at once.  The archive at ``path`` may not be there yet."""
    at = store.manifest(spark, path)
    files = staged(manifest.listing(spark, *sources), "listing")
    known = store.read(spark, path, "source", schema.SOURCE, at)
    changed = staged(manifest.changed_files(files, known), "changed")
    report = SyncReport(scanned=files.count(), issues_by_code={})
    todo = [r.path for r in changed.select("path").toLocalIterator()]
    report.skipped = report.scanned - len(todo)
    if not todo:
        return report
    # Paths are names only; what they hold is read by tasks.
    x = extract(spark, *todo, side_folders=sources, index_files=index_files)
    old = load(spark, path, at)
    x, states = _admitted(x, staged(old.user_state, "states"), old.session)
    states = staged(states, "states")
    x.session = staged(x.session, "admitted")
    named = staged(changed.join(x.files, "path", "left"), "read-files")
    report.issues_by_code = {r.code: r["count"] for r in x.issue.groupBy("code").count().collect()}
    report.issues = sum(report.issues_by_code.values())

    new_ids = x.session.select(V("id").alias("session_id"))
    # Sessions whose file says something else now: all that the changed files gave before.
    gone = known.join(changed.select("path"), "path", "left_semi").select("session_id").where("session_id IS NOT NULL")
    touched = staged(new_ids.union(gone).union(user_state.deleted_sessions(old.session, states).select(V("id").alias("session_id"))).distinct(), "touched")
    total = sum(r["n"] for r in old.session.agg(F.count("*").alias("n")).collect()) + x.session.count()
    change = store.Change(spark, path, at, store.grown(at.folders, total))
    redealt = change.folders != at.folders
    folders = None if redealt or not at.tables else _folders_of(touched, "session_id", at.folders)
    for name, ddl in _ALL.items():
        key = _KEYS[name]
        before = store.read(spark, path, name, ddl, at, folders)
        kept = before.join(touched.select(V("session_id").alias(key)), key, "left_anti").select(before.columns)
        change.put(name, kept.unionByName(shaped(getattr(x, name), ddl)), ddl, key, folders)
    change.put("user_state", states, schema.USER_STATE)

    # The tables as the change leaves them, before it is valid.
    ahead = store.Manifest(change.before.number, change.folders, change.tables)
    session = store.read(spark, path, "session", schema.SESSION, ahead)
    links = store.read(spark, path, "link", LINK, at).join(touched.select(V("session_id").alias("id")), "id", "left_anti")
    block = store.read(spark, path, "block", schema.BLOCK, ahead)
    found = _links(session, links, block, touched, x)
    change.put("link", found, LINK, "id")
    change.put("project", projects(session, git_files), schema.PROJECT)
    lost = named.where("session_id IS NOT NULL").join(new_ids, "session_id", "left_anti").select("path", F.lit(True).alias("lost"))
    odd = x.issue.select(V("source_path").alias("path"), F.lit(True).alias("odd")).distinct()
    status = F.when(V("session_id").isNull(), "empty").when(V("lost"), "skipped_deleted").when(V("odd"), "ok_with_issues").otherwise("ok")
    read = named.join(lost, "path", "left").join(odd, "path", "left").withColumn("status", status)
    read = staged(read.select("path", "tool", "size", "mtime", F.lit(manifest.REVISION).alias("revision"), F.when(~V("status").isin("skipped_deleted"), V("session_id")).alias("session_id"), "status"), "read")
    said = {r.status: r["count"] for r in read.groupBy("status").count().collect()}
    report.refused, report.empty = said.get("skipped_deleted", 0), said.get("empty", 0)
    report.ingested = len(todo) - report.refused - report.empty
    change.put("source", known.join(changed.select("path"), "path", "left_anti").unionByName(shaped(read, schema.SOURCE)), schema.SOURCE, "path")
    change.commit()
    for df in (files, changed, states, x.session, named, touched, read):
        unstage(df)
    return report


def _links(session: DataFrame, links: DataFrame, block: DataFrame, touched: DataFrame, x: Extracted) -> DataFrame:
    """Links of all sessions: those that stand, and those of subagents that are new, that have
    no parent, whose parent or root was read again, or whose tool use was."""
    subs = session.where("is_subagent").select("id", "tool", "source_session_id", "root_source_session_id", "spawn_tool_use_id")
    known = subs.join(links.select("id", "parent_session_id", V("spawn_tool_use_id").alias("found_use")), "id", "left")
    again = touched.select(V("session_id").alias("again"))
    roots = x.session.select("tool", F.explode(F.array_compact(F.array("source_session_id", "root_source_session_id"))).alias("root_source_session_id")).distinct()
    uses = x.block.where("type = 'tool_use' AND tool_use_id IS NOT NULL").select(V("tool_use_id").alias("use")).distinct()
    use = F.coalesce("spawn_tool_use_id", "found_use")
    openly = known.where("parent_session_id IS NULL").select("id")
    openly = openly.union(known.join(again, V("id") == V("again"), "left_semi").select("id")).union(known.join(again, V("parent_session_id") == V("again"), "left_semi").select("id"))
    openly = staged(openly.union(known.join(roots, ["tool", "root_source_session_id"], "left_semi").select("id")).union(known.join(uses, use == V("use"), "left_semi").select("id")).distinct(), "open-links")
    if openly.isEmpty():
        return session.select("id").join(links, "id", "left")
    linked = enrich.with_parents(session.drop("parent_session_id"), _with_tool(block, session), openly).join(openly, "id", "left_semi").select("id", "parent_session_id", "spawn_tool_use_id")
    rest = session.select("id").join(openly, "id", "left_anti").join(links, "id", "left")
    return rest.select("id", "parent_session_id", "spawn_tool_use_id").unionByName(linked)


def set_state(spark: SparkSession, path: str, session_id: int, state: str) -> bool:
    """``archived``, ``visible`` or ``deleted``.  False if there is no such session."""
    at = store.manifest(spark, path)
    archive = load(spark, path, at)
    if archive.session.where(V("id") == session_id).isEmpty():
        return False
    states, removed = user_state.set_state(archive.session, archive.block, archive.user_state, session_id, state)
    removed = staged(removed, "removed")
    change = store.Change(spark, path, at)
    folders = _folders_of(removed, "id", at.folders)
    if folders:
        for name, ddl in _ALL.items():
            rows = store.read(spark, path, name, ddl, at, folders)
            change.put(name, rows.join(removed.select(V("id").alias(_KEYS[name])), _KEYS[name], "left_anti"), ddl, _KEYS[name], folders)
        links = store.read(spark, path, "link", LINK, at).join(removed, "id", "left_anti")
        parents = removed.select(V("id").alias("parent_session_id"), F.lit(True).alias("gone"))
        change.put("link", links.join(parents, "parent_session_id", "left").withColumn("parent_session_id", F.when(V("gone").isNull(), V("parent_session_id"))), LINK, "id")
        known = store.read(spark, path, "source", schema.SOURCE, at).join(removed.select(V("id").alias("session_id"), F.lit(True).alias("gone")), "session_id", "left")
        change.put("source", known.withColumn("status", F.when(V("gone"), "skipped_deleted").otherwise(V("status"))).withColumn("session_id", F.when(V("gone").isNull(), V("session_id"))), schema.SOURCE, "path")
    change.put("user_state", states, schema.USER_STATE)
    change.commit()
    unstage(removed)
    return True


def info(spark: SparkSession, path: str) -> dict:
    """Schema version and row counts."""
    at = store.manifest(spark, path)
    counts = {name: store.read(spark, path, name, ddl, at).count() for name, ddl in schema.TABLES.items() if name in ("session", "message", "tool_call")}
    return {"path": path, "schema_version": schema.SCHEMA_VERSION, **counts}


def compact(spark: SparkSession, path: str) -> None:
    """Write every table anew, each folder in as few files as one change writes."""
    at = store.manifest(spark, path)
    save(load(spark, path, at), path, at.folders)
