"""What messages and blocks say of their session: files, counters, turns, outcome, kind of work.

All are aggregates by session over narrow columns; texts never leave their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.functions.records import epoch_seconds, text_at, trimmed

# How interruptions begin, and what commands hold.
INTERRUPTION = "[Request interrupted by user"
COMMAND = "<command-name>"
GAP_SECONDS = 300
# Tools that name a file in their input: its key and the operation.
FILE_TOOLS = {"Read": ("file_path", "read"), "Edit": ("file_path", "edit"), "Write": ("file_path", "write"), "NotebookEdit": ("notebook_path", "edit")}
# Headers of a patch.
PATCH_HEADERS = (("*** Add File: ", "write"), ("*** Update File: ", "edit"), ("*** Delete File: ", "delete"))
# Words (or phrases) of a first prompt and the work they stand for, the first kind that has one.
WORK_WORDS = (
    ("debugging", ("fix", "fixes", "fixing", "fixed", "bug", "bugs", "fail", "fails", "failing", "failed", "failure", "error", "errors", "broken", "crash", "crashes", "crashing", "regression", "debug", "debugging")),
    ("refactor", ("refactor", "refactoring", "rename", "renaming", "simplify", "clean up", "cleanup", "reorganize", "extract")),
    ("research", ("research", "investigate", "compare", "should we", "look into", "evaluate", "explore whether")),
    ("ops", ("deploy", "deploying", "install", "installing", "configure", "configuring", "release", "ci", "pipeline", "provision", "upgrade", "upgrading")),
    ("feature", ("implement", "implementing", "add", "adding", "build", "building", "create", "creating", "write a", "new feature", "support for")),
)
PROMPT_LENGTH = 400
V = F.col


# Files.


def relative_path(path: Column, cwd: Column) -> Column:
    """Relative to the working folder; null for absolute paths outside of it."""
    root = F.concat(F.regexp_replace(cwd, "/+$", ""), F.lit("/"))
    inside = F.nullif(F.substring(path, F.length(root) + 1, F.length(path)), F.lit(""))
    return F.when(~path.startswith("/"), path).when(path.startswith(root), inside)


def extension(path: Column) -> Column:
    """In lower case; null without one, and for names that begin with their only dot."""
    leaf = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.nullif(F.regexp_extract(leaf, r"(?s)^.+\.([^.]+)$", 1), F.lit("")))


def file_refs(blks: DataFrame, msgs: DataFrame, session: DataFrame) -> DataFrame:
    """One row for each file that a tool's input names: ``(session_id, seq, path, rel_path, ext,
    operation, timestamp)``, with the order ``(ordinal, nth)`` within a message."""
    uses = blks.where("type = 'tool_use' AND tool_input IS NOT NULL").withColumn("v", F.try_parse_json("tool_input"))
    pick = F.lit(None).cast("struct<path: string, operation: string>")
    for tool, (key, operation) in FILE_TOOLS.items():
        found = text_at(V("v"), f"$.{key}")
        pick = F.when((V("tool_name") == tool) & found.isNotNull(), F.struct(found.alias("path"), F.lit(operation).alias("operation"))).otherwise(pick)
    first = uses.where("tool = 'claude_code'").where(V("tool_name").isin(*FILE_TOOLS)).select("session_id", "seq", "ordinal", F.lit(0).alias("nth"), pick.alias("f")).where("f IS NOT NULL")
    patches = uses.where("tool = 'codex' AND tool_name = 'apply_patch'").select("session_id", "seq", "ordinal", F.posexplode(F.split(text_at(V("v"), "$"), "\n")).alias("nth", "line"))
    operation, path = F.lit(None).cast("string"), F.lit(None).cast("string")
    for header, kind in PATCH_HEADERS:
        hit = V("line").startswith(header)
        operation, path = F.when(hit, kind).otherwise(operation), F.when(hit, trimmed(F.substring(V("line"), len(header) + 1, 1 << 20))).otherwise(path)
    second = patches.select("session_id", "seq", "ordinal", "nth", F.struct(path.alias("path"), operation.alias("operation")).alias("f")).where("f.operation IS NOT NULL AND f.path <> ''")
    refs = first.unionByName(second).select("session_id", "seq", "ordinal", "nth", "f.path", "f.operation")
    refs = refs.join(msgs.select("session_id", "seq", "timestamp"), ["session_id", "seq"]).join(session.select(V("id").alias("session_id"), "cwd"), "session_id")
    return refs.select(
        F.xxhash64("session_id", "seq", "ordinal", "nth").alias("id"), "session_id", "seq", "ordinal", "nth", "path", relative_path(V("path"), V("cwd")).alias("rel_path"), extension(V("path")).alias("ext"), "operation", "timestamp"
    )


# Counters.


def real_text(text: Column) -> Column:
    """Neither an interruption nor a command nor blank."""
    t = F.coalesce(text, F.lit(""))
    return ~t.startswith(INTERRUPTION) & ~t.contains(COMMAND) & (trimmed(t) != "")


def block_facts(blks: DataFrame) -> DataFrame:
    """One row for each message with blocks: counts of what its blocks are."""
    t = F.coalesce("text", F.lit(""))
    is_text = V("type") == "text"
    cut = is_text & t.startswith(INTERRUPTION)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return blks.groupBy("session_id", "seq").agg(
        count(cut).alias("interruptions"), count(is_text & ~cut & t.contains(COMMAND)).alias("commands"), (count(is_text & real_text(V("text"))) > 0).alias("has_real_text"),
        count(V("type") == "thinking").alias("thoughts"), F.sum(F.when(V("type") == "thinking", F.octet_length(t)).otherwise(0)).cast("long").alias("thought_bytes"),
        count((V("type") == "tool_use") & V("tool_name").isin("Agent", "Task")).alias("spawns"), count((V("type") == "tool_use") & (V("tool_name") == "Skill")).alias("skills"),
        count((V("type") == "tool_result") & V("is_error")).alias("errors"),
        count((V("type") == "web_search") | ((V("type") == "tool_use") & V("tool_name").isin("WebSearch", "WebFetch"))).alias("web_searches"),
        count(is_text & (trimmed(t) != "")).alias("spoken"),
    )


def is_boundary() -> Column:
    """Both producers' marks of a compaction."""
    return F.coalesce(V("subtype") == "compact_boundary", F.lit(False)) | F.coalesce(V("raw_type") == "compacted", F.lit(False))


def is_turn(session_is_subagent: Column) -> Column:
    """A user message with real text that isn't a copied row of a subagent or a machine's summary."""
    return (V("role") == "user") & F.coalesce("has_real_text", F.lit(False)) & (~V("is_sidechain") | session_is_subagent) & ~V("is_compact_summary")


def facets(msgs: DataFrame, facts: DataFrame, session: DataFrame) -> DataFrame:
    """Eleven counters for each session; ``facts`` are those of ``block_facts``."""
    at = epoch_seconds(V("timestamp"))
    rows = msgs.join(facts, ["session_id", "seq"], "left").join(session.select(V("id").alias("session_id"), "is_subagent"), "session_id").withColumn("at", at)
    # The last timestamp before, over messages without one.
    before = F.last("at", ignorenulls=True).over(W.partitionBy("session_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("gap", V("at") - before)
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.groupBy("session_id").agg(
        F.count_if(is_turn(V("is_subagent"))).alias("turn_count"), n("errors").alias("error_count"), n("interruptions").alias("interruption_count"), F.count_if(is_boundary()).alias("compaction_count"),
        F.count_if("is_sidechain").alias("sidechain_count"), n("spawns").alias("agent_spawn_count"), n("skills").alias("skill_count"), n("commands").alias("command_count"), n("thoughts").alias("thinking_count"),
        n("thought_bytes").alias("thinking_bytes"), n(F.when(V("gap") > 0, F.least("gap", F.lit(GAP_SECONDS)))).alias("active_seconds"),
    )


# Outcome and kind of work.


def outcomes(msgs: DataFrame, facts: DataFrame) -> DataFrame:
    """``(session_id, outcome)``, over messages that aren't copied rows of subagents.

    An interruption among the last three: abandoned.  Else the last message of a user, an
    assistant or a tool decides: a user's, a tool's without an error and one that calls a
    tool are abandoned, a tool's error failed, other replies completed.
    """
    main = msgs.where("NOT is_sidechain").join(facts.select("session_id", "seq", "interruptions", "errors"), ["session_id", "seq"], "left")
    spoke = V("role").isin("user", "assistant", "tool")
    nth = F.row_number().over(W.partitionBy("session_id").orderBy(V("seq").desc()))
    last = F.max_by(F.struct("role", "stop_reason", "errors"), F.when(spoke, V("seq"))).alias("last")
    ends = main.withColumn("nth", nth).groupBy("session_id").agg(F.bool_or((V("nth") <= 3) & (F.coalesce("interruptions", F.lit(0)) > 0)).alias("cut"), last, F.max(F.when(spoke, True)).alias("any"))
    role = V("last.role")
    end = F.when(role == "tool", F.when(F.coalesce("last.errors", F.lit(0)) > 0, "failed").otherwise("abandoned")).when((role == "user") | (V("last.stop_reason") == "tool_use"), "abandoned").otherwise("completed")
    return ends.select("session_id", F.when(V("cut"), "abandoned").when(V("any"), end).alias("outcome"))


def word_kind(prompt: Column) -> Column:
    """The kind of work that the beginning of a prompt names."""
    head = F.substring(F.lower(prompt), 1, PROMPT_LENGTH)
    words = F.split(head, r"[^\p{L}\p{N}]+")
    out = None
    for kind, keys in WORK_WORDS:
        hit = F.arrays_overlap(words, F.array(*[F.lit(k) for k in keys if " " not in k]))
        for k in keys:
            if " " in k:
                hit |= head.contains(k)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def work_types(msgs: DataFrame, blks: DataFrame, facts: DataFrame, refs: DataFrame) -> DataFrame:
    """``(session_id, work_type)``: by the first real prompt, else by what was done to files."""
    head = F.substring("text", 1, PROMPT_LENGTH * 2).alias("head")  # lower case may be longer or shorter
    said = blks.where("type = 'text'").where(real_text(V("text"))).select("session_id", "seq", "ordinal", head)
    prompts = said.join(msgs.where("role = 'user'").select("session_id", "seq"), ["session_id", "seq"], "left_semi").groupBy("session_id").agg(F.min_by("head", F.struct("seq", "ordinal")).alias("prompt"))
    count = lambda op: F.count_if(V("operation") == op)
    files = refs.groupBy("session_id").agg(count("read").alias("reads"), count("edit").alias("edits"), count("write").alias("writes"), count("delete").alias("deletes"))
    webs = facts.groupBy("session_id").agg(F.sum("web_searches").alias("webs"))
    n = lambda c: F.coalesce(c, F.lit(0))
    mutations = n("edits") + n("writes") + n("deletes")
    mix = F.when((mutations == 0) & ((n("reads") > 0) | (n("webs") > 0)), "research").when((n("edits") > 0) | (n("writes") > 0), "feature")
    out = msgs.select("session_id").distinct()
    for more in (prompts, files, webs):
        out = out.join(more, "session_id", "left")
    return out.select("session_id", F.coalesce(word_kind(V("prompt")), mix).alias("work_type"))


# Subagents.


def with_parents(session: DataFrame, blks: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """``session`` with ``parent_session_id`` of its subagents, and with what can be inferred of
    how they were spawned where nothing was said.

    The root is the session whose id a subagent names.  The spawner is the session that holds
    the tool use which spawned it (subagents first, then the newest use); the second
    producer's is found by the child's id in the result of a ``spawn_agent`` call of the root.
    With ``only(id)``, parents of those subagents alone are sought.
    """
    out = session.drop("parent_session_id")
    subs = out.where("is_subagent")
    subs = (subs if only is None else subs.join(only, "id", "left_semi")).select("id", "tool", "source_session_id", V("root_source_session_id").alias("root_key"), V("spawn_tool_use_id").alias("use_id"))
    named = out.select("tool", V("source_session_id").alias("root_key"), V("id").alias("by_id"))
    # A main session may go by the id its records give it, another one than its file's name.
    main = out.where("NOT is_subagent AND root_source_session_id IS NOT NULL").groupBy("tool", V("root_source_session_id").alias("root_key")).agg(F.max("id").alias("by_record"))
    subs = subs.join(named, ["tool", "root_key"], "left").join(main, ["tool", "root_key"], "left").withColumn("root_id", F.coalesce("by_record", "by_id")).drop("by_id", "by_record")
    calls = blks.where("type = 'tool_use' AND tool_name = 'spawn_agent'").select("session_id", "tool_use_id", "seq", "ordinal")
    told = blks.where("type = 'tool_result' AND tool = 'codex'").join(calls, ["session_id", "tool_use_id"], "left_semi").select("session_id", "tool_use_id", V("tool_result").alias("told"))
    told = told.join(calls, ["session_id", "tool_use_id"])
    seeking = subs.where("tool = 'codex' AND use_id IS NULL AND root_id IS NOT NULL")
    hits = seeking.join(told, (V("root_id") == V("session_id")) & F.lower("told").contains(F.lower("source_session_id")))
    found = hits.groupBy("id").agg(F.max_by("tool_use_id", F.struct("seq", "ordinal")).alias("found_use"))
    subs = subs.join(found, "id", "left").withColumn("use_id", F.coalesce("use_id", "found_use")).drop("found_use")
    wanted = subs.where("use_id IS NOT NULL").select("use_id").distinct()
    uses = blks.where("type = 'tool_use'").join(wanted, blks.tool_use_id == wanted.use_id, "left_semi").select("session_id", V("tool_use_id").alias("use_id"), "seq", "ordinal")
    owners = uses.join(out.select(V("id").alias("session_id"), V("is_subagent").alias("sub"), V("started_at").alias("began")), "session_id")
    spawner = owners.groupBy("use_id").agg(F.max_by("session_id", F.struct("sub", "began", "session_id", "seq", "ordinal")).alias("spawner"))
    subs = subs.join(spawner, "use_id", "left")
    parent = F.coalesce(F.when(V("spawner") != V("id"), V("spawner")), "root_id")
    links = subs.select("id", F.when(parent != V("id"), parent).alias("parent_session_id"), V("use_id").alias("found_use"))
    joined = out.join(links, "id", "left").withColumn("spawn_tool_use_id", F.coalesce("spawn_tool_use_id", "found_use")).drop("found_use")
    return joined
