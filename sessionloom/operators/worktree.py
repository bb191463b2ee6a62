"""Which projects are working copies of others, by their paths.

Paths are classified by expressions.  A copy in a tool's own container is matched to the
known root whose name its leaf begins with: all beginnings of the leaf are joined to the
names, so no path is compared with every root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Folders of copies inside of a project, and who makes them.
INTREE = {".worktrees": "git", ".claude-worktrees": "claude", ".codex-worktrees": "codex"}
# Containers outside, by their own name, and by their name and their parent's.
CONTAINERS = {".warp-worktrees": "warp", ".t3-worktrees": "t3", ".codex-worktrees": "codex"}
NESTED = {("conductor", "workspaces"): "conductor", (".warp", "worktrees"): "warp", (".codex", "worktrees"): "codex"}
RESOLUTION = "struct<is_worktree: boolean, root_path: string, worktree_label: string, worktree_tool: string, root_source: string>"
V = F.col


def parts_of(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def base_name(path: Column) -> Column:
    return F.coalesce(F.get(F.reverse(parts_of(path)), F.lit(0)), path)


def _joined(path: Column, parts: Column) -> Column:
    return F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))


def _first_true(tests: Column) -> Column:
    """The index of the first true element, -1 without one."""
    return F.array_position(tests, F.lit(True)) - 1


def _map(values: dict[str, str], key: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def _resolution(root: Column, label: Column, tool: Column, source: Column, is_copy: bool = True) -> Column:
    return F.struct(F.lit(is_copy).alias("is_worktree"), root.alias("root_path"), label.alias("worktree_label"), tool.alias("worktree_tool"), source.alias("root_source")).cast(RESOLUTION)


def intree(path: Column) -> Column:
    """The resolution of a copy inside of its project, else null."""
    parts = parts_of(path)
    at = _first_true(F.transform(parts, lambda x: x.isin(*INTREE)))
    root, label = F.slice(parts, F.lit(1), at), F.array_join(F.slice(parts, at + 2, F.size(parts)), "/")
    return F.when((at > 0) & (at + 1 < F.size(parts)), _resolution(_joined(path, root), label, _map(INTREE, F.get(parts, at)), F.lit("intree")))


def container(path: Column) -> Column:
    """``struct<tool, leaf>`` of a copy in a tool's container, else null."""
    parts = parts_of(path)

    def owner(x: Column, i: Column) -> Column:
        out = _map(CONTAINERS, x)
        for (parent, name), tool in NESTED.items():
            out = F.when((x == name) & (i > 0) & (F.get(parts, i - 1) == parent), tool).otherwise(out)
        return out

    owners = F.transform(parts, owner)
    at = _first_true(F.transform(owners, lambda x: x.isNotNull()))
    one, two = F.get(parts, at + 1), F.get(parts, at + 2)
    leaf = F.when(F.get(parts, at) == "worktrees", F.concat(one, F.lit("-"), two)).otherwise(one)
    return F.when((at >= 0) & leaf.isNotNull(), F.struct(F.get(owners, at).alias("tool"), leaf.alias("leaf")))


def infer_tool(path: Column) -> Column:
    parts = parts_of(path)
    return F.coalesce(container(path)["tool"], F.when(F.array_contains(parts, ".claude-worktrees"), "claude").when(F.array_contains(parts, ".codex-worktrees"), "codex").otherwise("git"))


def strip_codename(tool: Column, leaf: Column) -> Column:
    """The leaf without the name that the tool made up."""
    tokens = F.split(leaf, "-")
    n = F.size(tokens)
    less = lambda k: F.array_join(F.slice(tokens, F.lit(1), n - k), "-")
    return (
        F.when((tool == "t3") & leaf.contains("-t3code-"), F.substring_index(leaf, "-t3code-", 1)).when((tool == "warp") & (n >= 3), less(2)).when((tool == "conductor") & (n >= 2), less(1)).otherwise(leaf)
    )


def git_pointer(content: Column, path: Column) -> Column:
    """The resolution that the content of a copy's ``.git`` file gives, else null."""
    line = F.get(F.filter(F.transform(F.split(content, r"\r?\n"), F.trim), lambda x: x.startswith("gitdir:")), F.lit(0))
    target = F.trim(F.substring(line, 8, 1 << 20))
    root, label = F.regexp_extract(target, r"^(/.*)/\.git/worktrees/(.*?)/*$", 1), F.regexp_extract(target, r"^(/.*)/\.git/worktrees/(.*?)/*$", 2)
    return F.when((root != "") & (label != ""), _resolution(root, label, infer_tool(path), F.lit("git")))


def with_roots(project: DataFrame, session: DataFrame, git_files: DataFrame | None = None) -> DataFrame:
    """``project(id, path, ..)`` with is_worktree, root_path, worktree_label, worktree_tool and
    root_source.

    ``git_files(path, content)`` may give the ``.git`` files of projects, which decide before
    the path does.  Of several roots that fit a leaf the longest name wins, then most
    sessions, the last start and the path.
    """
    spark = project.sparkSession
    git_files = spark.createDataFrame([], "path string, content string") if git_files is None else git_files
    uses = session.groupBy("project_id").agg(F.count("*").alias("_sessions"), F.max("started_at").alias("_last"))
    pointed = git_files.select("path", git_pointer(V("content"), V("path")).alias("_git")).where("_git IS NOT NULL").dropDuplicates(["path"])
    p = project.join(uses, project.id == uses.project_id, "left").drop("project_id").join(pointed, "path", "left")
    own = _resolution(V("path"), F.lit(None), F.lit(None), F.lit("self"), False)
    p = p.withColumn("_outside", container(V("path"))).withColumn("_sure", F.coalesce("_git", intree(V("path")), F.when(V("_outside").isNull(), own)))
    roots = p.where("_sure IS NOT NULL").groupBy(V("_sure.root_path").alias("root")).agg(F.coalesce(F.sum("_sessions"), F.lit(0)).alias("n"), F.max("_last").alias("last"))
    roots = roots.withColumn("base", base_name(V("root"))).where("base <> ''")
    leaves = p.where("_sure IS NULL").select("id", V("_outside.tool").alias("tool"), V("_outside.leaf").alias("leaf"))
    tokens = F.split("leaf", "-")
    beginnings = leaves.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda k: F.array_join(F.slice(tokens, F.lit(1), k), "-"))).alias("base"))
    fits = beginnings.join(roots, "base")
    best = F.row_number().over(W.partitionBy("id").orderBy(F.length("base").desc(), V("n").desc(), V("last").desc_nulls_last(), V("root").desc()))
    found = fits.withColumn("nth", best).where("nth = 1").select("id", V("root").alias("_root"), V("base").alias("_base"))
    p = p.join(found, "id", "left")
    leaf, tool = V("_outside.leaf"), V("_outside.tool")
    key = strip_codename(tool, leaf)
    behind = lambda base: F.when(leaf.startswith(F.concat(base, F.lit("-"))), F.substring(leaf, F.length(base) + 2, F.length(leaf)))
    guessed = F.when(V("_root").isNotNull(), _resolution(V("_root"), behind(V("_base")), tool, F.lit("namematch"))).otherwise(
        F.when(key == "", _resolution(V("path"), F.lit(None), tool, F.lit("synthetic"))).otherwise(_resolution(key, behind(key), tool, F.lit("synthetic")))
    )
    p = p.withColumn("_r", F.coalesce("_sure", guessed))
    kept = [c for c in project.columns if c not in ("is_worktree", "root_path", "worktree_label", "worktree_tool", "root_source")]
    return p.select(*kept, "_r.*")
